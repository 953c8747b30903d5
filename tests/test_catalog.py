import pytest

from tests.oracle import compare
from tidelog.plans import catalog, scenarios  # noqa: F401


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        compare(df, catalog.ORACLE_SQL[name], sf)
    else:
        df.collect()


def test_list_fold_with_pops_against_python(spark, sf):
    events = sorted(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type").collect())
    want = {}
    for e in events:
        items = want.setdefault(f"list:{e['user_id']}", [])
        if e["event_type"] == "error":
            del items[:1]
        elif e["event_type"] == "signup":
            del items[-1:]
        elif e["event_type"] == "view":
            items.insert(0, str(e["event_id"]))
        else:
            items.append(str(e["event_id"]))
    got = {r["key"]: r["items"].split() for r in catalog.QUERIES["list_fold_with_pops"](spark, sf).collect()}
    assert got == want
