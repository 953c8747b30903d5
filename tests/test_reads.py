import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.codec import text
from tidelog.operators import compaction, reads, stats
from tidelog.schema import LOG

NOW = 1000


def log_of(spark, rows):
    return spark.createDataFrame([(k, s, t, None if v is None else bytearray(v.encode()), e) for k, s, t, v, e in rows], LOG)


def model(rows, now, snapshot=None):
    """Newest version of each key by brute force; then delete and expiry."""
    best = {}
    for k, s, t, v, e in rows:
        if (snapshot is None or s <= snapshot) and s > best.get(k, (-1,))[0]:
            best[k] = (s, t, v, e)
    return {k: v for k, (s, t, v, e) in best.items() if t == 1 and not 0 < e <= now}


def shown(df):
    return {r["key"]: r["v"] for r in df.select("key", text(F.col("value")).alias("v")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    r = random.Random(seed)
    keys = ["a", "b", "ab", "b￿x", "\U0001F600", "é", "zz"]
    rows = [(r.choice(keys), s, r.choice([1, 1, 1, 2]), None, r.choice([-1, -1, 0, NOW - 1, NOW, NOW + 1])) for s in range(1, 60)]
    rows = [(k, s, t, f"v{s}" if t == 1 else None, e) for k, s, t, _, e in rows]
    log = log_of(spark, rows).cache()
    for snapshot in (None, 0, 20, 40):
        want = model(rows, NOW, snapshot)
        assert shown(reads.latest_visible(log, NOW, snapshot)) == want
        order = sorted(want, key=lambda k: k.encode("utf-16-be"))
        assert [x["key"] for x in reads.scan(log, "", "￿", 100, NOW, snapshot).collect()] == [k for k in order if k.encode("utf-16-be") <= b"\xff\xff"]
        assert [x["key"] for x in reads.prefix_scan(log, "b", 100, NOW, snapshot).collect()] == [k for k in order if k.startswith("b")]
    assert shown(compaction.compact(log, NOW)) == model(rows, NOW)
    asked = [(k, s) for k in [*keys, "none"] for s in (0, 10, 30, 59)]
    got = {(x["key"], x["snapshot"]): x["value"] for x in reads.get_as_of(log, spark.createDataFrame(asked, "key string, snapshot long"), NOW).collect()}
    assert {k: v and bytes(v).decode() for k, v in got.items()} == {(k, s): model(rows, NOW, s).get(k) for k, s in asked}


def test_limits_and_bounds(spark):
    log = log_of(spark, [("a", 1, 1, "1", -1), ("b", 2, 1, "2", -1), ("c", 3, 1, "3", -1)])
    names = lambda df: [r["key"] for r in df.collect()]
    assert names(reads.scan(log, "a", "c", 10, NOW)) == ["a", "b", "c"]
    assert names(reads.scan(log, "b", "b", 10, NOW)) == ["b"]
    assert names(reads.scan(log, "c", "a", 10, NOW)) == []
    assert names(reads.scan(log, "a", "c", 0, NOW)) == names(reads.scan(log, "a", "c", -5, NOW)) == []
    assert names(reads.prefix_scan(log, None, 2, NOW)) == ["a", "b"]


def test_expired_hides_older_and_boundary(spark):
    rows = [("k", 1, 1, "old", -1), ("k", 2, 1, "new", 100), ("z", 3, 1, "zero", 0), ("n", 4, 1, "neg", -7)]
    log = log_of(spark, rows)
    assert shown(reads.latest_visible(log, 99)) == {"k": "new", "z": "zero", "n": "neg"}
    assert shown(reads.latest_visible(log, 100)) == {"z": "zero", "n": "neg"}
    assert reads.get(log, "k", 100).collect() == []


def test_empty_log(spark):
    log = log_of(spark, [])
    assert reads.latest_visible(log, NOW).collect() == []
    assert compaction.replay_summary(log, 5).first() == (0, 5)
    assert stats.amplification(log, log).first()["write_amplification"] == 0.0


def test_retained_snapshot_reads_alike(spark):
    rows = [("k", 1, 1, "a", -1), ("k", 3, 1, "b", -1), ("j", 2, 1, "c", -1), ("j", 4, 2, None, -1)]
    log = log_of(spark, rows)
    kept = compaction.compact(log, NOW, retain_from_seq=3)
    for s in (2, 3, 4):
        assert shown(reads.latest_visible(kept, NOW, s)) == model(rows, NOW, s)


def test_styles():
    assert [compaction.parse_style(s) for s in (None, " ", "Size_Tiered", "size-tired", "leveled")] == ["leveled", "leveled", "size-tiered", "size-tiered", "leveled"]
    with pytest.raises(ValueError):
        compaction.parse_style("other")


def test_plan_keeps_one_row_a_key_before_the_shuffle(spark, sf):
    from tidelog.sources.oplog import events_log

    plan = reads.latest_visible(events_log(spark, sf).where("seq <= 500"), NOW)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "WindowGroupLimit" in plan and "PushedFilters" in plan and "CartesianProduct" not in plan
