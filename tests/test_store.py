import json
import time

import pytest
from pyspark.sql import functions as F

from tidelog.operators import writes
from tidelog.operators.writes import Batch
from tidelog.options import Options
from tidelog.plans.protocol import Session, tokenize
from tidelog.sources.store import Conflict, Files, VersionStore
from tidelog.streaming.ingest import ingest

OPS = "ord long, vtype tinyint, key string, value binary, expire_at_ms long"


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"), clock=lambda: 1000)


def test_put_get_delete_snapshot_and_restart(spark, store, tmp_path):
    store.put("user:1", b"v1")
    s = store.snapshot()
    store.put("user:1", b"v2")
    store.ttl_put("gone", b"x", 1000)
    assert (store.get("user:1", s), store.get("user:1"), store.get("gone")) == (b"v1", b"v2", None)
    store.delete("user:1")
    assert store.get("user:1") is None
    store.put("k2", b"2")
    store.close()
    again = VersionStore(spark, str(tmp_path / "store"), clock=lambda: 1000)
    assert again.get("k2") == b"2" and again.snapshot() == 5 and again.get("user:1") is None
    assert again.manifest["wal"] == [] and len(again.manifest["files"]) == 1
    with pytest.raises(RuntimeError):
        store.put("x", b"1")


def test_batch_is_all_or_nothing_and_empty_is_no_op(store):
    store.write(Batch().put("a", b"1").put("b", b"2"))
    with pytest.raises(ValueError):
        store.write(Batch().put("a", b"9").put("c", None))
    assert store.get("a") == b"1" and store.write(Batch()) == 2
    with pytest.raises(ValueError):
        store.put("", b"1")


def test_flush_compact_and_stats(store):
    for i in range(4):
        store.put(f"k{i % 2}", str(i).encode())
        store.flush()
    assert store.counters["flushes"] == 4 and store.counters["compactions"] == 1
    assert [r["key"] for r in store.scan("a", "z", 10).collect()] == ["k0", "k1"] and store.get("k1") == b"3"
    assert store.stats()["l1Files"] == 1 and store.stats()["writeAmplification"] == 2.0
    assert "writeAmplification=2.0000" in store.stats_text()
    assert len(store.sst_dump()) == 1 and "keyRange=k0..k1" in store.sst_dump()[0]
    store.delete("k0")
    store.delete("k1")
    store.flush()
    store.compact()
    assert store.log().count() == 0 and store.snapshot() == 6  # numbers go on after all is purged
    assert store.put("k", b"1") == 7


def test_second_writer_fails(spark, store, tmp_path):
    other = VersionStore(spark, str(tmp_path / "store"))
    store.put("a", b"1")
    with pytest.raises(Exception, match="exist"):
        other.put("b", b"2")
    assert VersionStore(spark, str(tmp_path / "store")).get("b") is None


def test_commands(store):
    s = Session(store)
    run = lambda line: s.run(line).lines
    assert run("PING") == ["PONG"] and run("echo a  b") == ["a b"] and s.run("").code == 2 and s.run('put "x').code == 2
    assert run("SET user:1 alice smith") == ["OK"] and run("get user:1") == ["alice smith"] and run("GET none") == ["(nil)"]
    assert run("INCR c") == ["1"] and run("DECR c") == ["0"] and s.run("INCR user:1").code == 2
    assert run("SET big 9223372036854775807") == ["OK"] and s.run("INCR big").status == "ERR"
    assert run("MSET a 1 b 2 a 3") == ["OK"] and run("MGET a b zz a") == ["3", "2", "(nil)", "3"] and s.run("MSET a").code == 2
    assert run("EXISTS a a zz") == ["2"] and run("DEL a a zz") == ["1"] and run("EXISTS a") == ["0"]
    assert run("LPUSH l a b") == ["2"] and run("RPUSH l c") == ["3"] and run("LRANGE l 0 -1") == ["b", "a", "c"] and run("LRANGE l -2 9") == ["a", "c"]
    assert run("LRANGE l 2 1") == [] and run("LPOP l") == ["b"] and run("RPOP l") == ["c"] and run("LPOP l") == ["a"] and run("LPOP l") == ["(nil)"] and run("EXISTS l") == ["1"]
    assert s.run("GET l").lines[0].startswith("WRONGTYPE") and s.run("SADD l x").code == 2
    assert run("SADD s red green red") == ["2"] and run("SCARD s") == ["2"] and run("SISMEMBER s green") == ["1"] and run("SMEMBERS s") == ["green", "red"] and run("SREM s red x") == ["1"]
    assert run("HSET h name ming city x") == ["2"] and run("HSET h name li age 3") == ["1"] and run("HGETALL h") == ["name", "li", "city", "x", "age", "3"]
    assert run("HGET h none") == ["(nil)"] and run("HDEL h name none") == ["1"] and run("HLEN h") == ["2"] and run("HEXISTS h city") == ["1"]
    assert "user:1" in run("KEYS *") and run("KEYS user*") == ["user:1"] and run("KEYS nope") == []
    assert len(run("COMMAND")) == 32 and run("INFO")[:2] == ["server:tidelog", "protocol:SKSP/1.0"] and s.run("LRANGE l a b").code == 2 and s.run("nonsense").code == 2
    assert s.run("PING").frame() == "SKSP/1.0 OK 0\r\n1\r\nPONG\r\n"


def test_commands_with_any_key_and_those_of_the_shell(store):
    s = Session(store)
    run = lambda line: s.run(line).lines
    for key in ("self", "pairs", "args", "name"):
        assert run(f"SET {key} x") == ["OK"] and run(f"GET {key}") == ["x"] and run(f"LPUSH l{key} a") == ["1"]
    assert run("SET n 1") == ["OK"] and run("INCR n") == ["2"] and run("HSET self2 a b") == ["1"]
    assert s.run("put k v").ok and run("get k") == ["v"] and run("scan k k") == ['[{"key": "k", "value": "v"}]'] and run("prefix zz") == ["[]"]
    assert s.run("repl").code == 2 and s.run("scan k").code == 2 and s.run("nonsense").lines == ["unknown command: nonsense"]
    assert any(line.startswith("writes=") for line in json.loads(run("stats")[0])["summary"].splitlines())


def test_large_batches_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    """60,000 operations of 500 bytes, with adaptive execution on and off, in one range and in many."""
    n = 60_000
    ops = spark.range(n).select((F.lit(n) - F.col("id")).alias("ord"), F.lit(1).cast("tinyint").alias("vtype"), F.concat(F.lit("k"), F.pmod(F.hash("id"), F.lit(9000)).cast("string")).alias("key"), F.rpad(F.col("id").cast("string"), 500, "x").cast("binary").alias("value"), F.lit(-1).cast("long").alias("expire_at_ms"))
    for adaptive in ("true", "false"):
        for rows in (250_000, 7_000):
            monkeypatch.setattr(writes, "RANGE_ROWS", rows)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            try:
                store = VersionStore(spark, str(tmp_path / f"{adaptive}{rows}"), options=Options(flush_rows=10**9))
                assert store.put("first", b"1") == 1 and store.write(ops) == n + 1
                got = store.log().where("seq > 1").select("seq", F.trim(F.col("value").cast("string"), F.lit("x")).cast("long").alias("id"))
                assert got.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq"), F.count(F.when(F.col("seq") != n + 1 - F.col("id"), 1))).first() == (n, n, 2, n + 1, 0)
            finally:
                spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_batch_that_reads_differently_each_time(spark, store):
    """The batch is written once before it is numbered, so a source that is not stable does no harm."""
    ops = spark.range(2000).select((F.rand() * 1e9).cast("long").alias("ord"), F.lit(1).cast("tinyint").alias("vtype"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(b"v").alias("value"), F.lit(-1).cast("long").alias("expire_at_ms")).where("rand() < 0.5")
    last = store.write(ops)
    assert store.log().agg(F.count("*"), F.count_distinct("seq"), F.max("seq")).first() == (last, last, last) and 0 < last < 2000
    assert "staging" not in [n for n in store.files.names() if Files(store.spark, f"{store.files.root}/{n}").names()]


def test_a_writer_that_is_behind_is_refused_and_deletes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelog.sources.store.KEPT", 1)
    path = str(tmp_path / "s")
    one = VersionStore(spark, path)
    one.put("a", b"0")
    one.flush()
    late = VersionStore(spark, path)
    for k in range(3):
        one.put("a", str(k).encode())
    one.flush()
    for attempt in (lambda: late.put("b", b"lost"), late.compact, late.flush, lambda: late.write(Batch().delete("a").frame(spark))):
        if attempt != late.flush:
            with pytest.raises(Conflict, match="exist"):
                attempt()
        else:
            attempt()  # nothing to flush
    now = VersionStore(spark, path)
    assert now.get("a") == b"2" and now.log().count() == 4 and now.get("b") is None
    assert not Files(spark, f"{path}/wal").names() and not Files(spark, f"{path}/staging").names()  # what was refused is gone
    late.refresh()
    late.put("b", b"kept")
    assert VersionStore(spark, path).get("b") == b"kept"


def test_a_writer_whose_number_is_free_again_is_refused(spark, store, monkeypatch):
    """The check before the create passes, the create too, but others have committed since."""
    store.put("a", b"1")
    seen = iter([store.number, store.number + 7])
    monkeypatch.setattr(store, "_newest", lambda: next(seen))
    with pytest.raises(Conflict):
        store.put("b", b"2")
    assert store.files.names().count("manifest-1.json") == 0 and store.manifest["lastSequence"] == 1


def test_cache_cleanup_backpressure_and_slow_reads(spark, tmp_path):
    now = [1000]
    store = VersionStore(spark, str(tmp_path / "s"), clock=lambda: now[0], options=Options(cache_entries=2, cleanup_ms=50, slow_ms=1, l0_trigger=9, l0_stop=9))
    store.ttl_put("t", b"1", 2000)
    store.put("a", b"1")
    assert [store.get(k) for k in ("t", "t", "a", "none", "none", "t")] == [b"1", b"1", b"1", None, None, b"1"]
    assert (store.cache.hits, store.cache.misses) == (2, 4) and store.stats()["cacheHitRate"] == 2 / 6 and store.counters["slow_reads"] >= 4
    now[0] = 2000
    assert store.get("t") is None and store.cache.hits == 3  # expiry is judged at the read
    store.put("a", b"2")
    assert store.get("a") == b"2" and store.fetch(store.scan("a", "b", 5)) == [("a", b"2")] and store.counters["slow_scans"] == 1
    store.flush()
    store.start_cleanup()
    for _ in range(200):
        if store.counters["compactions"]:
            break
        time.sleep(0.1)
    assert store.counters["compactions"] == 1 and store.clean_up() is False
    store.close()
    assert store.cleanup is None
    for use in (store.snapshot, store.log, store.stats, store.wal_tail, lambda: store.get("a")):
        with pytest.raises(RuntimeError):
            use()
    stuck = VersionStore(spark, str(tmp_path / "t"), options=Options(l0_trigger=2, l0_stop=2, stall_ms=1, stall_retries=2))
    stuck.manifest["files"] = [{"level": 0, "path": f"level=0/{k}", "entries": 1} for k in range(2)]
    stuck.compact = lambda: None
    with pytest.raises(OSError, match="stalls"):
        stuck.put("a", b"1")
    assert stuck.counters["backpressure"] == 2


def test_tokenize():
    assert tokenize("put \"hello world\" 'more text' escaped\\ space") == ["put", "hello world", "more text", "escaped space"]
    assert tokenize("a '' b\\") == ["a", "b\\"]
    with pytest.raises(ValueError):
        tokenize('put "bad')


def test_stream(spark, store, tmp_path):
    rows = [(1, 1, "a", bytearray(b"1"), -1), (2, 1, "b", bytearray(b"2"), -1), (3, 2, "a", None, -1)]
    spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest(spark.readStream.schema(OPS).parquet(str(tmp_path / "in")), store, str(tmp_path / "point")).start().awaitTermination()
    assert store.get("a") is None and store.get("b") == b"2" and store.snapshot() == 3


def test_a_stream_batch_whose_write_fails_is_written_when_replayed(spark, store, tmp_path, monkeypatch):
    rows = [(1, 1, "a", bytearray(b"1"), -1), (2, 1, "b", bytearray(b"2"), -1)]
    spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(str(tmp_path / "in"))
    start = lambda: ingest(spark.readStream.schema(OPS).parquet(str(tmp_path / "in")), store, str(tmp_path / "point")).start().awaitTermination()
    plain = store._frame

    def fail(ops, path):
        monkeypatch.setattr(store, "_frame", plain)
        raise OSError("disk")

    monkeypatch.setattr(store, "_frame", fail)
    with pytest.raises(Exception, match="disk"):
        start()
    assert store.snapshot() == 0 and "streams" not in store.manifest
    start()
    assert store.snapshot() == 2 and store.get("b") == b"2"
    start()
    assert store.snapshot() == 2
