import json

import pytest

from tidelog.options import Options, from_properties, override
from tidelog.plans.cli import Shell
from tidelog.plans.client import Client
from tidelog.sources.store import VersionStore


def test_shell(spark, tmp_path):
    shell = Shell(VersionStore(spark, str(tmp_path / "s"), clock=lambda: 1000))
    run = lambda *a: shell.run(*a)
    out = lambda *a: json.loads(shell.run("--json", *a)[1])
    assert out("put", "a", "1", "extra")["key"] == "a" and out("ttl-put", "b", "2", "1000")["operation"] == "ttl-put"
    assert out("get", "a") == {"key": "a", "found": True, "value": "1"} and out("get", "b")["found"] is False
    assert run("get")[0] == run("nonsense")[0] == run("ttl-put", "a", "b", "x")[0] == 2
    assert out("scan", "a", "z") == out("prefix", "a", "5") == [{"key": "a", "value": "1"}] and out("scan", "a", "z", "0") == []
    assert out("lpush", "l", "x", "y") == 2 and out("lpop", "l") == "y" and out("rpop", "l") == "x" and out("lpop", "l") is None and run("get", "l")[0] == 2
    assert out("hset", "h", "f", "v") == 1 and out("hgetall", "h") == {"f": "v"} and out("hget", "h", "x") is None and run("hset", "h", "f")[0] == 2
    assert [r["sequence"] for r in out("wal-tail", "2")] == [5, 6] and out("wal-tail", "0") == []
    assert out("compact")["detail"] == "flush-triggered" and out("manifest-inspect")["fileCount"] == 1
    assert out("sst-inspect")[0]["parsed_entries"] == 6 and out("sst-inspect")[0]["exists"] and "entries=6" in run("sst-dump")[1]
    assert out("trace-key", "a")["nearby"][0]["key"] == "a" and out("recover")["manifest"]["nextFileId"] == 2 and "writes=6" in out("stats")["summary"]
    assert out("delete", "a")["status"] == "ok" and out("get", "a")["found"] is False
    assert shell.line("get none")[0] == 0 and shell.line("repl")[0] == 2 and run("help")[0] == run("help", "unknown")[0] == 0
    shell.store.close()
    assert run("put", "x", "1")[0] == 1


def test_client(spark, tmp_path):
    c = Client(VersionStore(spark, str(tmp_path / "s")))
    assert c.set("k", "a b") == "OK" and c.get("k") == "a b" and c.get("none") is None and c.exists("k", "k") == 2 and c.delete("k") == 1
    assert c.lpush("l", "a", "b", "c") == 3 and c.lrange("l", 0, -1) == ["c", "b", "a"] and c.lpop("l") == "c" and c.rpop("l") == "a"
    assert c.llen("missing") == 0 and c.lpop("missing") is None and c.ping() == "PONG"
    with pytest.raises(ValueError, match="WRONGTYPE"):
        c.get("l")


def test_options():
    assert Options().l0_trigger == 4 and from_properties().bloom_bits == 10 and from_properties({"l0-compaction-trigger": 20}).l0_stop == 21
    assert from_properties({"flush-batch-size": 1, "tombstone-retention-seconds": 0}).block_rows == 32
    for bad in ({"flush_rows": 0}, {"l0_trigger": 1}, {"l0_trigger": 5, "l0_stop": 4}, {"style": "odd"}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert override({"data-dir": "x", "port": 1}, {"data-dir": "y"}, {"DATA_DIR": "z", "PORT": 2}) == {"data-dir": "y", "port": 2}


def test_backpressure(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), options=Options(l0_trigger=2, l0_stop=2, flush_rows=1))
    for i in range(3):
        store.put("k", str(i).encode())
    assert store.get("k") == b"2" and store.counters["flushes"] == 3 and store.counters["compactions"] >= 1
