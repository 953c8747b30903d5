"""Registered queries that go through a store, a stream, commands and raw files, and the same in DuckDB's SQL.

Each makes a store of its own in the folder that the cluster shares, writes the log of the events table to it, and
reads the result back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import compaction, reads
from ..operators import collections as col
from ..operators.writes import Batch
from ..options import Options, from_properties
from ..sources import files, oplog
from ..sources.oplog import NOW_MS as NOW
from ..sources.store import Conflict, VersionStore
from ..streaming.ingest import ingest
from .catalog import LIVE_SQL, newest_sql, query
from .cli import Shell
from .client import Client
from .protocol import Session

QUIET = Options(flush_rows=10**9, l0_trigger=10**6, l0_stop=10**6)


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidelog-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def store_of(spark: SparkSession, options: Options = QUIET) -> VersionStore:
    return VersionStore(spark, folder(spark), clock=lambda: NOW, options=options)


def operations(spark: SparkSession, d: str) -> DataFrame:
    return oplog.events_log(spark, d).select(F.col("seq").alias("ord"), "vtype", "key", "value", "expire_at_ms")


def thirds(spark: SparkSession, d: str) -> list[DataFrame]:
    """The operations in three batches, by seq modulo 3."""
    ops = operations(spark, d)
    return [ops.where(F.pmod("ord", F.lit(3)) == k) for k in range(3)]


def values_of(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few rows as a relation of the JVM's."""
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(each))


#: The log as it is numbered when written in thirds.
THIRDS_SQL = "with t as (select key, vtype, value, expire_at_ms, row_number() over (order by (seq % 3), seq) seq, seq % 3 part from log)"


@query("select key, seq, vtype::int vtype, value, expire_at_ms from log")
def store_write(spark, d):
    """One batch of all operations: validated, numbered, written all or nothing."""
    store = store_of(spark)
    store.write(operations(spark, d))
    return store.log().select("key", "seq", F.col("vtype").cast("int").alias("vtype"), codec.text(F.col("value")).alias("value"), "expire_at_ms")


@query(f"select key, seq, value from {newest_sql()} where {LIVE_SQL}")
def store_write_flush_compact(spark, d):
    store = store_of(spark)
    store.write(operations(spark, d))
    store.flush()
    store.compact()
    return store.log().select("key", "seq", codec.text(F.col("value")).alias("value"))


@query(f"{THIRDS_SQL} select key, seq from t")
def store_recover(spark, d):
    """Two batches flushed and one not; another handle on the folder finds them all."""
    store = store_of(spark)
    for k, ops in enumerate(thirds(spark, d)):
        store.write(ops)
        if k < 2:
            store.flush()
    return VersionStore(spark, store.files.root).log().select("key", "seq")


@query(f"{THIRDS_SQL} select key, value from {newest_sql('seq <= (select count(*) from t where part < 2)', 't')} where {LIVE_SQL} and key between 'user:00002' and 'user:00090' order by key limit 25")
def store_scan_at_snapshot(spark, d):
    store = store_of(spark)
    snapshots = [store.write(ops) for ops in thirds(spark, d)]
    store.flush()
    return store.scan("user:00002", "user:00090", 25, snapshots[1]).withColumn("value", codec.text(F.col("value")))


@query(f"{THIRDS_SQL} select 0 as \"level\", part + 1 file_id, min(key) min_key, max(key) max_key, min(seq) min_seq, max(seq) max_seq, count(*) entries, (select max(seq) from t) last_flushed, 4 next_file_id from t group by part")
def store_manifest(spark, d):
    """The generations that the manifest names after three flushes, and its counters."""
    store = store_of(spark)
    for ops in thirds(spark, d):
        store.write(ops)
        store.flush()
    m = store.manifest
    names = ["level", "file_id", "min_key", "max_key", "min_seq", "max_seq", "entries", "last_flushed", "next_file_id"]
    found = values_of(spark, names, [(*[g[n] for n in names[:7]], m["lastFlushedSequence"], m["nextFileId"]) for g in m["files"]])
    return found.select(*[F.col(n).cast("string" if n.endswith("_key") else "int" if n in ("level", "next_file_id") else "long").alias(n) for n in names])


@query(f"""with c as (select count(*) n, count(*) filter (vtype = 2) gone from log), l as (select count(*) held from {newest_sql()} where {LIVE_SQL})
select unnest([
  'writes=' || n, 'reads=1', 'deletes=' || gone, 'scans=1', 'flushes=3', 'compactions=1', 'cacheHits=0', 'cacheMisses=1', 'cacheHitRate=0.0000', 'bloomPositives=0', 'bloomNegatives=0', 'backpressureEvents=0',
  printf('writeAmplification=%.4f', (n + n) / n), 'readAmplification=1.0000', printf('spaceAmplification=%.4f', held / greatest(1, n - gone)), 'l0Files=0', 'l1Files=1']) line from c, l""")
def store_stats(spark, d):
    store = store_of(spark)
    operations_ = operations(spark, d)
    n = operations_.count()
    for k in range(3):
        store.write(operations_.where((F.col("ord") > k * n // 3) & (F.col("ord") <= (k + 1) * n // 3)))
        store.flush()
    store.compact()
    store.get("user:00001")
    store.scan("a", "b", 1)
    return values_of(spark, ["line"], [(line,) for line in store.stats_text().splitlines()])


@query("""select r_name as key, case when r_regionkey = 1 then null when r_regionkey = 2 then null when r_regionkey = 3 then 'again' else 'v' || r_regionkey end as value, 'v' || r_regionkey at_first, 8::bigint last from region""", log=False)
def store_put_ttl_put_delete(spark, d):
    """Each region put; one deleted, one put again to expire now, one put again; read now and as of the first batch."""
    store = store_of(spark)
    names = [r["r_name"] for r in oplog.table(spark, d, "region").orderBy("r_regionkey").collect()]  # five rows
    batch = Batch()
    for k, name in enumerate(names):
        batch.put(name, f"v{k}".encode())
    first = store.write(batch)
    store.delete(names[1])
    store.ttl_put(names[2], b"gone", NOW)
    last = store.put(names[3], b"again")
    show = lambda v: None if v is None else v.decode()
    rows = [(n, show(store.get(n)), show(store.get(n, first)), last) for n in names]
    return values_of(spark, ["key", "value", "at_first", "last"], rows).select("key", F.col("value").cast("string").alias("value"), "at_first", F.col("last").cast("long").alias("last"))


@query("select 4::bigint flushes, 2::bigint compactions, 0::bigint l0_files, 1::bigint l1_files, (select count(*) from log)::bigint writes, 0::bigint unflushed")
def store_triggers(spark, d):
    """Batches that reach flush_rows start a flush; two generations at level 0 start a compaction."""
    store = store_of(spark, Options(flush_rows=1, l0_trigger=2, l0_stop=2))
    ops = operations(spark, d)
    for k in range(4):
        store.write(ops.where(F.pmod("ord", F.lit(4)) == k))
    c, s = store.counters, store.stats()
    return values_of(spark, ["flushes", "compactions", "l0_files", "l1_files", "writes", "unflushed"], [(c["flushes"], c["compactions"], s["l0Files"], s["l1Files"], c["writes"], len(store.manifest["wal"]))]).select(*[F.col(n).cast("long").alias(n) for n in ("flushes", "compactions", "l0_files", "l1_files", "writes", "unflushed")])


@query("select true cleaned, false again, 1 files", log=False)
def store_cleanup(spark, d):
    """The background cleanup merges several generations, and leaves a single one without anything to drop."""
    store = store_of(spark)
    for ops in thirds(spark, d):
        store.write(ops)
        store.flush()
    return values_of(spark, ["cleaned", "again", "files"], [(store.clean_up(), store.clean_up(), len(store.manifest["files"]))])


@query("select count(*) n, true refused from log")
def store_late_writer(spark, d):
    """A handle that is two commits behind is refused, and removes nothing."""
    store = store_of(spark)
    store.write(operations(spark, d))
    late = VersionStore(spark, store.files.root, options=QUIET)
    store.flush()
    store.compact(purge=False, retain_from_seq=0)
    try:
        late.compact()
        late.put("x", b"")
        refused = False
    except Conflict:
        refused = True
    return store.log().agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("select key, seq from log")
def stream_ingest(spark, d):
    """The operations as a stream of files into a store; run twice, the second finds nothing new."""
    store, into, point = store_of(spark), folder(spark), folder(spark)
    ops = operations(spark, d)
    ops.coalesce(1).write.parquet(into)
    for _ in range(2):
        ingest(spark.readStream.schema(ops.schema).parquet(into), store, point).start().awaitTermination()
    return store.log().select("key", "seq")


# Commands: each line with its reply, the replies' lines joined.


def replies(spark: SparkSession, session: Session, lines: list[str]) -> DataFrame:
    found = [(k, line, (r := session.run(line)).status, r.code, "|".join(r.lines)) for k, line in enumerate(lines)]
    return values_of(spark, ["i", "command", "status", "code", "reply"], found)


def expected(*rows: tuple[str, str]) -> str:
    """The same as SQL: commands with the reply of each; one that begins with ! is an error of code 2."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "select * from (values " + ", ".join(f"({k}, {quoted(c)}, '{'ERR' if r[:1] == '!' else 'OK'}', {2 if r[:1] == '!' else 0}, {quoted(r.removeprefix('!'))})" for k, (c, r) in enumerate(rows)) + ") t(i, command, status, code, reply)"


WRONG = "!" + reads.WRONG_TYPE
STRINGS = [
    ("PING", "PONG"), ("ping a b", "a b"), ("ECHO a  'b c'", "a b c"), ("SET self alice smith", "OK"), ("GET self", "alice smith"), ("GET none", "(nil)"), ("MSET a 1 b 2 a 3", "OK"), ("MGET a b zz a", "3|2|(nil)|3"),
    ("EXISTS a a zz", "2"), ("DEL a a zz", "1"), ("EXISTS a", "0"), ("INCR n", "1"), ("DECR n", "0"), ("DECR n", "-1"), ("INCR self", "!value is not an integer or out of range"), ("SET", "!usage: SET <key> <value>"),
    ("KEYS *", "b|n|self"), ("KEYS se*", "self"), ("KEYS b", "b"), ("KEYS nope", ""), ("", "!empty command"), ('SET "x', "!invalid command: unterminated quoted string"), ("put k v", '{"status": "ok", "operation": "put", "key": "k"}'),
    ("scan k l", '[{"key": "k", "value": "v"}]'), ("repl", "!repl is interactive"), ("nonsense", "!unknown command: nonsense"), ("QUIT", "bye"),
]
LISTS = [
    ("RPUSH l a b c", "3"), ("LPUSH l x y", "5"), ("LRANGE l 0 -1", "y|x|a|b|c"), ("LRANGE l -2 9", "b|c"), ("LRANGE l 3 1", ""), ("LPOP l", "y"), ("RPOP l", "c"), ("LLEN l", "3"), ("LLEN none", "0"), ("LPOP none", "(nil)"),
    ("GET l", WRONG), ("SADD l x", WRONG), ("RPOP l", "b"), ("RPOP l", "a"), ("RPOP l", "x"), ("RPOP l", "(nil)"), ("EXISTS l", "1"),
]
SETS = [("SADD s red green red", "2"), ("SADD s red blue", "1"), ("SMEMBERS s", "blue|green|red"), ("SISMEMBER s green", "1"), ("SISMEMBER s no", "0"), ("SREM s red no", "1"), ("SCARD s", "2"), ("SREM none x", "0"), ("EXISTS none", "1"), ("LPUSH s x", WRONG)]
HASHES = [
    ("HSET h name ming city x", "2"), ("HSET h name li age 3", "1"), ("HGETALL h", "name|li|city|x|age|3"), ("HGET h name", "li"), ("HGET h none", "(nil)"), ("HDEL h name none", "1"), ("HLEN h", "2"), ("HEXISTS h city", "1"),
    ("HEXISTS h name", "0"), ("HSET h odd", "!usage: HSET <key> <field> <value> [field value ...]"), ("HGETALL h", "city|x|age|3"), ("RPUSH h x", WRONG),
]


def _commands(name: str, rows: list[tuple[str, str]]) -> None:
    def run(spark, d):
        return replies(spark, Session(store_of(spark)), [c for c, _ in rows])

    run.__name__ = name
    query(expected(*rows), log=False)(run)


for _name, _rows in (("commands_strings", STRINGS), ("commands_lists", LISTS), ("commands_sets", SETS), ("commands_hashes", HASHES)):
    _commands(_name, _rows)

SHELL = [
    ("put a 1", '{"status": "ok", "operation": "put", "key": "a"}'), ("ttl-put b 2 1000", '{"status": "ok", "operation": "ttl-put", "key": "b"}'), ("get a", '{"key": "a", "found": true, "value": "1"}'), ("get b", '{"key": "b", "found": false, "value": null}'),
    ("scan a z", '[{"key": "a", "value": "1"}]'), ("prefix a 5", '[{"key": "a", "value": "1"}]'), ("lpush l x y", "2"), ("lrange l 0 -1", '["y", "x"]'), ("sadd s m", "1"), ("hset h f v", "1"), ("hgetall h", '{"f": "v"}'),
    ("wal-tail 1", '[{"sequence": 5, "type": "PUT", "key": "h", "valueSize": 18, "expireAtMillis": -1}]'), ("compact", '{"status": "ok", "operation": "compact", "detail": "flush-triggered"}'), ("delete a", '{"status": "ok", "operation": "delete", "key": "a"}'),
    ("get a", '{"key": "a", "found": false, "value": null}'), ("scan a", "!usage: scan needs 2 arguments or more"),
]


@query(expected(*SHELL), log=False)
def shell_commands(spark, d):
    shell = Shell(store_of(spark))
    found = [(k, line, *shell.run("--json", *line.split())) for k, (line, _) in enumerate(SHELL)]
    return values_of(spark, ["i", "command", "status", "code", "reply"], [(k, c, "ERR" if code else "OK", code, out) for k, c, code, out in found])


@query("select * from (values ('set', 'OK'), ('get', 'a b'), ('get none', 'null'), ('exists', '1'), ('lpush', '2'), ('lrange', 'y,x'), ('hgetall', 'f,v'), ('delete', '1'), ('error', 'WRONGTYPE')) t(call, result)", log=False)
def client_calls(spark, d):
    c = Client(store_of(spark))
    made = [("set", c.set("k", "a b")), ("get", c.get("k")), ("get none", c.get("none") or "null"), ("exists", c.exists("k")), ("lpush", c.lpush("l", "x", "y")), ("lrange", ",".join(c.lrange("l", 0, -1)))]
    c.hset("h", "f", "v")
    made += [("hgetall", ",".join(c.hgetall("h"))), ("delete", c.delete("k")), ("error", c.execute("get", "l").lines[0].split()[0])]
    return values_of(spark, ["call", "result"], [(n, str(v)) for n, v in made])


# Raw files


@query("select key, seq, vtype::int vtype, case when vtype = 1 then value end as value, expire_at_ms from log")
def raw_tables(spark, d):
    """The log as raw sorted tables, decoded again."""
    made = files.encode_tables(oplog.with_files(oplog.events_log(spark, d)))
    return files.decode(made).select("key", "seq", F.col("vtype").cast("int").alias("vtype"), codec.text(F.col("value")).alias("value"), "expire_at_ms")


@query("select key, seq, vtype::int vtype, expire_at_ms from log")
def raw_wal(spark, d):
    """The log as frames of a write-ahead log, checksums and all, decoded again."""
    made = files.encode_wal(oplog.events_log(spark, d).withColumn("frame", F.expr("seq div 500")), "frame")
    return files.decode(made, tables=False).select("key", "seq", F.col("vtype").cast("int").alias("vtype"), "expire_at_ms")


CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(key) + 1), lambda i: ascii(key[i])::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"


@query(f"with k as (select distinct key from log) select key, {CRC_SQL} crc from k")
def crc32_key(spark, d):
    return oplog.events_log(spark, d).select("key").distinct().select("key", F.crc32(F.encode("key", "UTF-8")).alias("crc"))


# Codecs, folds, options


@query("select c_custkey, '__sksp:hash__:' || to_base64(encode('name' || chr(0) || c_name)) || ',' || to_base64(encode('segment' || chr(0) || c_mktsegment)) encoded, 'name=' || c_name || ',segment=' || c_mktsegment decoded from customer", log=False)
def hash_codec(spark, d):
    c = oplog.table(spark, d, "customer")
    v = codec.encode_hash(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")))
    pairs = F.transform(F.map_entries(codec.decode_hash(F.col("v"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return c.select("c_custkey", v.alias("v")).select("c_custkey", codec.text(F.col("v")).alias("encoded"), F.array_join(pairs, ",").alias("decoded"))


@query("select user_id, string_agg(event_type || '=' || last, ',' order by first) fields from (select user_id, event_type, min(event_id) first, max(event_id) last from events group by all) group by user_id", log=False)
def hgetall_in_order(spark, d):
    """Fields in order of first appearance, with their last value."""
    e = oplog.table(spark, d, "events")
    entries = F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("k"), F.col("event_id").cast("string").alias("v"))))
    fields = F.map_entries(codec.last_wins(F.transform("e", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))))
    return e.groupBy("user_id").agg(entries.alias("e")).select("user_id", F.array_join(F.transform(fields, lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("fields"))


@query("select 'n:' || user_id key, -count(*)::bigint as value from events group by user_id", log=False)
def decr_fold(spark, d):
    return col.fold_counters(oplog.table(spark, d, "events").select(F.concat(F.lit("n:"), F.col("user_id").cast("string")).alias("key"), F.lit(-1).cast("long").alias("by")))


@query("select * from (values ('', 'leveled'), ('LEVELED', 'leveled'), ('size_tiered', 'size-tiered'), ('Size-Tired', 'size-tiered'), ('other', 'error')) t(given, style)", log=False)
def style_names(spark, d):
    def parsed(text):
        try:
            return compaction.parse_style(text)
        except ValueError:
            return "error"

    return values_of(spark, ["given", "style"], [(t, parsed(t)) for t in ("", "LEVELED", "size_tiered", "Size-Tired", "other")])


@query("select * from (values ('flush_rows', '10000'), ('block_rows', '1000'), ('l0_trigger', '20'), ('l0_stop', '21'), ('bloom_bits', '10'), ('bloom', 'True'), ('cache_entries', '4096'), ('cleanup_ms', '3600000'), ('scan_limit', '100'), ('style', 'leveled')) t(name, value)", log=False)
def options_from_properties(spark, d):
    o = from_properties({"l0-compaction-trigger": 20})
    return values_of(spark, ["name", "value"], [(n, str(getattr(o, n))) for n in ("flush_rows", "block_rows", "l0_trigger", "l0_stop", "bloom_bits", "bloom", "cache_entries", "cleanup_ms", "scan_limit", "style")])
