"""The registered queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, codec, numbers
from ..functions.keys import sort_key
from ..operators import collections as col
from ..operators import compaction, reads, stats, writes
from ..schema import PUT
from ..sources import oplog
from ..sources.oplog import NOW_MS as NOW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG_SQL = f"""log as (
  select 'user:' || lpad(user_id::varchar, 5, '0') key, event_id + 1 seq, case when event_type = 'error' then 2 else 1 end vtype,
    case when event_type <> 'error' then props end value,
    case when event_type = 'signup' then epoch_us(ts) // 1000 + {oplog.TTL_MS} else -1 end expire_at_ms
  from events)"""


def newest_sql(where: str = "true", source: str = "log") -> str:
    return f"(select * from {source} where {where} qualify row_number() over (partition by key order by seq desc) = 1)"


LIVE_SQL = f"vtype = 1 and not (expire_at_ms > 0 and expire_at_ms <= {NOW})"


def query(sql: str | None = None, log: bool = True):
    """Register a query under its function's name, with its SQL (over the log unless log is False)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = f"with {LOG_SQL}{', ' + body[5:] if body.startswith('with ') else ' ' + body}" if log else body
        return f

    return add


def _log(spark, d):
    return oplog.events_log(spark, d)


def _shown(log: DataFrame) -> DataFrame:
    return log.select("key", "seq", codec.text(F.col("value")).alias("value"))


def _rows(spark, names: str, rows) -> DataFrame:
    """A few rows (names and types) as a relation of the JVM's: no Python worker has to make them."""
    kinds = [n.split() for n in names.split(", ")]
    each = [F.struct(*[F.lit(v).cast(kind).alias(n) for (n, kind), v in zip(kinds, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


# Reads


@query(f"select key, seq, value from {newest_sql()} where {LIVE_SQL}")
def latest_visible(spark, d):
    return _shown(reads.latest_visible(_log(spark, d), NOW))


@query(f"select key, seq, value from {newest_sql('seq <= 500')} where {LIVE_SQL}")
def latest_visible_snapshot(spark, d):
    return _shown(reads.latest_visible(_log(spark, d), NOW, 500))


@query(f"select key, seq, value from {newest_sql(chr(34) + 'key' + chr(34) + ' = ' + repr('user:00007'))} where {LIVE_SQL}")
def get_point(spark, d):
    return _shown(reads.get(_log(spark, d), "user:00007", NOW))


@query(f"select key, seq, value from {newest_sql('key = ' + repr('user:00007') + ' and seq <= 300')} where {LIVE_SQL}")
def get_snapshot(spark, d):
    return _shown(reads.get(_log(spark, d), "user:00007", NOW, 300))


@query(f"""with req as (select 'user:' || lpad(o_custkey::varchar, 5, '0') key, o_orderkey snapshot from orders),
seen as (select r.key, r.snapshot, max(l.seq) seq from req r left join log l on l.key = r.key and l.seq <= r.snapshot group by all)
select s.key, s.snapshot, case when {LIVE_SQL} then l.seq end seq, case when {LIVE_SQL} then l.value end as value
from (select key, snapshot, count(*) n from req group by all) c join seen s using (key, snapshot) left join log l on l.key = s.key and l.seq = s.seq, unnest(range(c.n))""")
def get_many_snapshots(spark, d):
    o = oplog.table(spark, d, "orders")
    asked = o.select(F.concat(F.lit("user:"), F.lpad(F.col("o_custkey").cast("string"), 5, "0")).alias("key"), F.col("o_orderkey").alias("snapshot"))
    return reads.get_as_of(_log(spark, d), asked, NOW).withColumn("value", codec.text(F.col("value")))


@query(f"select key, seq, value from {newest_sql('key between ' + repr('user:00010') + ' and ' + repr('user:00090'))} where {LIVE_SQL}")
def scan_range(spark, d):
    return _shown(reads.scan(_log(spark, d), "user:00010", "user:00090", None, NOW))


@query(f"select key, seq, value from {newest_sql()} where {LIVE_SQL} order by key limit 20")
def scan_limit(spark, d):
    return _shown(reads.scan(_log(spark, d), "user:", "user:￿", 20, NOW))


@query(f"select key, seq, value from {newest_sql('seq <= 700')} where {LIVE_SQL} and key between 'user:00005' and 'user:00050' order by key limit 15")
def scan_snapshot(spark, d):
    return _shown(reads.scan(_log(spark, d), "user:00005", "user:00050", 15, NOW, 700))


@query(f"select key, seq, value from {newest_sql()} where {LIVE_SQL} and starts_with(key, 'user:0001') order by key limit 100")
def prefix_scan(spark, d):
    return _shown(reads.prefix_scan(_log(spark, d), "user:0001", 100, NOW))


@query(f"select key from {newest_sql()} where {LIVE_SQL} order by key limit 1000")
def keys_all(spark, d):
    return reads.keys(_log(spark, d), "*", NOW)


@query(f"select key from {newest_sql()} where {LIVE_SQL} and starts_with(key, 'user:0000') order by key limit 1000")
def keys_prefix(spark, d):
    return reads.keys(_log(spark, d), "user:0000*", NOW)


@query(f"select key from {newest_sql()} where {LIVE_SQL} and key = 'user:00003'")
def keys_exact(spark, d):
    return reads.keys(_log(spark, d), "user:00003", NOW)


@query(f"select key, seq, expire_at_ms from {newest_sql()} where expire_at_ms > 0 and expire_at_ms <= {NOW} and vtype = 1")
def ttl_expired(spark, d):
    return reads.latest(_log(spark, d)).where((F.col("vtype") == PUT) & reads.expired(NOW)).select("key", "seq", "expire_at_ms")


@query("select seq, expire_at_ms > 0 and expire_at_ms <= expire_at_ms at_moment, expire_at_ms > 0 and expire_at_ms <= expire_at_ms - 1 just_before from log")
def ttl_boundary(spark, d):
    at = F.col("expire_at_ms")
    return _log(spark, d).select("seq", reads.expired(at).alias("at_moment"), reads.expired(at - 1).alias("just_before"))


@query(f"select key, seq from {newest_sql()} where vtype = 2")
def tombstones(spark, d):
    return reads.latest(_log(spark, d)).where("vtype = 2").select("key", "seq")


@query(f"""with h as (select key, case when vtype = 2 then 'delete' else 'expiry' end "by" from {newest_sql()} where not ({LIVE_SQL}))
select h.key, h."by", count(l.seq) puts from h left join log l on l.key = h.key and l.vtype = 1 group by all""")
def hidden_versions(spark, d):
    return reads.hidden(_log(spark, d), NOW)


@query("""select l_partkey, max(seq) seq, arg_max(l_quantity, seq) quantity, arg_max(l_extendedprice, seq) price
from (select *, l_orderkey * 1000000000 + l_linenumber * 100000 + l_suppkey seq from lineitem) group by 1""", log=False)
def lineitem_latest(spark, d):
    """The newest line of each part: payloads of fixed width combine in a hash aggregate before the shuffle."""
    seq = F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")
    log = oplog.table(spark, d, "lineitem").select("l_partkey", seq.alias("seq"), "l_quantity", "l_extendedprice")
    return log.groupBy("l_partkey").agg(F.max("seq").alias("seq"), F.max_by("l_quantity", "seq").alias("quantity"), F.max_by("l_extendedprice", "seq").alias("price"))


# Several keys

ASKED = [(i, f"user:{k:05d}") for i, k in enumerate([3, 7, 7, 99999, 12, 3, 55, 140])]
ASKED_SQL = "with req(ord, key) as (values " + ", ".join(f"({i}, '{k}')" for i, k in ASKED) + f"), v as (select key, value from {newest_sql()} where {LIVE_SQL})"


@query(f"{ASKED_SQL} select ord, key, coalesce(value, '(nil)') as value from req left join v using (key)")
def mget(spark, d):
    return reads.mget(_log(spark, d), _rows(spark, "ord int, key string", ASKED), NOW)


@query(f"{ASKED_SQL} select count(*) n from req join v using (key)")
def exists_count(spark, d):
    return reads.exists_count(_log(spark, d), _rows(spark, "ord int, key string", ASKED), NOW)


@query(f"{ASKED_SQL} select count(distinct key) n from req join v using (key)")
def del_count(spark, d):
    return reads.delete_present(_log(spark, d), _rows(spark, "ord int, key string", ASKED), NOW).agg(F.count("*").alias("n"))


# Maintenance


@query(f"select key, seq, vtype::int vtype, value from {newest_sql()}")
def compact_keep(spark, d):
    return compaction.compact(_log(spark, d), NOW, purge=False).select("key", "seq", F.col("vtype").cast("int").alias("vtype"), codec.text(F.col("value")).alias("value"))


@query(f"select key, seq, value from {newest_sql()} where {LIVE_SQL}")
def compact_purge(spark, d):
    return _shown(compaction.compact(_log(spark, d), NOW))


@query(f"select count(*) input, (select count(*) from {newest_sql()} where {LIVE_SQL}) output from log")
def compact_output_count(spark, d):
    log = _log(spark, d)
    return log.agg(F.count("*").alias("input")).join(F.broadcast(compaction.compact(log, NOW).agg(F.count("*").alias("output"))))


@query(f"select key, seq from log where seq >= 600 union all select key, seq from {newest_sql('seq < 600')} where {LIVE_SQL}")
def compact_retain(spark, d):
    return compaction.compact(_log(spark, d), NOW, retain_from_seq=600).select("key", "seq")


@query("""select seq, case when vtype = 2 then 'DELETE' else 'PUT' end "type", key, coalesce(strlen(value), 0)::int value_size, expire_at_ms from log order by seq desc limit 20""")
def wal_tail(spark, d):
    return stats.wal_tail(_log(spark, d), 20)


@query("select key, seq from log where seq > 400")
def wal_replay(spark, d):
    return compaction.replay(_log(spark, d), 400).select("key", "seq")


@query("select count(*) filter (seq > 400) applied, greatest(max(seq), 400) max_seq from log")
def recover_max_seq(spark, d):
    return compaction.replay_summary(_log(spark, d), 400)


FILES_SQL = "(select 0 level, (seq - 1) // 1000 + 1 file_id, min(key) min_key, max(key) max_key, min(seq) min_seq, max(seq) max_seq, count(*) entries from log group by 1, 2)"


@query(f"select * from {FILES_SQL}")
def flush_file_meta(spark, d):
    return compaction.file_metadata(oplog.with_files(_log(spark, d)))


@query(f"""select level, file_id, 'fileId=' || file_id || ', level=0, file=sst-' || file_id || '-L0.sst, bloom=sst-' || file_id || '-L0.sst.bf, keyRange=' || min_key || '..' || max_key || ', seqRange=' || min_seq || '..' || max_seq || ', entries=' || entries line from {FILES_SQL}""")
def sst_dump(spark, d):
    return compaction.sst_dump(oplog.with_files(_log(spark, d)))


@query(f"""with c as (select count(*) writes, count(*) filter (vtype = 2) deletes from log), p as (select count(*) entries from {newest_sql()} where {LIVE_SQL})
select writes, deletes, (writes + 500) / writes write_amplification, 300 / 100 read_amplification, entries / greatest(1, writes - deletes) space_amplification from c, p""")
def amplification(spark, d):
    log = _log(spark, d)
    return stats.amplification(log, compaction.compact(log, NOW), compaction_input=500, probes=300, reads=100)


# Numbers, lists, sets and hashes


@query("select 'n:' || user_id key, sum(case when event_type = 'error' then -1 else 1 end)::bigint as value from events group by user_id", log=False)
def incr_fold(spark, d):
    e = oplog.table(spark, d, "events")
    by = F.when(F.col("event_type") == "error", -1).otherwise(1).cast("long")
    return col.fold_counters(e.select(F.concat(F.lit("n:"), F.col("user_id").cast("string")).alias("key"), by.alias("by")))


TEXTS = ["5", "+5", "-7", " 5 ", "5.0", "", "abc", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "٣"]


@query("with t(i, s) as (values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(TEXTS)) + r"), p as (select i, s, case when regexp_full_match(s, '[+-]?[0-9]+') then try_cast(s as bigint) end n from t) select i, s, n, case when n < 9223372036854775807 then n + 1 end incr from p", log=False)
def incr_parse(spark, d):
    t = _rows(spark, "i int, s string", list(enumerate(TEXTS)))
    return t.select("i", "s", numbers.parse_long(F.col("s")).alias("n"), numbers.step(F.col("s"), 1).alias("incr"))


CONV_SQL = "select 'conv:' || conv_id key, list(role || '/' || turn order by turn, role) l from conversations group by 1"


def _lists(spark, d):
    return col.fold_lists(oplog.conversation_pushes(spark, d))


@query(f"select key, array_to_string(l, ' ') items, len(l)::int llen from ({CONV_SQL})", log=False)
def list_rpush(spark, d):
    return _lists(spark, d).select("key", F.array_join("items", " ").alias("items"), F.size("items").alias("llen"))


@query(f"select key, array_to_string(list_reverse(l), ' ') items from ({CONV_SQL})", log=False)
def list_lpush(spark, d):
    empty = F.array().cast("array<string>")
    return _lists(spark, d).select("key", F.array_join(col.push_left(empty, F.col("items")), " ").alias("items"))


@query(f"select key, array_to_string(l[-2:], ' ') tail, array_to_string(l[1:3], ' ') head, '' nothing, array_to_string(l, ' ') whole from ({CONV_SQL})", log=False)
def lrange(spark, d):
    ranges = {"tail": (-2, -1), "head": (0, 2), "nothing": (5, 2), "whole": (-1000, 1000)}
    return _lists(spark, d).select("key", *[F.array_join(col.list_range(F.col("items"), a, b), " ").alias(n) for n, (a, b) in ranges.items()])


@query(f"select key, l[1] lpop, l[-1] rpop, array_to_string(l[2:], ' ') after_lpop, array_to_string(l[:len(l) - 1], ' ') after_rpop from ({CONV_SQL})", log=False)
def list_pops(spark, d):
    (left, rest), (right, front) = col.pop_left(F.col("items")), col.pop_right(F.col("items"))
    return _lists(spark, d).select("key", left.alias("lpop"), right.alias("rpop"), F.array_join(rest, " ").alias("after_lpop"), F.array_join(front, " ").alias("after_rpop"))


@query("""with o as (select 'list:' || user_id key, event_id, [case event_type when 'error' then 'lpop' when 'signup' then 'rpop' when 'view' then 'lpush' else 'rpush' end, event_id::varchar] op from events)
select key, array_to_string(list_reduce(list_prepend([]::varchar[], list(op order by event_id)), lambda a, s: case s[1] when 'rpush' then list_append(a, s[2]) when 'lpush' then list_prepend(s[2], a) when 'lpop' then a[2:] else a[:len(a) - 1] end), ' ') items
from o group by key""", log=False)
def list_fold_with_pops(spark, d):
    e = oplog.table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "lpop").when(F.col("event_type") == "signup", "rpop").when(F.col("event_type") == "view", "lpush").otherwise("rpush")
    ops = e.select(F.concat(F.lit("list:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("string").alias("arg"))
    return col.fold_lists(ops).select("key", F.array_join("items", " ").alias("items"))


SETS_SQL = """with o as (select 'types:' || user_id key, event_id seq, case when event_type = 'error' then 'srem' else 'sadd' end op, case when event_type = 'error' then 'click' else event_type end member from events),
l as (select key, member, arg_max(op, seq) op from o group by all), s as (select key, list(member order by member) filter (op = 'sadd') m from l group by key)"""


@query(f"{SETS_SQL} select key, coalesce(array_to_string(m, ' '), '') members, coalesce(len(m), 0)::int scard, coalesce(list_contains(m, 'view'), false) sismember from s", log=False)
def set_fold(spark, d):
    folded = col.fold_sets(oplog.event_members(spark, d))
    return folded.select("key", F.array_join("members", " ").alias("members"), F.size("members").alias("scard"), F.array_contains("members", "view").alias("sismember"))


@query("select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') members, array_to_string(list_sort(list_filter(list_distinct(list(o_orderpriority)), lambda x: x <> '1-URGENT')), ', ') after_srem from orders group by 1", log=False)
def set_members(spark, d):
    members = F.array_sort(F.collect_set("o_orderpriority"))
    g = oplog.table(spark, d, "orders").groupBy("o_custkey").agg(members.alias("m"))
    return g.select("o_custkey", F.array_join("m", ", ").alias("members"), F.array_join(col.remove_members(F.col("m"), F.array(F.lit("1-URGENT"))), ", ").alias("after_srem"))


HASH_SQL = """with o as (select 'last:' || user_id key, event_id seq, case when event_type = 'error' then 'hdel' else 'hset' end op, case when event_type = 'error' then 'view' else event_type end field, props from events),
h as (select key, field, arg_max(op, seq) op, arg_max(props, seq) as value from o group by all)"""


def _fields(spark, d):
    return col.fold_hashes(oplog.event_fields(spark, d).withColumnRenamed("props", "value"))


@query(f"{HASH_SQL} select key, field, value from h where op = 'hset'", log=False)
def hash_fold(spark, d):
    return _fields(spark, d)


@query(f"{HASH_SQL} select key, count(*) hlen, string_agg(field || '=' || value, ',' order by field) hgetall, max(case when field = 'click' then value end) hget, bool_or(field = 'purchase') hexists from h where op = 'hset' group by key", log=False)
def hash_read(spark, d):
    pair = F.concat_ws("=", "field", "value")
    return _fields(spark, d).groupBy("key").agg(F.count("*").alias("hlen"), F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("hgetall"), F.max(F.when(F.col("field") == "click", F.col("value"))).alias("hget"), F.bool_or(F.col("field") == "purchase").alias("hexists"))


@query("select doc_id, '__sksp:list__:' || to_base64(encode(lang)) || ',' || to_base64(encode(coalesce(text, ''))) encoded, lang || '|' || coalesce(text, '') decoded, 'list' kind from documents", log=False)
def token_codec(spark, d):
    docs = oplog.table(spark, d, "documents")
    value = codec.encode_items(F.array("lang", F.coalesce("text", F.lit(""))), "list")
    return docs.select("doc_id", value.alias("v")).select("doc_id", codec.text(F.col("v")).alias("encoded"), F.array_join(codec.decode_items(F.col("v"), "list"), "|").alias("decoded"), codec.kind(F.col("v")).alias("kind"))


@query(f"""with t(key, kind) as (values ('a', 'string'), ('b', 'list'), ('c', 'set'), ('d', 'hash'), ('e', 'none')) select key, kind, kind in ('list', 'set', 'hash') get_fails, kind not in ('list', 'none') push_fails from t""", log=False)
def type_guard(spark, d):
    one = F.array(F.lit("x"))
    values = {"a": F.encode(F.lit("plain"), "UTF-8"), "b": codec.encode_items(one, "list"), "c": codec.encode_items(one, "set"), "d": codec.encode_hash(F.create_map(F.lit("f"), F.lit("v"))), "e": F.lit(None).cast("binary")}
    pick = F.lit(None).cast("binary")
    for k, v in values.items():
        pick = F.when(F.col("key") == k, v).otherwise(pick)
    rows = _rows(spark, "key string", [(k,) for k in values]).withColumn("v", pick)
    kind = codec.kind(F.col("v"))
    return rows.select("key", kind.alias("kind"), kind.isin("list", "set", "hash").alias("get_fails"), codec.decode_items(F.col("v"), "list").isNull().alias("push_fails"))


# Bloom filters

FNV_SQL = "list_reduce(list_prepend({seed}::bigint, list_transform(range(1, strlen(key) + 1), lambda i: ascii(key[i])::bigint)), lambda h, x: ((xor(h, x)) * 16777619) & 4294967295)"
H1, H2 = FNV_SQL.format(seed=bloom.SEED_1), FNV_SQL.format(seed=bloom.SEED_2)
DISTINCT_SQL = "with k as (select distinct key from log)"
BITS, HASHES = 2000, 7


@query(f"{DISTINCT_SQL} select key, {H1} h1, {H2} h2 from k")
def fnv1a(spark, d):
    keys = _log(spark, d).select("key").distinct()
    return keys.select("key", bloom.fnv1a32(F.col("key")).alias("h1"), bloom.fnv1a32(F.col("key"), bloom.SEED_2).alias("h2"))


BITS_SQL = f"(select distinct ((h1 + i * h2) & {bloom.MAX_LONG}) % {BITS} bit from (select {H1} h1, {H2} h2 from k), range({HASHES}) t(i))"


@query(f"{DISTINCT_SQL} select bit from {BITS_SQL}")
def bloom_bits(spark, d):
    return bloom.build(_log(spark, d).select("key").distinct(), BITS, HASHES)


@query(f"""{DISTINCT_SQL}, b as (select bit from {BITS_SQL}), p as (select 'user:' || lpad(o_custkey::varchar, 5, '0') key from orders group by 1)
select key, count(b.bit) = count(*) might_contain from (select distinct key, ((h1 + i * h2) & {bloom.MAX_LONG}) % {BITS} bit from (select key, {H1} h1, {H2} h2 from p), range({HASHES}) t(i)) x left join b using (bit) group by key""")
def bloom_probe(spark, d):
    asked = oplog.table(spark, d, "orders").select(F.concat(F.lit("user:"), F.lpad(F.col("o_custkey").cast("string"), 5, "0")).alias("key"))
    return bloom.probe(asked, bloom.build(_log(spark, d).select("key").distinct(), BITS, HASHES), BITS, HASHES)


@query("select " + ", ".join(f"greatest(1, ceil(-ln({p}) / (ln(2) * ln(2))))::int b{i}" for i, p in enumerate((0.01, 0.001, 0.5, 0.99))), log=False)
def bloom_sizing(spark, d):
    return spark.range(1).select(*[F.lit(numbers.bloom_bits_per_key(p)).alias(f"b{i}") for i, p in enumerate((0.01, 0.001, 0.5, 0.99))])


# Batches


@query("""select event_id ord, case when event_id % 7 = 0 then 'key must not be empty' when event_type <> 'error' and event_id % 5 = 0 then 'value must not be null' end fault from events
where event_id % 7 = 0 or (event_type <> 'error' and event_id % 5 = 0)""", log=False)
def batch_validate(spark, d):
    log = _log(spark, d)
    ord_ = F.col("seq") - 1
    ops = log.select(ord_.alias("ord"), "vtype", F.when(ord_ % 7 == 0, "").otherwise(F.col("key")).alias("key"), F.when(ord_ % 5 != 0, F.col("value")).alias("value"), "expire_at_ms")
    return writes.faults(ops).select("ord", "fault")


@query("select key, 1000 + row_number() over (order by seq desc) seq from log")
def batch_seq(spark, d):
    ops = _log(spark, d).select((-F.col("seq")).alias("ord"), "vtype", "key", "value", "expire_at_ms")
    return writes.sequenced(ops, 1000).select("key", "seq")


@query("select i, k from (values (1, 'a'), (2, 'b'), (3, 'é'), (4, '\U0001F600'), (5, '')) t(i, k)", log=False)
def key_order(spark, d):
    keys = ["", "b", "\U0001F600", "a", "é"]
    from pyspark.sql import Window

    return _rows(spark, "k string", [(k,) for k in keys]).select(F.row_number().over(Window.orderBy(sort_key(F.col("k")))).alias("i"), "k")
