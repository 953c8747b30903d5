"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
with items as (select item_id::varchar item, regexp_extract_all({lower("text")}, '{WORD}') w from benchmark),
windows as (
  select distinct item, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') win
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from items where len(w) > 0)),
docs as (select row_number() over () r, doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{WORD}') w from documents),
spans as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') win
  from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) i from docs, (select distinct n from windows) where len(w) >= n)),
hits as (select r, i, n, item from spans join windows using (n, win)),
marked as (select r, count(distinct p) n_hit from (select r, unnest(generate_series(i, i + n - 1)) p from (select distinct r, i, n from hits)) group by r),
named as (select r, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids from hits group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join marked using (r) left join named using (r)
"""

JACCARD = rf"""
with recursive words as (
  select row_number() over () r, doc_id, list_filter(regexp_split_to_array({lower("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) end s
  from words),
classes as (select s, min(doc_id) id, len(s) n from sets group by s),
grams as (select id, n, unnest(s) g from classes),
links as (
  select x.id a, y.id b from grams x join grams y on x.g = y.g and x.id <> y.id and 4 * x.n >= 3 * y.n and 4 * y.n >= 3 * x.n
  group by x.id, y.id, x.n, y.n having 7 * count(*) >= 3 * (x.n + y.n)),
reach(id, root) as (select id, id from classes where n > 0 union select l.b, reach.root from reach join links l on l.a = reach.id),
roots as (select id, min(root) root from reach group by id)
select sets.doc_id, len(sets.s)::bigint n_shingles, coalesce(root, sets.doc_id) component_id
from sets left join classes on classes.s = sets.s and len(sets.s) > 0 left join roots on roots.id = classes.id
"""

WARC = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
g as (select payload_digest, max(page_id) m from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
  case when m is not null and page_id is distinct from m then 'revisit' else 'response' end record_type,
  case when page_id is distinct from m then m end refers_to
from p left join g using (payload_digest)
"""


def urls(rules) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
with listed(h, p, v) as (values {listed}),
parts as (
  select row_number() over () r, page_id,
    coalesce({lower("regexp_extract(url, '://([^/?#]*)', 1)")}, '') host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path
  from pages),
best as (
  select r, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) verdict
  from parts join listed on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by r)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from parts left join best using (r)
"""


def secrets(rules, base_kinds) -> str:
    """Starts from the lengths of a rule's matches and of what lies between them."""
    parts = []
    for rank, r in enumerate(rules):
        quoted = r.pattern.replace("'", "''")
        parts.append(f"""
select r, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'kind': '{r.kind}', 'rank': {rank},
    'start': (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint,
    'size': length(m[i]), 'secret': length(s[i])}})) f
from (select r, regexp_extract_all(t, '{quoted}') m, regexp_extract_all(t, '{quoted}', {r.group}) s, string_split_regex(t, '{quoted}') b from docs)""")
    base = ", ".join(f"'{k}'" for k in base_kinds)
    counts = ", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in base_kinds)
    outer = ", ".join(f"coalesce(n_{k}, 0)::bigint n_{k}" for k in base_kinds)
    least = " or ".join(f"(kind = '{r.kind}' and secret >= {r.least})" for r in rules)
    return f"""
with docs as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
found as (select r, f.kind kind, f.rank rank, f.start start, f.start + f.size stop, f.secret secret from ({" union all ".join(parts)})),
kept as (select *, kind || ':' || start || ':' || stop span from found where {least}),
each as (
  select r, {counts}, string_agg(span, ',' order by start, rank) spans, string_agg(span, ',' order by start, rank) filter (kind in ({base})) base
  from kept group by r)
select doc_id, {outer}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from docs left join each using (r)
"""
