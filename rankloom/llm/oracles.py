"""The queries that SQL can express, stated in DuckDB's SQL from their definitions."""

from __future__ import annotations

from rankloom.llm.secret_scan import MORE
from rankloom.llm.sharding import SHARD_BYTES

ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op2_decontamination"] = rf"""
with doc as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item as (
  select item_id, w, least(13, len(w)) as k from (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark) where len(w) > 0),
item_window as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from item)),
width as (select distinct k from item),
doc_window as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, width where len(w) >= k)),
found as (
  select r, d.k, i, item_id from doc_window d join item_window p on d.k = p.k and d.phrase = p.phrase),
hit as (
  select r, count(distinct place) as n_hit
  from (select r, unnest(range(i, i + k)) as place from (select distinct r, i, k from found)) group by r),
named as (
  select r, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct r, cast(item_id as varchar) as name from found) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (r) left join named using (r)
"""


ORACLES["op9_repeated_phrases"] = r"""
with doc as (
  select row_number() over (order by doc_id, text) as r,
    doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
start as (
  select r, i, array_to_string(w[i:i + 19], ' ') as phrase
  from (select r, w, unnest(range(1, len(w) - 18)) as i from doc where len(w) >= 20)),
again as (select r, i from (select r, i, row_number() over (partition by phrase order by r, i) as nth from start) where nth > 1),
gone as (select distinct r, place from (select r, unnest(range(i, i + 20)) as place from again)),
word as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from doc),
kept as (
  select r, count(*) as n_kept, string_agg(word, ' ' order by place) as text
  from word anti join gone using (r, place) group by r)
select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from doc left join kept using (r)
"""


def sharding_sql(limit: int, depths: int = 24) -> str:
    """Sums over every prefix; a row is in the shortest prefix that fits (ids do not repeat)."""
    return f"""
with doc as (
  select doc_id, strlen(coalesce(text, '')) as n_bytes,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h
  from documents),
level as (select doc_id, n_bytes, h >> (60 - d) as prefix, d from doc, range({depths}) as t(d)),
total as (select d, prefix from level group by d, prefix having sum(n_bytes) <= {limit} or count(*) = 1),
least_depth as (select doc_id, n_bytes, min(d) as depth from level join total using (d, prefix) group by doc_id, n_bytes)
select doc_id, n_bytes, array_to_string([((h >> (60 - i)) & 1)::varchar for i in range(1, depth + 1)], '') as shard, depth::int as depth
from least_depth join (select doc_id, h from doc) using (doc_id)
"""


ORACLES["op5_sharding"] = sharding_sql(SHARD_BYTES)


def secret_sql() -> str:
    """Matches by kind; their places from the lengths of what lies between them."""
    kinds = [
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", None),
        ("access", "AKIA[A-Z0-9]+", 16),
        ("hex", "[0-9a-f]{32,}", 32),  # runs are maximal, so the least length may stand in the pattern
    ] + [(r.kind, r.pattern, r.least) for r in MORE]
    value = r"""^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?"""
    parts = []
    for number, (kind, pattern, least) in enumerate(kinds):
        keep = f"len(regexp_replace(m, '{value}', '')) >= 8" if least is None else f"len(m) >= {least}"
        parts.append(f"""
  select r, {number} as kind_number, '{kind}' as kind, start, start + len(m) as stop from (
    select r, unnest(ms) as m, unnest([list_sum([len(x) for x in pieces[1:i]]) + coalesce(list_sum([len(x) for x in ms[1:i - 1]]), 0) for i in range(1, len(ms) + 1)])::bigint as start
    from (select r, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as pieces from doc))
  where {keep}""")
    return f"""
with doc as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
span as ({' union all '.join(parts)}),
total as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_number) filter (kind_number < 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_number) as spans
  from span group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from doc left join total using (r)
"""


ORACLES["op8_secret_scan"] = secret_sql()


ORACLES["op11_filter_audit"] = r"""
with doc as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
label as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 100 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
    || case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when coalesce(min(doc_id) over (partition by t) < doc_id, false) then 'E' else '' end as fails
  from doc left join label using (doc_id)),
mask as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failed group by part, fails),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone as (
  select part, filter_order, fails, n, good, toxic,
    coalesce(list_min([instr(filter_order, fails[i]) for i in range(1, length(fails) + 1)]), 9) as place
  from mask, orders),
step as (
  select part, filter_order, step, filter_order[step] as own,
    coalesce(sum(n) filter (place > step), 0) as kept, coalesce(sum(n) filter (place = step), 0) as removed,
    coalesce(sum(n) filter (place < step and contains(fails, filter_order[step])), 0) as redundant,
    coalesce(sum(n) filter (fails = filter_order[step]), 0) as unique_fails,
    coalesce(sum(good) filter (place = step), 0) as good_lost, coalesce(sum(toxic) filter (place = step), 0) as toxic_lost
  from gone, (select unnest([1, 2, 3, 4, 5]) as step) group by part, filter_order, step)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley
from step
"""


def cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round as a table of its own: assignments over all pairs of vector and centroid."""
    parts = [
        f"""kept as materialized (
  select row_number() over () as r, vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64),
comp as materialized (select r, unnest(v) as x, unnest(range(1, 65)) as i from kept),
c0 as materialized (
  select (row_number() over (order by h)) - 1 as cluster, unnest(v) as x, unnest(range(1, 65)) as i
  from (select sha256('2:' || vec_id) as h, v from kept order by h limit {k}))"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""d{n} as materialized (
  select r, cluster, sum((p.x - c.x) * (p.x - c.x))::bigint as distance from comp p join c{n} c using (i) group by r, cluster),
a{n} as materialized (select r, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d{n} group by r)""")
        if n < rounds:
            parts.append(f"""c{n + 1} as materialized (
  select c.cluster, i, coalesce((s - ((s % n) + n) % n) // n, c.x)::bigint as x
  from c{n} c left join (
    select cluster, i, sum(x)::bigint as s, count(*) as n from comp join a{n} using (r) group by cluster, i) using (cluster, i))""")
    return f"""
with {", ".join(parts)},
named as (select cluster, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by cluster)
select vec_id, cluster::integer as cluster, distance,
  (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256
from a{rounds} join kept using (r) join named using (cluster)
"""


ORACLES["op12_centroids"] = cluster_sql()
