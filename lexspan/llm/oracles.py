"""DuckDB SQL that states what some of the queries return, by plain means."""

from lexspan.llm import secret_scan, url_filter


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOP_K = """
with vectors as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored as (
    select a.vec_id as query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint as score
    from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0
), ranked as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

URL_FILTER = f"""
with seen as (
    select page_id, url, to_timestamp({{start}} + page_id * 60)::timestamp as fetched_at,
           lower(regexp_extract(url, {_quoted(url_filter.AUTHORITY)}, 1)) as host,
           list_filter(string_split(regexp_extract(url, {_quoted(url_filter.PATH)}, 1), '/'), lambda x: x <> '') as parts
    from pages
), reports as (
    select case page_id // 10 % 3 when 0 then host when 1 then regexp_extract(host, '([^.]+[.][^.]+)$', 1)
                else host || '/' || regexp_extract(url, '^[^/]*//[^/]*/([^/?#]*)', 1) || '/' end as pattern,
           ['block', 'allow', 'remove', 'block'][(page_id // 30 % 4)::int + 1] as action, fetched_at as listed_at
    from seen where page_id % 10 = 3
), settled as (
    select pattern, listed_at, ['remove', 'allow', 'block'][max(list_position(['remove', 'allow', 'block'], action))] as action
    from reports group by all
), could as (
    select page_id, array_to_string(list_slice(string_split(host, '.'), -k, -1), '.') as pattern, k as weight
    from (select page_id, host, unnest(range(1, len(string_split(host, '.')) + 1)) as k from seen)
    union all
    select page_id, host || '/' || array_to_string(list_slice(parts, 1, k), '/') || '/', 1000 + k
    from (select page_id, host, parts, unnest(range(1, len(parts) + 1)) as k from seen)
), active as (
    select page_id, c.pattern, c.weight, s.listed_at, s.action
    from could c join seen using (page_id) join settled s on s.pattern = c.pattern and s.listed_at <= fetched_at
    qualify row_number() over (partition by page_id, c.pattern order by s.listed_at desc) = 1
), best as (
    select * from active where action <> 'remove' qualify row_number() over (partition by page_id order by weight desc) = 1
)
select seen.page_id, seen.url, fetched_at, host, coalesce(action, 'none') as action, pattern, listed_at
from seen left join best using (page_id)
"""


def _located(kind: int, pattern: str, source: str) -> str:
    """Rows doc_id, kind, s, e, v: the matches of a pattern."""
    return f"""
    select doc_id, {kind} as kind, s, s + length(v) as e, v from (
        select doc_id, v, (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0))::int as s
        from (select doc_id, found, gaps, unnest(found) as v, unnest(range(1, len(found) + 1)) as i
              from (select doc_id, regexp_extract_all(t, {_quoted(pattern)}) as found, string_split_regex(t, {_quoted(pattern)}) as gaps from {source})))"""


_KNOWN = ", ".join(_quoted(c) for c in secret_scan.ALPHABET)
_VALUE = f"regexp_extract(v, {_quoted(secret_scan.ASSIGN)}, 2)"

SECRETS = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
base as (
    select * from ({_located(0, secret_scan.ASSIGN, 'docs')}) where length({_VALUE}) >= {secret_scan.LEAST_ASSIGN}
    union all select * from ({_located(1, secret_scan.ACCESS, 'docs')}) where length(v) >= {secret_scan.LEAST_ACCESS}
    union all select * from ({_located(2, secret_scan.HEX, 'docs')}) where length(v) >= {secret_scan.LEAST_HEX}
), picked as (
    select * from docs, (select count(*) as n from docs)
    where n <= {secret_scan.SAMPLE} or substr(md5(coalesce(doc_id::varchar, '')), 1, 8) < printf('%08x', {secret_scan.SAMPLE} * (1::bigint << 32) // n)
), found as (
    select doc_id, case kind when 0 then {_VALUE} else v end as v from base where doc_id in (select doc_id from picked)
    union all select doc_id, sha256(t) from picked
    union all select doc_id, rtrim(to_base64(unhex(sha256(t))), '=') from picked
), samples as (
    select 'random' as kind, v from found union all select 'random', upper(v) from found
    union all
    select 'plain', v from (select distinct doc_id, unnest(regexp_extract_all(t, {_quoted(secret_scan.SAMPLE_RUN)})) as v from picked) o
    where not exists (select 1 from found f where f.doc_id = o.doc_id and f.v = o.v)
), pairs as (
    select kind, substring(v, i, 2) as pair from (select kind, v, unnest(range(1, length(v))) as i from samples)
), counts as (
    select pair, pair[1] as first, count(*) filter (kind = 'random') as r, count(*) filter (kind = 'plain') as p
    from pairs where pair[1] in ({_KNOWN}) and pair[2] in ({_KNOWN}) group by pair
), model as (
    select pair, round(1000 * ln(((r + 0.5) / (rt + 0.5 * {len(secret_scan.ALPHABET)})) / ((p + 0.5) / (pt + 0.5 * {len(secret_scan.ALPHABET)}))))::int as score
    from counts join (select first, sum(r)::double as rt, sum(p)::double as pt from counts group by first) using (first)
), runs as (
    select * from ({_located(3, secret_scan.RUN, 'docs')}) r
    where not exists (select 1 from base b where b.doc_id = r.doc_id and b.s < r.e and r.s < b.e)
), added as (
    select r.doc_id, r.kind, r.s, r.e, r.v
    from (select *, unnest(range(1, length(v))) as i from runs) r left join model on model.pair = substring(r.v, r.i, 2)
    group by all having coalesce(sum(score), 0) >= {secret_scan.THRESHOLD} * (length(r.v) - 1)
), spans as (
    select doc_id, kind, s, e, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || s || ':' || e as said
    from (select doc_id, kind, s, e from base union all select doc_id, kind, s, e from added)
), told as (
    select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
           string_agg(said, ',' order by s, kind) filter (kind < 3) as base, string_agg(said, ',' order by s, kind) as spans
    from spans group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join told using (doc_id)
"""

#: Groups of texts that are equal once A to Z are lower-cased.
EXACT_DEDUP = """
    with hashed as (
        select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
        from documents
    ),
    grouped as (
        select text_sha256, max(doc_id) as keep_id, count(*) as group_size from hashed group by text_sha256
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
    from hashed join grouped using (text_sha256)
"""
