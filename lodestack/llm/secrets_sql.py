"""SQL (DuckDB) for the rows of the secret scan."""

from __future__ import annotations

from lodestack.llm.secrets import ACCESS, ASSIGN, HEX, TOKEN


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, group: int) -> str:
    """Matches with their offsets: lengths of the pieces between them and of the matches before."""
    p = _quote(pattern)
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
    start = f"({total(f'regexp_split_to_array(t, {p})[1:i]')} + {total(f'regexp_extract_all(t, {p})[1:i - 1]')})::bigint"
    return f"list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{'s': {start}, 'k': {kind}, 'e': {start} + length(regexp_extract_all(t, {p})[i]), 'v': regexp_extract_all(t, {p}, {group})[i]}})"


_TOLD = "array_to_string(list_transform({}, lambda x: ['assign', 'access', 'hex', 'token'][x.k + 1] || ':' || x.s || ':' || x.e), ',')"

ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as owner, concat_ws('/', source, lang) as repo from documents),
b as (select rid, doc_id, owner, repo, t, list_filter({_spans(0, ASSIGN, 2)}, lambda x: length(x.v) >= 8) || {_spans(1, ACCESS, 0)} || {_spans(2, HEX, 0)} as base,
 list_filter({_spans(3, TOKEN, 0)}, lambda x: regexp_matches(x.v, '[0-9]') and regexp_matches(x.v, '[A-Za-z]') and len(list_distinct(regexp_extract_all(x.v, '.'))) >= 10) as token from d),
f as (select rid, owner, repo, unnest(base || list_filter(token, lambda x: len(list_filter(base, lambda y: y.s < x.e and x.s < y.e)) = 0)) as x from b),
h as (select rid, owner, repo, x.s as s, x.k as k, x.e as e, sha256(x.v) as h from f),
st as (select h, count(distinct owner) as owners, count(distinct owner || chr(1) || repo) as repos from h group by h),
j as (select rid, s, k, e, owners <= 1 and repos <= 2 as live, owners >= 3 as example from h join st using (h) where k < 3 or (owners <= 1 and repos <= 2)),
g as (select rid, list_sort(list({{'s': s, 'k': k, 'e': e}})) as spans, count(*) filter (live) as n_live, count(*) filter (example) as n_example from j group by rid),
r as (select d.doc_id, coalesce(g.spans, []) as spans, coalesce(g.n_live, 0) as n_live, coalesce(g.n_example, 0) as n_example from d left join g using (rid))
select doc_id, len(list_filter(spans, lambda x: x.k = 0))::bigint as n_assign, len(list_filter(spans, lambda x: x.k = 1))::bigint as n_access, len(list_filter(spans, lambda x: x.k = 2))::bigint as n_hex,
 sha256(coalesce({_TOLD.format("list_filter(spans, lambda x: x.k < 3)")}, '')) as base_sha256, coalesce({_TOLD.format("spans")}, '') as spans, len(list_filter(spans, lambda x: x.k = 3))::bigint as n_token, n_live, n_example from r
"""
