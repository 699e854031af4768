"""SQL (DuckDB) for the rows of the importance resampling."""

from __future__ import annotations

from lodestack.llm.importance import LOWER, TERM, UPPER

_STEP = "list_reduce(list_prepend({n}, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"

#: crc32 is a fold over a word's bytes by a table of 256 values, itself folded from the polynomial; each distinct word is hashed once.
ORACLE = f"""
with crc as (select list({_STEP.format(n="n")} order by n) as tab from (select unnest(range(256)) as n)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ws from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ws from benchmark),
dw as (select rid, unnest(ws) as w from d), bw as (select unnest(ws) as w from b),
every as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
code as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as code from every, crc),
s as (select code, count(*) as s from dw join code using (w) group by code), t as (select code, count(*) as t from bw join code using (w) group by code),
st as (select code, coalesce(s, 0)::double as s, coalesce(t, 0)::double as t, sum(coalesce(s, 0)) over ()::double as all_s, sum(coalesce(t, 0)) over ()::double as all_t from s full join t using (code)),
gain as (select code, floor(1000.0 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::bigint as gain from st),
g as (select rid, sum(gain)::bigint as gain, count(*) as n from dw join code using (w) join gain using (code) group by rid),
w as (select rid, doc_id, coalesce(n, 0)::bigint as n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join g using (rid)),
sc as (select rid, doc_id, n_features, weight, weight + floor(-1000.0 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from w),
r as (select *, row_number() over (order by n_features >= 20 desc, score desc, doc_id asc nulls last) as k, count(*) filter (n_features >= 20) over () as fits from sc)
select doc_id, n_features, weight, score, (case when n_features >= 20 and k <= 10 * fits // 100 then k end)::bigint as rank from r
"""
