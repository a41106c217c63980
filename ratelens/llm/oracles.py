"""DuckDB SQL for the rows of those queries that SQL can express, over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_SPACE = r"[^\x20\x09-\x0D]+"

OP2 = f"""
with d as (select doc_id, {_words('text')} as w from documents), b as (select cast(item_id as varchar) as item, {_words('text')} as w from benchmark),
n as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as s from (select *, unnest(range(1, len(w) - n + 2)) as i from n)),
sizes as (select distinct n from windows),
p as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select doc_id, item, p.n as n, i from p join windows on windows.n = p.n and windows.s = p.s),
hit as (select doc_id, count(distinct i + k) as n_hit from m, range(10) as r(k) where k < n group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

OP4 = rf"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
many as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from windows) where n > 1),
rep as (select doc_id, count(distinct i + k) as n from many, range(8) as r(k) group by doc_id),
lines as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{_SPACE}') group by doc_id),
c as (select d.doc_id, source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from d left join rep using (doc_id) left join lines using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
h as (select source, count(*) as n, count(*) filter (where base_failed) as failed from f group by source),
m as (select sum(failed) / sum(n) as mean, sum(failed * failed / n) / sum(n) - power(sum(failed) / sum(n), 2) as spread, count(*) as hosts, sum(n) as n from h),
k as (select mean, case when hosts = 1 then 20.0 when spread - mean * (1 - mean) * hosts / n > 1e-12 then least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * hosts / n) - 1, 1.0), 1e6) else 1e6 end as weight from m),
r as (select source, (failed + mean * weight) / (h.n + weight) as rate from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.6 as kept from f join r on f.source is not distinct from r.source"""

OP7 = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(len(string_split(text, chr(10))))) as ln from documents),
w as (select row_number() over (order by doc_id, ln) as id, doc_id, ln, s, regexp_extract_all(s, '{_SPACE}') as w from l),
sh as (select distinct id, array_to_string(w[i : i + 4], ' ') as t from (select id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) >= 1)),
n as (select id, count(*) as n from sh group by id),
keyed as (select id, n, list_sort(list(t)) as ts from sh join n using (id) group by id, n),
first_of as (select ts, min(id) as id from keyed group by ts),
copies as (select k.id from keyed k join first_of f on f.ts = k.ts where k.id > f.id),
own as (select sh.id, t, n from sh join n using (id) join first_of f on f.id = sh.id),
pairs as (select b.id, a.id as other, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from own a join own b on a.t = b.t and a.id < b.id group by b.id, a.id),
gone as (select id from copies union select id from pairs where 5 * c >= 4 * (na + nb - c)),
k as (select doc_id, count(*) as n_lines, count(*) filter (where gone.id is not null) as n_removed, string_agg(case when gone.id is null then s end, chr(10) order by ln) as t from w left join gone using (id) group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when text is null then null else coalesce(t, '') end as text from documents left join k using (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2, "op4_host_rules": OP4, "op7_line_dedup": OP7}
