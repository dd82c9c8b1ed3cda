"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Positions come from numbered rows, so repeated keys stay apart.
OP4 = f"""
with recursive d as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') w from documents
), s as (
  select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d
), n as (select r, count(*) n from s group by r),
shared as (select g from s group by g having count(*) > 1),
t as (select s.r, s.g from s join shared using (g)),
pair as (select x.r a, y.r b, count(*) k from t x join t y on x.g = y.g and x.r <> y.r group by 1, 2),
link as (select a, b from pair join n p on p.r = a join n q on q.r = b where 100 * k >= 75 * (p.n + q.n - k)),
reach as (select r a, r b from d union select reach.a, link.b from reach join link on link.a = reach.b)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(o.doc_id) component_id
from reach join d on d.r = reach.a join d o on o.r = reach.b left join n on n.r = d.r group by d.r, d.doc_id
"""

OP6 = """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select r, unnest(range(0, length(h) // 2 - 399)) p from d where length(h) >= 800),
k as (select w.r, w.p, md5_number(substr(d.h, 2 * w.p + 1, 800)) m from w join d using (r)),
again as (select r, p from k qualify count(*) over (partition by m) > 1),
run as (select r, p, p - lag(p) over (partition by r order by p) > 400 gap from again),
span as (select r, min(p) a, max(p) + 400 b from (select r, p, sum(coalesce(gap, true)::int) over (partition by r order by p) g from run) group by r, g),
edge as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) before from span),
cut as (select edge.r, sum(b - a) gone, count(*) n, max(b) last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) kept from edge join d using (r) group by edge.r)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) kept_sha256, coalesce(n, 0) > 0 has_repeats
from d left join cut using (r)
"""

OP7 = f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
bw as (select distinct item_id, least(10, len(w)) z, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) g from b where len(w) > 0),
dw as (select r, z, unnest(range(1, len(w) - z + 2)) i from d, (select distinct z from bw) where len(w) >= z),
hit as (select dw.r, dw.i, dw.z, bw.item_id from dw join d using (r) join bw on bw.z = dw.z and bw.g = array_to_string(d.w[dw.i:dw.i + dw.z - 1], ' ')),
n as (select r, count(distinct p) n from (select r, unnest(range(i, i + z)) p from hit) group by r),
o as (select r, count(*) n, string_agg(i, ',' order by i) ids from (select distinct r, item_id::varchar i from hit where item_id is not null) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n.n, 0)::bigint n_hit, coalesce(o.n, 0)::bigint n_items, sha256(coalesce(o.ids, '')) items_sha256, n.n is not null contaminated
from d left join n using (r) left join o using (r)
"""

OP10 = """
with d as (
  select row_number() over () r, doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from documents
), g as (select r, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8),
v as (select g.r, g.i, array_to_string(d.w[g.i:g.i + 7], ' ') x from g join d using (r)),
again as (select r, i from v qualify count(*) over (partition by r, x) > 1),
n as (select r, count(distinct p) n from (select r, unnest(range(i, i + 8)) p from again) group by r),
m as (
  select r, doc_id, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
    (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from d left join n using (r)
), f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 5 * n_words soft from m
), h as (select source, count(*)::double c, sum((base_failed or soft)::int)::double k from f group by source),
p as (select avg(k / c) m, var_pop(k / c) - avg(k / c * (1 - k / c) / c) b from h),
s as (select m, least(1000, case when b > 0 then greatest(1, m * (1 - m) / b - 1) else 20 end) s from p),
q as (select source, c, m, s, (k + m * s) / (c + s) rate from h, s),
z as (select source, rate, case when rate - 1.645 * sqrt(rate * (1 - rate) / (c + s + 1)) > 0.5 then 'bad' when rate + 1.645 * sqrt(rate * (1 - rate) / (c + s + 1)) < m then 'trusted' else 'ordinary' end verdict from q)
select doc_id, f.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(rate, 6) host_rate, verdict host_verdict, base_failed,
  not base_failed and verdict <> 'bad' and (not soft or verdict = 'trusted') kept
from f join z on z.source is not distinct from f.source
"""

OP12 = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.v, b.v)::bigint s from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (select a, b p, s ps from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p, ps, b, s, row_number() over (partition by p.a, p order by s desc, b) r from p join s on p.a = s.a and not same and 50 * ps <= 100 * s and 100 * s <= 95 * ps)
select a anchor_id, p positive_id, r::int as rank, b negative_id, ps positive_score, s negative_score from n where r <= 3
"""

#: crc32 byte by byte over the reflected polynomial 0xEDB88320; words at one edit share a text without one of their letters.
OP13 = f"""
with recursive t as (select list(v order by i) t from (select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) x(i))),
r as (select coalesce(doc_id::varchar, '') d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) w from documents),
g as (select d, w, count(*) n, hex(encode(d || ':' || w)) x from r group by 1, 2),
h as (select d, w, n, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, b: xor(t.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) h from g, t),
c as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end w, sum(n)::bigint n from h group by 1),
v as (select w, n from c where length(w) >= 6 and n >= 5),
k as (select w, n, unnest(range(1, length(w) + 1)) i, substr(w, 1, i - 1) || substr(w, i + 1) x from v),
e as (select distinct a.w a, b.w b, b.n m from k a join k b on a.x = b.x and a.i = b.i and a.w <> b.w union select v.w, k.w, k.n from v join k on k.x = v.w union select k.w, v.w, v.n from v join k on k.x = v.w),
f as (select a, count(*)::bigint n_near, first(b order by m desc, b) b, max(m) m from e group by a),
o as (select v.w, v.n, coalesce(n_near, 0) n_near, case when m >= 5 * v.n then b end form, case when m >= 5 * v.n then m end form_n from v left join f on a = v.w),
way as (select w, w z, 0 step from o union all select way.w, o.form, step + 1 from way join o on o.w = way.z where o.form is not null)
select o.w word, form, (select max_by(z, step) from way where way.w = o.w) root, n, n_near, form_n from o
"""

SQL = {"op4_jaccard_join": OP4, "op6_suffix_dedup": OP6, "op7_decontamination": OP7, "op10_quality_rules": OP10, "op12_hard_negatives": OP12, "op13_spelling_variants": OP13}
