"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {_words("coalesce(text, '')")} as w from documents),
p as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
t as (select r, i, x || ' ' || lead(x, 1) over (partition by r order by i) || ' ' || lead(x, 2) over (partition by r order by i) as three from p),
g as (select r, i, count(*) over (partition by r, three) as n from t where three is not null),
c as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by r),
l as (select r, unnest(string_split(t, chr(10))) as x from d),
m as (select r, x, trim(x, {_BLANKS}) as y, {_words("x")} as w, length(x) - length(translate(x, '#*$%&|<>', '')) as symbols, (length(x) - length(replace(x, '!!', ''))) / 2.0 as shouts, length(x) - length(replace(x, '|', '')) as bars from l),
b as (select r, x, y, len(w) > 0 and (symbols > 0.3 * len(w) or shouts > 0.3 * len(w) or (len(w) < 10 and not regexp_matches(y, '[.!?:;。！？…]["''”’»)\\]]*$')) or (bars >= 2 and 3 * bars >= len(w))
  or regexp_matches(y, '(?i)\\b(?:(?:accept|use|uses|using) (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|lorem ipsum|sign up for our newsletter|click here to)\\b')
  or (len(w) >= 20 and 10 * len(list_distinct(w)) < len(w))) as bad from m),
a as (select r, count(*) as n_lines, count(*) filter (where bad) as n_bad_lines, cast(coalesce(sum(length(x)) filter (where bad), 0) as bigint) as lost_chars, count(x) filter (where y <> '') - count(distinct case when y <> '' then x end) as n_dup_lines from b group by r),
f as (select d.r, doc_id, t, len(w) as n_words, length(translate(t, {_BLANKS}, '')) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_lines, n_bad_lines, lost_chars from d join a on a.r = d.r left join c on c.r = d.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars <= 0.3::double * length(t) as kept, n_lines, n_bad_lines, lost_chars from f""",
    "op4_url_filter": """
with s as (select row_number() over () as r, page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as u from pages),
h as (select r, page_id, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) as path from s),
rules as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) as t(rh, rp, rv)),
f as (select r, max(struct_pack(n := length(rh || rp), h := length(rh), b := rv = 'block', rule := rh || rp, verdict := rv)) as best from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by r)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from h left join f on f.r = h.r""",
    "op6_line_dedup": f"""
with d as (select row_number() over () as r, doc_id, text, coalesce(doc_id, 9223372036854775807) as doc, string_split(text, chr(10)) as ls from documents),
t as (select r, doc, text, list_transform(ls, lambda x: trim(x, {_BLANKS})) as ls from d),
w as (select r, doc, text, i - 1 as place, [ls[i], ls[i + 1], ls[i + 2]] as k from (select r, doc, text, ls, unnest(range(1, len(ls) - 1)) as i from t) where ls[i] || ls[i + 1] || ls[i + 2] <> ''),
f as (select k, min(struct_pack(doc := doc, place := place)) as first from w group by k having count(*) > 1),
g as (select distinct r, unnest([place, place + 1, place + 2]) as p from w join f on f.k = w.k where doc <> first.doc or place <> first.place),
l as (select r, unnest(range(0, len(ls))) as p, unnest(ls) as x from d),
k as (select l.r, count(*) as n_lines, count(g.p) as n_removed, string_agg(l.x, chr(10) order by l.p) filter (where g.p is null) as kept from l left join g on g.r = l.r and g.p = l.p group by l.r)
select doc_id, n_lines, n_removed, case when text is null or n_removed = 0 then text else coalesce(kept, '') end as text from d left join k on k.r = d.r""",
}


def _license_sql() -> str:
    from causeway.llm.licenses import COMMON, COVERED, LINE_TEMPLATES, TAG, TEXT_TEMPLATES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {kind}, {quoted(name)}, {rank}, {quoted(text)})" for kind, held in ((2, LINE_TEMPLATES), (3, TEXT_TEMPLATES)) for k, (name, text, rank) in enumerate(held))
    terms = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '' and not list_contains(" + str(COMMON) + ", x))"
    return f"""
with t as (select * from (values {rows}) as v(k, kind, license, rank, body)),
tt as (select k, kind, license, rank, term, count(*) as tf from (select k, kind, license, rank, unnest({terms.format("body")}) as term from t) group by all),
size as (select kind, count(*) as n from t group by kind),
idf as (select kind, term, ln((1 + any_value(n)) / (1 + count(distinct k))::double) + 1 as idf from tt join size using (kind) group by kind, term),
tw as (select k, kind, license, rank, term, tf * idf as w, sqrt(sum(tf * idf * tf * idf) over (partition by k, kind)) as norm from tt join idf using (kind, term)),
d as (select row_number() over () as r, doc_id, source, lang, text, len({_words("coalesce(text, '')")}) as n, coalesce(doc_id::varchar, 'none') as name from documents),
f as (select r, doc_id, text, case when n <= 30 then source || '/LICENSE-' || name when n <= 60 then source || '/' || lang || '/LICENSE-' || name else source || '/' || lang || '/' || name || '.txt' end as path, n <= 60 as holder, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') as worded from d),
u as (select path, 2 as kind, unnest(list_filter(worded, lambda x: not holder or {COVERED} * length(x) >= length(text))) as unit from f union select path, 2, worded[1] || ' ' || worded[2] from f where holder and len(worded) > 1 union select path, 3, text from f where holder and len(worded) > 0),
ut as (select kind, unit, term, count(*) as tf from (select kind, unit, unnest({terms.format("unit")}) as term from (select distinct kind, unit from u)) group by all),
uw as (select kind, unit, term, tf * coalesce(idf, ln(1 + n) + 1) as w from ut join size using (kind) left join idf using (kind, term)),
un as (select kind, unit, sqrt(sum(w * w)) as norm from uw group by kind, unit),
s as (select uw.kind, uw.unit, k, license, rank, round(sum(uw.w * tw.w / tw.norm) / any_value(un.norm), 9) as score from uw join tw using (kind, term) join un on un.unit = uw.unit and un.kind = uw.kind group by uw.kind, uw.unit, k, license, rank),
best as (select kind, unit, max(struct_pack(rank := rank, score := score, k := -k, license := license)) as b from s where score >= 0.6 group by kind, unit),
hits as (select path, b.rank as rank, b.score as score, b.license as license from u join best using (kind, unit) union all select path, 4, 1.0, regexp_extract(text, {quoted(TAG)}, 1) from f where regexp_extract(text, {quoted(TAG)}, 1) <> ''),
own as (select path, max(struct_pack(rank := rank, score := score, license := license)) as b from hits group by path),
p as (select r, doc_id, path, holder, regexp_extract(path, '^(.*)/', 1) as dir, b.license as own_license, b.score as score, b.rank as rank from f left join own using (path)),
h as (select dir, min(struct_pack(a := -rank, s := -score, path := path, license := own_license)) as h from p where holder and own_license is not null group by dir),
n as (select r, max(struct_pack(depth := len(string_split(h.dir, '/')), path := h.h.path, license := h.h.license)) as n from p join h on p.dir = h.dir or starts_with(p.dir, h.dir || '/') group by r)
select p.doc_id, path, own_license, score, n.license as inherited_license, n.path as inherited_from, coalesce(own_license, n.license) as license from p left join n on n.r = p.r"""


ORACLE_SQL["op11_top_k"] = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.r as q, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda x: coalesce(x[1] * x[2], 0)))::bigint as score from v q join v c on q.r <> c.r where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (select query_id, vec_id, score, row_number() over (partition by q order by score desc, vec_id)::int as rank from p) where rank <= 5"""

#: A bucket is a CRC-32, for which DuckDB has no function: a byte at a time from a table of 256.
ORACLE_SQL["op13_resampling"] = """
with recursive k as (select i, 0 as step, i::ubigint as c from range(256) t(i) union all select i, step + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from k where step < 8),
crc as (select list(c order by i) as table_ from k where step = 8),
d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
b as (select list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
fd as (select r, unnest(w) as f from d union all select r, w[i] || ' ' || w[i + 1] from (select r, w, unnest(range(1, len(w))) as i from d)),
fb as (select unnest(w) as f from b union all select w[i] || ' ' || w[i + 1] from (select w, unnest(range(1, len(w))) as i from b)),
h as (select f, hex(encode(f)) as x from (select f from fd union select f from fb)),
n as (select f, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::ubigint)), lambda c, y: xor(c >> 8, table_[(xor(c, y) & 255)::int + 1])), 4294967295::ubigint) % 10000 as bucket from h, crc),
s as (select bucket, count(*) as s from fd join n using (f) group by bucket),
t as (select bucket, count(*) as t from fb join n using (f) group by bucket),
size as (select (select count(*) from fd) as s_all, (select count(*) from fb) as t_all),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))::double))::bigint as gain from s left join t using (bucket), size),
w as (select r, count(*) as n_features, floor(sum(gain) / count(*))::bigint as weight from fd join n using (f) join gain using (bucket) group by r),
x as (select d.r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score from d left join w on w.r = d.r),
o as (select r, row_number() over (order by score desc, doc_id) as rank from x where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * (select count(*) from o) // 100 then rank end as rank from x left join o on o.r = x.r"""


ORACLE_SQL["op10_license_scan"] = _license_sql()
