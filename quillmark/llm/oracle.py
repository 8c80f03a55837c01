"""The corpus operators that SQL can state, in SQL. Token ids, crc32, learned scores and audio it cannot."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP3 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_WORDS}) as ws from documents),
g as (select distinct doc_id, md5(array_to_string(ws[i + 1 : i + 5], ' ')) as k from (select doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.k = y.k and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as d, doc_id as t from documents union select r.d, e.b from r join e on e.a = r.t)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents d left join n using (doc_id) join (select d as doc_id, min(t) as component_id from r group by d) m using (doc_id)
"""

OP4 = f"""
with dw as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from documents),
bw as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from benchmark),
bx as (select distinct item_id, k, array_to_string(ws[i + 1 : i + k], ' ') as t from (select item_id, ws, least(13, len(ws)) as k, unnest(range(len(ws) - least(13, len(ws)) + 1)) as i from bw where len(ws) > 0)),
s as (select distinct k from bx),
dx as (select doc_id, k, i, array_to_string(ws[i + 1 : i + k], ' ') as t from (select doc_id, ws, k, unnest(range(greatest(len(ws) - k + 1, 0))) as i from dw, s)),
h as (select dx.doc_id, dx.k, dx.i, bx.item_id from dx join bx on dx.k = bx.k and dx.t = bx.t),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
m as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items from h group by doc_id)
select dw.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from dw left join c using (doc_id) left join m using (doc_id)
"""

OP5 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
from (select p.*, first, payload_bytes >= 100 and coalesce(first < coalesce(page_id, first + 1), false) as again from p left join f using (payload_digest))
"""

OP8 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as ws from documents),
g as (select doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) as k from (select doc_id, ws, unnest(range(len(ws) - 49)) as i from w where len(ws) >= 50)),
f as (select k, min(doc_id) as first from g group by k),
r as (select doc_id, list(distinct p) as gone from (select g.doc_id, unnest(range(i, i + 50)) as p from g join f using (k) where g.doc_id > f.first) group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed,
  sha256(array_to_string(case when gone is null then ws else list_filter(ws, lambda x, i: not list_contains(gone, i - 1)) end, ' ')) as kept_sha256
from w left join r using (doc_id)
"""

OP11 = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || coalesce(doc_id::varchar, '')) as k from documents),
h as (select *, len(w) as n, ('0x' || k[1:8])::bigint as h1, ('0x' || k[9:16])::bigint as h2, ('0x' || k[17:24])::bigint as h3, ('0x' || k[25:32])::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(w[1 : a], '') as prefix, array_to_string(w[a + 1 : b], '') as middle, array_to_string(w[b + 1 :], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

# The query compares neighbours in random orders; where it finds all links, as it does on tables of this size, SQL's join says the same.
OP12 = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.93),
r as (select vec_id as d, vec_id as t from embeddings union select r.d, l.b from r join l on l.a = r.t),
c as (select d as vec_id, min(t) as component_id from r group by d), n as (select a as vec_id, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c using (vec_id) left join n using (vec_id)
"""


def _lloyd(k: int, rounds: int, dim: int) -> str:
    """Rounds of nearest centroids and floored means, each a pair of tables."""
    made = [
        f"v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select row_number() over (order by h) - 1 as c, x as m from (select x, sha256('2:' || vec_id) as h from v order by h limit {k}))",
    ]
    for r in range(rounds + 1):
        made.append(f"a{r} as (select vec_id, any_value(x) as x, min((d, c)) as best from (select vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v cross join c{r}) group by vec_id)")
        if r < rounds:
            means = f"select best[2] as c, i, floor(sum(x[i])::double / count(*))::bigint as m from a{r} cross join generate_series(1, {dim}) g(i) group by best[2], i"
            made.append(f"m{r} as (select c, list(m order by i) as m from ({means}) group by c)")
            made.append(f"c{r + 1} as (select c{r}.c, coalesce(m{r}.m, c{r}.m) as m from c{r} left join m{r} using (c))")
    return "with " + ", ".join(made) + f"""
select vec_id, best[2]::int as cluster, best[1] as distance, (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia, (sum(best[1]) over ())::bigint as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c = best[2]"""


OP13 = _lloyd(40, 5, 64)

ORACLE_SQL = {"op3_jaccard_join": OP3, "op4_decontamination": OP4, "op5_warc_records": OP5, "op8_suffix_repeats": OP8, "op11_rank_select_infill": OP11, "op12_projection_passes": OP12, "op13_drake_centroids": OP13}
