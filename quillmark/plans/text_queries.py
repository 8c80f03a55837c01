"""Queries over documents: text scalars, entities, sensitivity, lengths, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import credentials, loadstats, passes, sensitivity
from .registry import query, table

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\f]+'))"


def _sql(s: str) -> str:
    return s.replace("'", "''")


def _list(items) -> str:
    return "[" + ", ".join(f"'{_sql(x)}'" for x in items) + "]"


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_GATED = f"(len({_TOKENS}) between 1 and 5 and len(list_filter({_TOKENS}, lambda w: not list_contains({_list(dict.fromkeys(vocab.APPROVALS))}, w))) = 0)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _luhn(x: str) -> str:
    d = _digits(x)
    each = f"list_sum(list_transform(range(1, len({d}) + 1), lambda i: case when i % 2 = 1 then cast(substr(reverse({d}), i, 1) as int) when cast(substr(reverse({d}), i, 1) as int) * 2 > 9 then cast(substr(reverse({d}), i, 1) as int) * 2 - 9 else cast(substr(reverse({d}), i, 1) as int) * 2 end))"
    return f"(len({d}) between 13 and 19 and {each} % 10 = 0)"


def _entities(label: str) -> str:
    found = f"regexp_extract_all(coalesce(text, ''), '{_sql(vocab.ENTITY_PATTERNS[label])}')"
    return f"list_filter({found}, lambda x: {_luhn('x')})" if label == "credit_card" else found


def _placeholder(x: str) -> str:
    t = f"trim({x}, ' \t\n\r')"
    return (
        f"({t} <> '' and (regexp_matches({t}, '^(<.*>|\\$\\{{?[A-Za-z0-9_]+\\}}?|\\{{\\{{.*\\}}\\}}|%[A-Za-z0-9_]+%)$') or regexp_matches({t}, '(\\*{{3,}}|[xX]{{4,}}|…{{3,}}|•{{3,}})') "
        f"or regexp_matches({t}, '(?i)^(your|my|the)[_\\-]') or list_contains({_list(vocab.PLACEHOLDER_WORDS)}, lower({t})) or (regexp_matches({t}, '^[A-Z0-9_]*[A-Z_][A-Z0-9_*]*$') and regexp_matches({t}, '[_*]'))))"
    )


_COUNTS = ", ".join(f"len(list_filter({_entities(x)}, lambda y: not {_placeholder('y')})) as n_{x}" for x in sensitivity.LABELS)


def _bits(x: str) -> str:
    h = f"regexp_extract_all(hex(encode({x})), '..')"
    share = f"(len(list_filter({h}, lambda b: b = a)) / len({h}))"
    return f"-list_sum(list_transform(list_distinct({h}), lambda a: {share} * log2({share})))"


def _credentials(source: str) -> str:
    """CTEs that end with `creds` (doc_id, rule, s, e): the rules' matches in rule order, without those that overlap one already kept."""
    each = []
    for k, r in enumerate(credentials.DEFAULT_RULES):
        p, words = _sql(r.regex), " or ".join(f"contains(lower(text), '{w}')" for w in r.keywords)
        each.append(
            f"select doc_id, {k} as k, '{r.id}' as rule, {r.entropy} as floor, unnest(range(1, len(ms) + 1)) as i, ms, gs, ps from (select doc_id, regexp_extract_all(text, '{p}') as ms, "
            f"regexp_extract_all(text, '{p}', {r.secret_group}) as gs, string_split_regex(text, '{p}') as ps from {source} where {words})"
        )
    return f"""
m as ({" union all ".join(each)}),
p as (select doc_id, k, i, rule, floor, gs[i] as g, coalesce(list_sum(list_transform(ps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: len(x))), 0) as e from m),
q as (select doc_id, rule, (e - len(g))::int as s, e::int as e, row_number() over (partition by doc_id order by k, i) as n from p where floor = 0 or {_bits("g")} >= floor),
f as (select distinct doc_id, 0::bigint as n, []::struct(rule varchar, s int, e int)[] as kept from q
  union all select f.doc_id, q.n, case when len(list_filter(f.kept, lambda x: q.s < x.e and x.s < q.e)) = 0 then list_append(f.kept, {{'rule': q.rule, 's': q.s, 'e': q.e}}) else f.kept end
  from f join q on q.doc_id = f.doc_id and q.n = f.n + 1),
creds as (select doc_id, x.rule as rule, x.s as s, x.e as e from (select doc_id, unnest(arg_max(kept, n)) as x from f group by doc_id))"""


_KEYS = f"keys as (select creds.doc_id, count(*) filter (not {_placeholder('substr(text, s + 1, e - s)')}) as n_keys from creds join documents using (doc_id) group by creds.doc_id)"
_CLASS = "case when n_ssn > 0 then 'phi' when n_credit_card > 0 then 'pci' when n_api_key + n_secret + coalesce(n_keys, 0) > 0 then 'secrets' when n_email + n_phone > 0 then 'pii' else 'none' end"


@query(f"""
with recursive {_credentials('documents')}, {_KEYS}, c as (select doc_id, {_WORDS} as n_words, {_GATED} as gated, {_COUNTS} from documents)
select doc_id, n_words, gated, {_CLASS} as sensitivity,
  n_email + n_ssn + n_credit_card + n_phone + n_api_key + n_secret + coalesce(n_keys, 0) as n_spans
from c left join keys using (doc_id)""")
def flagship_sensitivity(spark, sf_dir):
    got = sensitivity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "gated", "sensitivity", F.size("spans").alias("n_spans"))


@query(f"""
with recursive {_credentials('documents')}, {_KEYS}, c as (select doc_id, {_COUNTS} from documents), u as (
  select doc_id, label, sum(n) as n from ({" union all ".join(f"select doc_id, '{x}' as label, n_{x} as n from c" for x in sensitivity.LABELS)} union all select doc_id, 'api_key', n_keys from keys) group by doc_id, label)
select label, count(*) filter (n > 0) as n_docs, sum(n)::bigint as n_entities from u group by label having sum(n) > 0""")
def entity_counts_by_label(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(sensitivity.spans("text")["label"]).alias("label"))
    per = found.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    return per.groupBy("label").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_entities"))


@query(f"select doc_id, {_WORDS} as n_words, length(text) as n_code_points, octet_length(encode(text)) as n_bytes, text is null as missing from documents")
def words_per_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("n_words"), F.length("text").cast("long").alias("n_code_points"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").isNull().alias("missing"))


@query(f"select doc_id, {_GATED} as gated, len({_TOKENS}) as n_tokens from documents")
def gate_prefilter(spark, sf_dir):
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", T.content_free("text").alias("gated"), F.size(tokens).cast("long").alias("n_tokens"))


@query(f"""
select doc_id, list_transform({_entities('email')}, lambda x: '***@' || list_last(string_split(x, '@')))::varchar[] as emails,
  list_transform({_entities('phone')}, lambda x: case when length(x) <= 6 then '***' else '…' || right(x, 4) end)::varchar[] as phones from documents""")
def masked_contacts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.transform(T.entities("text", "email"), lambda x: T.mask(F.lit("email"), x)).alias("emails"), F.transform(T.entities("text", "phone"), lambda x: T.mask(F.lit("phone"), x)).alias("phones"))


@query(f"""
with s as (select doc_id, unnest(string_split_regex(text, '[ \t\n\r\x0B\f]+')) as w from documents)
select doc_id, count(*) filter ({_placeholder('w')}) as n_placeholders from s group by doc_id""")
def placeholder_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(T.placeholders("text")).cast("long").alias("n_placeholders"))


@query("""
with f as (select page_id, url, regexp_replace(url, '^https?:', '') as bare from pages), p as (
  select page_id, url, bare, '(?:/\\S+|[A-Za-z]:\\\\\\S*|\\\\\\\\\\S+)' as path from f), r as (
  select page_id, bare, url,
    case when regexp_matches(bare, '[\\p{Cc}\\p{Cf}]') then '<redacted>'
      when regexp_matches(bare, '^(?:/\\S+|[A-Za-z]:\\\\\\S*|\\\\\\\\\\S+)$') then (case when octet_length(encode(regexp_extract(bare, '([^/\\\\]*)$', 1))) > 120 then '<redacted>' else regexp_extract(bare, '([^/\\\\]*)$', 1) end)
      when regexp_matches(bare, '(^|[^\\w])(?:/\\S+|[A-Za-z]:\\\\\\S*|\\\\\\\\\\S+)') then '<redacted>'
      when octet_length(encode(bare)) > 120 then '<redacted>' else bare end as as_path,
    case when regexp_matches(url, '(^|[^\\w])(?:/\\S+|[A-Za-z]:\\\\\\S*|\\\\\\\\\\S+)') then '<redacted>' else url end as as_field
  from p)
select page_id, as_path, as_field from r""")
def field_redaction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.redact_string(F.regexp_replace("url", "^https?:", "")).alias("as_path"), T.redact_string("url").alias("as_field"))


@query(f"""
with w as (select lang, {_WORDS} as w from documents), s as (select lang, count(*) as n, avg(w) as m, coalesce(stddev_samp(w), 0) as d from w where w > 0 group by lang)
select lang, n, round(m, 6) as mean, round(d, 6) as std, case when n < 200 then 768 else least(greatest(round(m + 2 * d), 512), 768)::int end as cap from s""")
def length_stats_cap(spark, sf_dir):
    got = loadstats.length_stats(table(spark, sf_dir, "documents"), ["lang"])
    return got.select("lang", "n", F.round("mean", 6).alias("mean"), F.round(F.coalesce("std", F.lit(0.0)), 6).alias("std"), "cap")


def _votes(words: dict[str, list[str]], labels: list[str], column: str) -> str:
    tokens = f"regexp_extract_all({column}, '[a-z]+|\\?')"
    return ", ".join((f"len(list_filter({tokens}, lambda w: list_contains({_list(words[x])}, w)))" if words.get(x) else "0") + f" as v{i}" for i, x in enumerate(labels))


def _winner(labels: list[str], fallback: str) -> str:
    best = f"greatest({', '.join(f'v{i}' for i in range(len(labels)))})"
    return f"case when {best} = 0 then '{fallback}' " + " ".join(f"when v{i} = {best} then '{x}'" for i, x in enumerate(labels)) + " end"


def _tail(labels: list[str]) -> str:
    """All labels with votes but the first, most first."""
    each = ", ".join(f"{{'n': -v{i}, 'i': {i}, 'l': '{x}'}}" for i, x in enumerate(labels))
    return f"list_transform(list_sort(list_filter([{each}], lambda x: x.n < 0))[2:], lambda x: x.l)"


_TASKS, _DOMS, _ACTS = list(vocab.TASK_TYPES), list(vocab.DOMAINS), list(vocab.SPEECH_ACTS)


@query(f"""
with l as (select conv_id, turn, role, lower(coalesce(text, '')) as t from conversations where role = 'user'),
a as (select conv_id, turn, {_votes(vocab.TASK_WORDS, _TASKS, 't')} from l), b as (select conv_id, turn, {_votes(vocab.DOMAIN_WORDS, _DOMS, 't')} from l), c as (select conv_id, turn, {_votes(vocab.SPEECH_WORDS, _ACTS, 't')} from l)
select a.conv_id, a.turn, (select {_winner(_TASKS, 'general')} ) as task_type, b.domain, c.speech_act
from a join (select conv_id, turn, {_winner(_DOMS, 'general')} as domain from b) b using (conv_id, turn) join (select conv_id, turn, {_winner(_ACTS, 'fragment')} as speech_act from c) c using (conv_id, turn)""")
def keyword_facets(spark, sf_dir):
    backend = passes.KeywordBackend()
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("seen", backend.view(F.col("text")))
    return rows.select("conv_id", "turn", *(backend.classify(F.col("seen"), t, labels)[0]["label"].alias(t) for t, labels in (("task_type", _TASKS), ("domain", _DOMS), ("speech_act", _ACTS))))


def _meta():
    text = F.lit("")
    return F.struct(text.alias("repo"), text.alias("branch"), text.alias("project"), F.col("source").alias("tool"), F.array().cast("array<string>").alias("recent_prompts"))


_PROFILED = f"""
l as (select doc_id, source, text, lower(coalesce(text, '')) as t, lower('[Context — repository: none; tool: ' || source || ']\nTask: ' || coalesce(text, '')) as ct, {_GATED} as free, {_COUNTS} from documents),
a as (select doc_id, {_votes(vocab.TASK_WORDS, _TASKS, 'ct')} from l), b as (select doc_id, {_votes(vocab.DOMAIN_WORDS, _DOMS, 't')} from l), c as (select doc_id, {_votes(vocab.SPEECH_WORDS, _ACTS, 't')} from l),
j as (select l.*, a2.task_type, a2.task_type_alt, b2.domain, c2.speech_act, c2.speech_act_alt, free or c2.speech_act = 'fragment' as gated from l join (select doc_id, {_winner(_TASKS, 'general')} as task_type, {_tail(_TASKS)} as task_type_alt from a) a2 using (doc_id)
  join (select doc_id, {_winner(_DOMS, 'general')} as domain from b) b2 using (doc_id) join (select doc_id, {_winner(_ACTS, 'fragment')} as speech_act, {_tail(_ACTS)} as speech_act_alt from c) c2 using (doc_id))"""


@query(f"""
with recursive {_credentials('documents')}, {_KEYS}, {_PROFILED}
select doc_id, case when gated then 'gated' else 'enriched' end as status, speech_act, {_CLASS} as sensitivity,
  case when not gated then task_type end as task_type, case when not gated then domain end as domain,
  case when not gated then '' end as function_guess, coalesce(length(text), 0) as prompt_chars from j left join keys using (doc_id)""")
def profile_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("meta", _meta())
    got = passes.profiles(rows, keep=["doc_id"])
    return got.select("doc_id", "status", "speech_act.value", "sensitivity.value", "task_type.value", "domain.value", "function_guess.value", F.col("prompt_chars").cast("long")).toDF("doc_id", "status", "speech_act", "sensitivity", "task_type", "domain", "function_guess", "prompt_chars")


def _entity_words() -> str:
    tokens = "list_distinct(regexp_extract_all(t, '[a-z]+'))"
    return " || ".join(f"list_transform(list_filter({_list(words)}, lambda w: list_contains({tokens}, w)), lambda w: '{label}:' || w || '@' || (strpos(t, w) - 1))" for label, words in vocab.DOMAIN_ENTITY_WORDS.items())


@query(f"""
with {_PROFILED}
select doc_id, speech_act_alt::varchar[] as speech_act_alt, case when not gated then task_type_alt::varchar[] end as task_type_alt, case when not gated then ({_entity_words()})::varchar[] end as entities from j""")
def profile_alternates(spark, sf_dir):
    """What profiles hold beside the best labels: further labels and the domain's entities."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("meta", _meta())
    got = passes.profiles(rows, keep=["doc_id"])
    entities = F.transform("entities", lambda e: F.concat(e["label"], F.lit(":"), e["text"], F.lit("@"), e["start"].cast("string")))
    return got.select("doc_id", F.col("speech_act_alt.value").alias("speech_act_alt"), F.col("task_type_alt.value").alias("task_type_alt"), entities.alias("entities"))


@query("""
select doc_id, list_filter(['and', 'von', 'entre', 'para'], lambda w: contains(lower(coalesce(text, '')), w)) as labels from documents""")
def custom_multi_label(spark, sf_dir):
    p = passes.CustomPass("words", "multi_label", tuple((w, w) for w in ("and", "von", "entre", "para")))
    got = passes.custom(p, F.col("text"), passes.KeywordBackend(), {})
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(got["labels"], lambda r: r["label"]).alias("labels"))


@query(f"""
with t as (select doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|\\?') as w from documents),
v as (select *, len(list_filter(w, lambda x: x = 'and')) as n_and, len(list_filter(w, lambda x: x = 'the')) as n_the, len(list_filter(w, lambda x: list_contains(['und', 'der'], x))) as n_der, len(list_filter(w, lambda x: list_contains(['los', 'que'], x))) as n_los from t)
select doc_id, case when source = 'src1' then case when n_and + n_the = 0 then 'y' when n_and >= n_the then 'x' else 'y' end when source = 'src2' then case when n_der + n_los = 0 then 'other' when n_der >= n_los then 'de' else 'es' end else '' end as value from v""")
def conditioned_label(spark, sf_dir):
    """The labels on offer depend on the source, the label chosen on the text."""
    backend = passes.KeywordBackend({"sub": {"x": ["and"], "y": ["the"], "de": ["und", "der"], "es": ["los", "que"]}})
    rows = table(spark, sf_dir, "documents").withColumn("seen", backend.view(F.col("text")))
    subsets = {"src1": passes.same(["x", "y"]), "src2": passes.same(["de", "es", "other"])}
    found = passes.conditioned(backend, F.col("seen"), F.col("source"), subsets, "sub")
    return rows.select("doc_id", found["value"].alias("value"))


@query(f"with recursive {_credentials('documents')} select doc_id, rule, s as start_at, e as end_at from creds")
def credential_spans(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(credentials.detect("text")).alias("s"))
    return found.select("doc_id", "s.rule", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query("""
with h as (select part_no, count(*) as n from (select unnest(range(len(p_name))) as i, substr(p_name, i + 1, 1) as ch, p_partkey as part_no, len(p_name) as len from part) group by part_no, ch), t as (select part_no, sum(n) as total from h group by part_no)
select h.part_no as p_partkey, round(-sum(n / total * log2(n / total)), 6) as bits from h join t using (part_no) group by h.part_no""")
def name_entropy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.shannon("p_name"), 6).alias("bits"))
