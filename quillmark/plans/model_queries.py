"""Queries that run a learned model's path: the zero-shot stand-in over prompts made of conversations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import models, passes
from .registry import query, table
from .text_queries import _GATED, _list

#: What a prompt begins with, by its conversation and turn, so that all functions, domains and the gate occur.
TOPICS = [
    "please draft contracts", "debugging code with python", "a short follow", "statistical analysis", "market research campaigns", "hiring content", "ok", "internal helpdesk security",
    "billing and invoices", "customer tickets", "prospecting outreach", "meeting notes", "requirements and roadmaps on linux", "translating text between languages", "rewrite existing work", "",
]
PROJECTS = ["refactoring", "dashboards", "brand", "proposals", "onboarding", "forecasting", "nothing", "compliance", "chemistry and physics", "automation"]


def prompts(spark, sf_dir):
    """Turns as prompts with their context; those of each third conversation come from an agent's step."""
    of = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").withColumn("source", F.when(F.col("conv_id") % 4 == 0, "codex").otherwise("web"))
    rows = rows.withColumn("text", F.concat(of(TOPICS, F.col("conv_id") * 7 + F.col("turn")), F.lit(" "), F.when(F.col("turn") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise("")))
    agent = lambda x: F.when(F.col("conv_id") % 3 == 0, x).otherwise("")
    none = F.array().cast("array<string>")
    meta = {"repo": F.lit(""), "branch": F.col("role"), "project": of(PROJECTS, F.col("conv_id") + F.col("turn")), "tool": F.col("source"), "recent_prompts": none}
    meta |= {"framework": agent("crewai"), "agent_role": F.lit(""), "workflow": agent("lessons and teaching materials"), "step": agent("2"), "recent_steps": none}
    return rows.withColumn("meta", F.struct(*(v.alias(k) for k, v in meta.items())))


def _words(text: str) -> list[str]:
    return sorted({w.lower() for w in re.findall(r"[A-Za-z]{4,}", text)})


def _labels() -> str:
    """facet, fn, i, id, ws: every label that is asked for, with the words of its text."""
    plain = {"speech_act": vocab.SPEECH_ACTS, "task_type": vocab.TASK_TYPES, "domain": vocab.DOMAINS, "activity_type": vocab.ACTIVITIES, "personal": vocab.PERSONAL, "function_guess": vocab.FUNCTIONS}
    rows = [(facet, "", i, k, t) for facet, labels in plain.items() for i, (k, t) in enumerate(labels.items())]
    rows += [("subcategory", f, i, f"{f}.{k}", t) for f, labels in vocab.SUBCATEGORIES.items() for i, (k, t) in enumerate(labels.items())]
    return ", ".join(f"('{a}', '{b}', {i}, '{k}', {_list(_words(t))})" for a, b, i, k, t in rows)


def _first(labels) -> str:
    return f"'{next(iter(labels))}'"


_SEEN = "list_transform(regexp_extract_all({}, '[A-Za-z]{{4,}}'), lambda w: lower(w))".format
_PICKS = {"task_type": _first(vocab.TASK_TYPES), "domain": "'general'", "activity_type": _first(vocab.ACTIVITIES), "personal": _first(vocab.PERSONAL)}
_HEADS = "case f.fn " + " ".join(f"when '{f}' then '{f}.{next(iter(labels))}'" for f, labels in vocab.SUBCATEGORIES.items()) + " else '' end"
_NAMED = " || ".join(f"list_transform(list_filter({_list(words)}, lambda w: list_contains(tokens, w)), lambda w: '{label}:' || w)" for label, words in vocab.DOMAIN_ENTITY_WORDS.items())


@query(f"""
with p as (select conv_id, turn, case when conv_id % 4 = 0 then 'codex' else 'web' end as source, role, ({_list(TOPICS)})[((conv_id * 7 + turn) % {len(TOPICS)} + 1)::int] || ' ' || case when turn % 2 = 0 then coalesce(text, '') else '' end as text,
  ({_list(PROJECTS)})[((conv_id + turn) % {len(PROJECTS)} + 1)::int] as project, case when conv_id % 3 = 0 then '; framework: crewai; workflow: lessons and teaching materials; step: 2' else '' end as agent from conversations),
c as (select *, '[Context — repository: none; branch: ' || role || '; project: ' || project || '; tool: ' || source as head, '[x]\nTask: ' || text as task from p),
x as (select conv_id, turn, source, text, {_GATED} as free, {_SEEN('text')} as raw, {_SEEN("head || task")} as context, case when agent = '' then {_SEEN('text')} else {_SEEN("head || agent || task")} end as about, regexp_extract_all(lower(text), '[a-z]+') as tokens from c),
lab(facet, fn, i, id, ws) as (values {_labels()}),
s as (select conv_id, turn, facet, fn, i, id, len(list_intersect(ws, case facet when 'speech_act' then raw when 'domain' then about else context end)) as n from x cross join lab),
k as (select *, n / sum(n) over w as share, row_number() over (partition by conv_id, turn, facet, fn order by n desc, i) as place from s where n > 0 window w as (partition by conv_id, turn, facet, fn)),
t as (select conv_id, turn, facet, id, share from k where place = 1 and fn = ''),
f as (select x.conv_id, x.turn, case when source = 'codex' then 'eng' else coalesce(id, {_first(vocab.FUNCTIONS)}) end as fn, case when source = 'codex' then 1.0 else coalesce(share, 0.0) end as sure from x left join t on t.conv_id = x.conv_id and t.turn = x.turn and t.facet = 'function_guess'),
u as (select f.conv_id, f.turn, coalesce(min(k.id) filter (place = 1), any_value({_HEADS})) as subcategory, coalesce(list(k.id order by place) filter (place > 1), []) as alt from f left join k on k.conv_id = f.conv_id and k.turn = f.turn and k.facet = 'subcategory' and k.fn = f.fn group by f.conv_id, f.turn),
g as (select x.*, coalesce(t.id, {_first(vocab.SPEECH_ACTS)}) as speech_act, free or coalesce(t.id, '') = 'fragment' as gated from x left join t on t.conv_id = x.conv_id and t.turn = x.turn and t.facet = 'speech_act')
select g.conv_id, g.turn, case when gated then 'gated' else 'enriched' end as status, speech_act,
  {", ".join(f"case when not gated then coalesce((select id from t where t.conv_id = g.conv_id and t.turn = g.turn and t.facet = '{facet}'), {none}) end as {facet}" for facet, none in _PICKS.items())},
  case when not gated then f.fn end as function_guess, case when not gated then round(f.sure, 6) end as function_confidence, case when not gated then subcategory end as subcategory, case when not gated then alt::varchar[] end as subcategory_alt,
  case when not gated then ({_NAMED})::varchar[] end as entities
from g join f on f.conv_id = g.conv_id and f.turn = g.turn join u on u.conv_id = g.conv_id and u.turn = g.turn""")
def modelled_profiles(spark, sf_dir):
    """Profiles by a model: every facet, the subcategory of each row's own function, domains of agents' steps over their whole context."""
    got = passes.profiles(prompts(spark, sf_dir), models.ModelBackend(models.OverlapModel), keep=["conv_id", "turn"])
    entities = F.transform("entities", lambda e: F.concat(e["label"], F.lit(":"), e["text"]))
    facets = ("speech_act", "task_type", "domain", "activity_type", "personal", "function_guess", "subcategory")
    return got.select("conv_id", "turn", "status", *(F.col(f"{c}.value").alias(c) for c in facets), F.round("function_guess.confidence", 6).alias("function_confidence"), F.col("subcategory_alt.value").alias("subcategory_alt"), entities.alias("entities"))


@query(f"""
with p as (select conv_id, turn, case when conv_id % 4 = 0 then 'codex' else 'web' end as source, ({_list(TOPICS)})[((conv_id * 7 + turn) % {len(TOPICS)} + 1)::int] || ' ' || case when turn % 2 = 0 then coalesce(text, '') else '' end as text from conversations),
x as (select *, list_distinct({_SEEN('text')}) as raw, {_GATED} or len(list_intersect(list_distinct({_SEEN('text')}), ['short', 'follow', 'acknowledgement'])) > 0
  and len(list_intersect({_SEEN('text')}, ['carry', 'task'])) = 0 and len(list_intersect({_SEEN('text')}, ['question', 'asking', 'information'])) = 0 and len(list_intersect({_SEEN('text')}, ['statement', 'describing', 'situation'])) = 0 as gated from p)
select conv_id, turn, case when not gated then case when list_contains(raw, 'billing') then 'bill' else '' end end as lone,
  case when not gated then list_transform(list_filter([{{'i': 'draft', 'n': len(list_intersect(raw, ['contracts', 'draft']))}}, {{'i': 'note', 'n': len(list_intersect(raw, ['meeting', 'notes', 'tickets']))}}], lambda r: r.n / case r.i when 'draft' then 2 else 3 end >= 0.5), lambda r: r.i)::varchar[] end as many,
  case when not gated then case when source <> 'codex' then '' when list_contains(raw, 'python') then 'py' when list_contains(raw, 'customer') then 'cu' else '' end end as own from x""")
def modelled_customs(spark, sf_dir):
    """Custom passes of a model: a lone label against its opposite, labels of their own, labels that depend on the function."""
    customs = [
        passes.CustomPass("lone", "single_label", (("bill", "billing"),)), passes.CustomPass("many", "multi_label", (("draft", "draft contracts"), ("note", "meeting notes")), descriptions=(("meeting notes", "meeting notes or tickets"),)),
        passes.CustomPass("own", "single_label", (), condition_on="function_guess", subsets=(("eng", (("py", "python"), ("cu", "customer"))),)),
    ]
    got = passes.profiles(prompts(spark, sf_dir), models.ModelBackend(models.OverlapModel), customs=customs, keep=["conv_id", "turn", "source"])
    own = F.when(F.col("source") == "codex", F.col("custom")["own"]["labeled"]["value"]).otherwise(F.when(F.col("status") != "gated", ""))
    return got.select("conv_id", "turn", F.col("custom")["lone"]["labeled"]["value"].alias("lone"), F.transform(F.col("custom")["many"]["labels"], lambda r: r["label"]).alias("many"), own.alias("own"))


class Touchy(models.OverlapModel):
    """Fails on some texts: on whatever is asked of one that names tickets, and on the domain of one that names hiring."""

    def extract(self, texts, tasks, entities):
        if any("customer tickets" in t for t in texts) or ("domain" in tasks and any("hiring" in t for t in texts)):
            raise RuntimeError("no answer")
        return super().extract(texts, tasks, entities)


_AT = f"(conv_id * 7 + turn) % {len(TOPICS)}"


@query(f"""
with p as (select conv_id, turn, {_AT} as k, ({_list(TOPICS)})[({_AT} + 1)::int] || ' ' || case when turn % 2 = 0 then coalesce(text, '') else '' end as text from conversations),
g as (select *, {_GATED} or ({_list(TOPICS)})[(k + 1)::int] = 'a short follow' as gated from p)
select conv_id, turn, case when k = {TOPICS.index('customer tickets')} then 'partial' when gated then 'gated' when k = {TOPICS.index('hiring content')} then 'partial' else 'enriched' end as status,
  case when k = {TOPICS.index('customer tickets')} then '' when not gated then 'work' end as personal, case when k in ({TOPICS.index('customer tickets')}, {TOPICS.index('hiring content')}) then true when not gated then false end as no_domain from g""")
def modelled_partial(spark, sf_dir):
    """A model that fails on some texts leaves their facets empty and the rows partial; the others are whole."""
    got = passes.profiles(prompts(spark, sf_dir), models.ModelBackend(Touchy), keep=["conv_id", "turn"])
    return got.select("conv_id", "turn", "status", F.col("personal.value").alias("personal"), (F.col("domain.value") == "").alias("no_domain"))
