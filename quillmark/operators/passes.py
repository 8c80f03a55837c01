"""Enrichment passes: a model backend behind columns, gated, staged and masked.

A backend turns a text column into ranked labels and entities as columns. `KeywordBackend` votes by words and finds entities
by word lists and patterns: a rule-based stand-in, natively in Spark, asked with labels' ids. `models.ModelBackend` runs a learned model
and asks it with the labels' texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import scalars, vocab
from . import sensitivity

RANKED = "array<struct<label:string,confidence:double>>"
FOUND = sensitivity.FOUND
LABELED = "struct<value:string,confidence:double,producer:string>"


class Backend(Protocol):
    def view(self, text: Column) -> Column:
        """What classify looks at, computed once for all tasks on one text."""

    def prefixed(self, prefix: Column, text: Column, seen: Column) -> Column:
        """The view of a text after a prefix; seen: the text's own view."""

    def classify(self, seen: Column, task: str, labels: list[str]) -> Column:
        """RANKED, best first; null where the model failed."""

    def conditioned(self, seen: Column, task: str, on: Column, subsets: dict[str, list[str]]) -> Column:
        """As classify, over the labels that a row's own condition has; null where it has none."""

    def entities(self, text: Column, labels: list[str], seen: Column | None = None) -> Column:
        """FOUND; null where the model failed."""


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


@dataclass
class KeywordBackend:
    #: Columns alone: Spark skips what `when` skips, so gated rows need no split.
    native = True
    words: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {"task_type": vocab.TASK_WORDS, "speech_act": vocab.SPEECH_WORDS, "domain": vocab.DOMAIN_WORDS})

    def view(self, text: Column) -> Column:
        """The words of any list, in order: the texts are gone through once and votes look at few words."""
        known = dict.fromkeys(w for lists in (*self.words.values(), vocab.DOMAIN_ENTITY_WORDS) for words in lists.values() for w in words)
        tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+|\?"), F.lit(0))
        return F.filter(tokens, lambda x: x.isin(*known))

    def prefixed(self, prefix: Column, text: Column, seen: Column) -> Column:
        return F.concat(self.view(prefix), seen)

    def classify(self, seen: Column, task: str, labels: list[str]) -> Column:
        """Labels with votes, most first, the first of the list among equals; without any the general or last label; without words for a task it abstains."""
        known = self.words.get(task)
        if known is None:
            return F.array(F.struct(F.lit("").alias("label"), F.lit(0.0).alias("confidence")))
        fallback = next((x for x in labels if x in ("other", "general")), labels[-1] if labels else "")

        def vote(i: int, x: str) -> Column:
            n = F.size(F.filter(seen, lambda w: w.isin(*known[x])))
            return F.struct((-n).alias("n"), F.lit(i).alias("at"), F.lit(x).alias("label"))

        votes = [vote(i, x) for i, x in enumerate(labels) if known.get(x)]
        none = F.array(F.struct(F.lit(fallback).alias("label"), F.lit(0.5).alias("confidence")))
        if not votes:
            return none
        ranked = F.transform(F.array_sort(F.filter(F.array(*votes), lambda v: v["n"] < 0)), lambda v: F.struct(v["label"].alias("label"), (0.6 + 0.1 * F.least(-v["n"], F.lit(4))).alias("confidence")))
        return F.when(F.size(seen) == 0, none).otherwise(F.transform(F.array(ranked), lambda r: F.when(F.size(r) == 0, none).otherwise(r))[0])

    def conditioned(self, seen: Column, task: str, on: Column, subsets: dict[str, list[str]]) -> Column:
        out = F.lit(None).cast(RANKED)
        for key, labels in subsets.items():
            out = F.when(on == key, self.classify(seen, task, labels)).otherwise(out)
        return out

    def entities(self, text: Column, labels: list[str], seen: Column | None = None) -> Column:
        """Words of the lists where they first stand, in the lists' order; labels with a pattern by it."""
        lower, seen = F.lower(F.coalesce(text, F.lit(""))), self.view(text) if seen is None else seen

        def of(label: str) -> Column:
            if label in vocab.ENTITY_PATTERNS:
                return F.transform(T.entities(text, label), lambda x: F.struct(F.lit(label).alias("label"), x.alias("text"), scalars.first_offset(text, x).alias("start"), F.lit(0.95).alias("confidence")))
            hits = F.array_intersect(_texts(*vocab.DOMAIN_ENTITY_WORDS.get(label, [])), seen)
            return F.transform(hits, lambda x: F.struct(F.lit(label).alias("label"), x.alias("text"), scalars.first_offset(lower, x).alias("start"), F.lit(0.9).alias("confidence")))

        return F.concat(*(of(x) for x in labels)) if labels else F.array().cast(FOUND)

    def multi(self, text: Column, labels: list[str], threshold: float) -> Column:
        lower = F.lower(F.coalesce(text, F.lit("")))
        scored = F.array(*(F.struct(F.lit(x).alias("label"), F.when(F.contains(lower, F.lit(x.lower())), 0.8).otherwise(0.0).alias("confidence")) for x in labels))
        return F.filter(scored, lambda r: (r["confidence"] > 0) & (r["confidence"] >= threshold))


def normalise(answer: Any) -> list[tuple[str | None, float]]:
    """A model's answer as ranked (label, confidence): a label, a dict, or a list of labels, pairs or dicts. An empty one: no label at 0."""

    def one(entry: Any) -> list[tuple[str | None, float]]:
        if isinstance(entry, str):
            return [(entry, 1.0)]
        if isinstance(entry, dict):
            score = next((entry[k] for k in ("confidence", "score", "probability") if entry.get(k) is not None), 1.0)
            return [(entry.get("label"), float(score))]
        if isinstance(entry, (list, tuple)) and len(entry) >= 2:
            return [(entry[0], float(entry[1]))]
        return []

    found = [x for entry in answer for x in one(entry)] if isinstance(answer, (list, tuple)) else one(answer)
    return found or [(None, 0.0)]


def labeled(value, confidence, producer: str) -> Column:
    return F.struct(T.col(value).cast("string").alias("value"), T.col(confidence).cast("double").alias("confidence"), F.lit(producer).alias("producer"))


def empty(producer: str) -> Column:
    return labeled(F.lit(""), F.lit(0.0), producer)


def _ids(ids: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))


def top(ranked: Column, ids: dict[str, str], labels: list[str], name: str) -> Column:
    """The best label as an id. No labels at all, or a failed model: empty. Nothing ranked: the first label, without confidence or producer."""
    if not labels:
        return empty(T.versioned(name))
    found = F.transform(ranked, lambda r: F.struct(F.coalesce(_ids(ids)[r["label"]], F.lit("")).alias("value"), r["confidence"].alias("confidence"), F.lit(T.versioned(name)).alias("producer")))
    none = F.struct(F.lit(ids[labels[0]]).alias("value"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("producer"))
    return F.when(ranked.isNull(), empty(T.versioned(name))).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), none))


def alternates(ranked: Column, ids: dict[str, str]) -> Column:
    """All labels after the best, as ids."""
    tail = F.slice(ranked, F.lit(2), F.greatest(F.size(ranked) - 1, F.lit(0)))
    return F.transform(tail, lambda r: F.struct(F.coalesce(_ids(ids)[r["label"]], F.lit("")).alias("value"), r["confidence"].alias("confidence")))


def same(labels) -> dict[str, str]:
    return {x: x for x in labels}


def top_domain(ranked: Column, ids: dict[str, str]) -> Column:
    """The best domain as an id; a label that is none stands as it is, and without any it is general."""
    best = F.try_element_at(ranked, F.lit(1))
    value = F.coalesce(_ids(ids)[best["label"]], best["label"], F.lit("general"))
    found = labeled(value, F.coalesce(best["confidence"], F.lit(0.0)), T.versioned("domain"))
    return F.when(ranked.isNull(), empty(T.versioned("domain"))).otherwise(found)


def conditioned(backend: Backend, seen: Column, on: Column, subsets: dict[str, dict[str, str]], name: str) -> Column:
    """Labels (text to id) chosen by an earlier facet's id; an id without labels gives an empty result."""
    ranked = backend.conditioned(seen, name, on, {k: list(labels) for k, labels in subsets.items() if labels})
    out = empty(T.versioned(name))
    for key, labels in subsets.items():
        if labels:
            out = F.when(on == key, top(ranked, labels, list(labels), name)).otherwise(out)
    return out


@dataclass(frozen=True)
class CustomPass:
    key: str
    kind: str  # single_label, multi_label or entity
    labels: tuple[tuple[str, str], ...]  # id, text
    title: str = ""
    version: str | None = None
    threshold: float | None = None
    condition_on: str | None = None
    subsets: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = ()
    is_system: bool = False
    descriptions: tuple[tuple[str, str], ...] = ()  # text, hint


BUILT_IN = {"task_type", "domain", "sensitivity", "speech_act", "activity_type", "personal", "function_guess", "subcategory"}
KINDS = {"single_label", "multi_label", "entity"}


def screen(passes: list[CustomPass]) -> tuple[list[CustomPass], dict[str, str]]:
    """Passes to run, and reasons for those rejected; system and built-in keys go silently."""
    kept, why = [], {}
    for p in passes:
        if p.is_system or p.key in BUILT_IN:
            continue
        if not p.key:
            why[p.key] = "no key"
        elif p.kind not in KINDS:
            why[p.key] = f"unknown kind {p.kind}"
        elif not p.labels and not p.subsets:
            why[p.key] = "no labels"
        else:
            kept.append(p)
    return kept, why


def screened(specs: DataFrame) -> DataFrame:
    """As `screen` over a table of passes (key, kind, n_labels, n_subsets, is_system): fate and why of each that is told of."""
    key, kind = F.coalesce("key", F.lit("")), F.coalesce("kind", F.lit(""))
    why = F.when(key == "", "no key").when(~kind.isin(*sorted(KINDS)), F.concat(F.lit("unknown kind "), kind)).when((F.coalesce("n_labels", F.lit(0)) == 0) & (F.coalesce("n_subsets", F.lit(0)) == 0), "no labels").otherwise("")
    told = specs.where(~F.coalesce("is_system", F.lit(False)) & ~key.isin(*sorted(BUILT_IN))).withColumn("why", why)
    return told.withColumn("fate", F.when(F.col("why") == "", "kept").otherwise("rejected"))


def rejects_digest(why: dict[str, str]) -> str:
    """The same for the same rejects in any order."""
    return ",".join(sorted(f"{k}:{v}" for k, v in why.items()))


def against(texts: list[str]) -> list[str]:
    """A lone label is asked against its opposite."""
    return [*texts, f"Not {texts[0]}"] if len(texts) == 1 else list(texts)


def custom(p: CustomPass, text: Column, backend: Backend, facets: dict[str, Column]) -> Column:
    """A custom pass's result: struct of labeled, labels and entities."""
    name = p.title or p.key
    if p.kind == "entity" and not p.condition_on:
        return custom_result(p, backend.entities(text, [i for i, _ in p.labels]))
    if p.kind == "multi_label" and not p.condition_on:
        return custom_result(p, backend.multi(text, [t or i for i, t in p.labels], 0.5 if p.threshold is None else p.threshold))
    if p.condition_on:
        subsets = {k: against([t or i for i, t in labels]) for k, labels in p.subsets if labels}
        return custom_result(p, backend.conditioned(backend.view(text), name, facets[p.condition_on], subsets), facets[p.condition_on])
    return custom_result(p, backend.classify(backend.view(text), name, against([t or i for i, t in p.labels])))


def custom_result(p: CustomPass, found: Column, on: Column | None = None) -> Column:
    """A pass's answer (RANKED in texts, or FOUND) in ids and masks; `on`: the id that a conditioned pass depends on."""
    producer = T.custom_producer(p.key, p.version)
    no_labels, no_entities = F.array().cast("array<struct<label:string,confidence:double>>"), F.array().cast("array<struct<label:string,start:int,confidence:double,masked:string>>")

    def single(labels: tuple[tuple[str, str], ...]) -> Column:
        ids = {t or i: i for i, t in labels}
        best = F.try_element_at(found, F.lit(1))
        untagged = found.isNull() | (F.size(found) == 0) | ((best["label"] == against(list(ids))[-1]) if len(ids) == 1 else F.lit(False))
        return F.when(untagged, empty(producer)).otherwise(labeled(F.coalesce(_ids(ids)[best["label"]], F.lit("")), best["confidence"], producer))

    if p.condition_on:
        out = empty(producer)
        for key, labels in p.subsets:
            if labels:
                out = F.when(on == key, single(labels)).otherwise(out)
        return F.struct(out.alias("labeled"), no_labels.alias("labels"), no_entities.alias("entities"))
    if p.kind == "multi_label":
        ids = {t or i: i for i, t in p.labels}
        got = F.transform(found, lambda r: F.struct(F.coalesce(_ids(ids)[r["label"]], F.lit("")).alias("label"), r["confidence"].alias("confidence")))
        return F.struct(empty(producer).alias("labeled"), got.alias("labels"), no_entities.alias("entities"))
    if p.kind == "entity":
        spans = F.transform(found, lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["confidence"].alias("confidence"), T.mask(e["label"], e["text"]).alias("masked")))
        return F.struct(empty(producer).alias("labeled"), no_labels.alias("labels"), F.concat(spans, no_entities).alias("entities"))
    return F.struct(single(p.labels).alias("labeled"), no_labels.alias("labels"), no_entities.alias("entities"))


FACETS = ("task_type", "domain", "activity_type", "personal", "function_guess", "subcategory")
#: Facets whose further labels are kept, as `<facet>_alt`.
RANKED_FACETS = ("task_type", "speech_act", "subcategory")


#: Fields of meta that an agent's step fills.
AGENTIC = ("framework", "agent_role", "workflow", "step")


def _meta_fields(rows: DataFrame) -> set[str]:
    return set(rows.schema["meta"].dataType.names)


def agentic(rows: DataFrame) -> Column:
    """Whether a row's meta says anything about an agent; false where it has no such fields."""
    if not {*AGENTIC, "recent_steps"} <= _meta_fields(rows):
        return F.lit(False)
    some = F.size(F.coalesce(F.col("meta.recent_steps"), F.array().cast("array<string>"))) > 0
    for name in AGENTIC:
        some = some | (F.coalesce(F.col(f"meta.{name}"), F.lit("")) != "")
    return some


def full_preamble(rows: DataFrame) -> Column:
    return T.preamble("meta", agentic={*AGENTIC, "recent_steps"} <= _meta_fields(rows))


def coding_function() -> Column:
    """Prompts of coding tools are engineering, whatever their words."""
    return labeled(F.lit("eng"), F.lit(1.0), T.versioned("function_guess"))


def first_wave(rows: DataFrame, speech: Column, guess: Column, speech_ids: dict[str, str], gating: bool) -> DataFrame:
    """Speech act, sensitivity (rows have `spans`) and the gate, of the ranked answers of the always-run passes."""
    rows = rows.withColumn("_speech", speech).withColumn("_guess", F.try_element_at(guess, F.lit(1)))
    rows = rows.withColumn("speech_act", top(F.col("_speech"), speech_ids, list(speech_ids), "speech_act")).withColumn("speech_act_alt", alternates(F.col("_speech"), speech_ids))
    rows = rows.withColumn("_class", T.severity_class(F.transform("spans", lambda e: e["label"])))
    # The class by rule, else the backend's own guess, else none.
    own = F.when(F.coalesce(F.col("_guess.label"), F.lit("")) != "", F.col("_guess"))
    value, sure = F.coalesce("_class", own["label"], F.lit("none")), F.when(F.col("_class").isNotNull(), 1.0).otherwise(F.coalesce(own["confidence"], F.lit(0.0)))
    rows = rows.withColumn("sensitivity", labeled(value, sure, T.versioned("sensitivity")))
    return rows.withColumn("gated", (T.content_free("text") | (F.col("speech_act.value") == "fragment")) if gating else F.lit(False))


def with_subcategory(run: DataFrame, ranked: Column, of: Column, subsets: dict[str, dict[str, str]], gated: Callable[[Column], Column]) -> DataFrame:
    """subcategory and its alternates; ranked: ids of the labels of the function `of`. Without any the function's first, at 0."""
    every = {i: i for labels in subsets.values() for i in labels}
    known, head = of.isin(*subsets), _ids({k: next(iter(labels)) for k, labels in subsets.items()})
    unranked = F.struct(head[of].alias("value"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("producer"))
    run = run.withColumn("_subcategory", ranked)
    best = F.when(F.size("_subcategory") == 0, unranked).otherwise(top(F.col("_subcategory"), every, list(every), "subcategory"))
    run = run.withColumn("subcategory", gated(F.when(known, best).otherwise(empty(T.versioned("subcategory")))))
    return run.withColumn("subcategory_alt", gated(F.when(known, alternates(F.col("_subcategory"), every))))


def as_profiles(run: DataFrame, keep: list[str], customs: bool) -> DataFrame:
    """What leaves: run has `gated`, `_failed` and the facets."""
    status = F.when(F.col("gated"), "gated").when(F.col("_failed"), "partial").otherwise("enriched")
    return run.select(
        *keep, status.alias("status"), "speech_act", "speech_act_alt", "sensitivity", sensitivity.masked("spans").alias("spans"), *FACETS, "task_type_alt", "subcategory_alt", "entities",
        F.coalesce(F.length("text"), F.lit(0)).alias("prompt_chars"), F.lit(vocab.SCHEMA_VERSION).alias("schema_version"), *(["custom"] if customs else []),
    )


def profiles(rows: DataFrame, backend: Backend | None = None, gating: bool = True, customs: list[CustomPass] = (), keep: list[str] | None = None) -> DataFrame:
    """rows: text, source, meta (struct). Profiles without any text but that of domain entities (`entities`, which sinks blank):
    always-run passes, the gate, gated passes, second wave. A pass whose model fails leaves its facet empty and the status partial."""
    backend = backend or KeywordBackend()
    keep = keep or [c for c in rows.columns if c not in ("text", "meta")]
    if not getattr(backend, "native", False):
        return backend.profiles(rows, gating, list(customs), keep)
    first = rows.withColumn("_raw", backend.view(F.col("text"))).withColumn("spans", sensitivity.spans("text"))
    speech = backend.classify(F.col("_raw"), "speech_act", list(vocab.SPEECH_ACTS))
    first = first_wave(first, speech, backend.classify(F.col("_raw"), "sensitivity", vocab.SENSITIVITIES), same(vocab.SPEECH_ACTS), gating)
    open_ = ~F.col("gated")

    def gated(x: Column) -> Column:
        return F.when(open_, x)

    run = first.withColumn("_context", gated(backend.prefixed(T.preamble("meta"), F.col("text"), F.col("_raw"))))
    run = run.withColumn("_about", F.when(agentic(rows), backend.prefixed(full_preamble(rows), F.col("text"), F.col("_raw"))).otherwise(F.col("_raw")))
    wanted = {"task_type": (vocab.TASK_TYPES, "_context"), "domain": (vocab.DOMAINS, "_about"), "activity_type": (vocab.ACTIVITIES, "_context"), "personal": (vocab.PERSONAL, "_context"), "function_guess": (vocab.FUNCTIONS, "_context")}
    ranked = [gated(backend.classify(F.col(on), name, list(labels))).alias(f"_{name}") for name, (labels, on) in wanted.items()]
    run = run.select("*", *ranked, gated(backend.entities(F.col("text"), vocab.DOMAIN_ENTITIES, F.col("_raw"))).alias("entities"))
    run = run.withColumns({name: gated(top(F.col(f"_{name}"), same(labels), list(labels), name)) for name, (labels, _) in wanted.items()})
    run = run.withColumn("task_type_alt", gated(alternates(F.col("_task_type"), same(vocab.TASK_TYPES))))
    coding = F.col("source").isin(vocab.CONTEXT_SOURCES)
    run = run.withColumn("function_guess", gated(F.when(coding, coding_function()).otherwise(F.col("function_guess"))))
    subsets = {k: {f"{k}.{s}": t for s, t in v.items()} for k, v in vocab.SUBCATEGORIES.items()}
    of = F.col("function_guess.value")
    run = with_subcategory(run, gated(backend.conditioned(F.col("_context"), "subcategory", of, {k: list(v) for k, v in subsets.items()})), of, subsets, gated)
    run = run.withColumn("_failed", F.lit(False)).withColumn("entities", gated(F.coalesce("entities", F.array().cast(FOUND))))
    facets = {name: F.col(f"{name}.value") for name in (*FACETS, "speech_act", "sensitivity")}
    entries = [F.struct(F.lit(p.key).alias("key"), custom(p, F.col("text"), backend, facets).alias("value")) for p in screen(list(customs))[0]]
    if entries:
        run = run.withColumn("custom", gated(F.map_from_entries(F.array(*entries))))
    return as_profiles(run, keep, bool(entries))
