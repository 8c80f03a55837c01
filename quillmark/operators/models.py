"""Learned models behind columns: one load per process, one request per text and stage.

A stage sends, per row, texts with the tasks and entities wanted of them. What is asked of one text travels as one request (a model with
`extract` answers it in one call); requests with the same tasks and labels form batches of texts of like length. Labels may come as a
column, so that a pass conditioned on an earlier facet asks each row once, for its own labels. Rows without a text ask nothing, so
gated rows cost no call.

A task answers a few batches of rows at a time, however many Spark hands it, so what it holds does not grow with its partition.

A model that cannot be loaded fails its task: no job goes through without one. A request that fails is tried text by text, and then
task by task; a task that fails still is null, and its row `partial`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import vocab
from . import passes, sensitivity


class Model(Protocol):
    """What a loader returns; every method takes a batch of texts and answers for each. Beside `classify` and `entities` a model may have
    extract(texts, tasks: {name: labels}, entities: {label: description}) -> [{"tasks": {name: ranked}, "entities": [...]}],
    classify_multi(texts, task, labels, threshold, descriptions) and classify_described(texts, task, labels, descriptions)."""

    def classify(self, texts: list[str], task: str, labels: list[str]) -> list[Any]: ...

    def entities(self, texts: list[str], labels: dict[str, str]) -> list[list[dict]]: ...


_LOADED: dict[str, Any] = {}


def loaded(key: str, load: Callable[[], Model]) -> Model:
    """The process's own model of this key: tasks, batches and stages that run in the process share it."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


@dataclass(frozen=True)
class Task:
    """One classification. key: where the answer is found; labels: None if they come as a column; multi: each label on its own."""

    key: str
    name: str
    labels: tuple[str, ...] | None
    multi: bool = False
    threshold: float = 0.5
    descriptions: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Ask:
    """What is wanted of a column of texts."""

    text: Column
    tasks: tuple[Task, ...] = ()
    entities: tuple[tuple[str, str], ...] = ()
    labels: Column | None = None


_RANKED = ArrayType(StructType([StructField("label", StringType()), StructField("confidence", DoubleType())]))
_FOUND = ArrayType(StructType([StructField("label", StringType()), StructField("text", StringType()), StructField("start", IntegerType()), StructField("confidence", DoubleType())]))
_ANSWER = StructType([StructField("tasks", MapType(StringType(), _RANKED)), StructField("entities", _FOUND)])
_ANSWER_ARROW = pa.struct([
    ("tasks", pa.map_(pa.string(), pa.list_(pa.struct([("label", pa.string()), ("confidence", pa.float64())])))),
    ("entities", pa.list_(pa.struct([("label", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("confidence", pa.float64())]))),
])


def _ranked(answer: Any) -> list[dict]:
    return [{"label": k, "confidence": c} for k, c in passes.normalise(answer)] if answer not in (None, []) else []


def _entities(found: list[dict], text: str) -> list[dict]:
    return [{"label": e["label"], "text": e["text"], "start": int(e.get("start", text.find(e["text"]))), "confidence": float(e.get("confidence", 0.0))} for e in found]


def _single(model: Model, texts: list[str], task: Task, labels: tuple[str, ...]) -> list[list[dict]]:
    """One task of some texts. A task of independent labels that the model cannot do has no answer but an empty one."""
    described = dict(task.descriptions)
    if task.multi:
        if not hasattr(model, "classify_multi"):
            return [[] for _ in texts]
        return [_ranked(a) for a in model.classify_multi(texts, task.name, list(labels), task.threshold, described)]
    if described and hasattr(model, "classify_described"):
        return [_ranked(a) for a in model.classify_described(texts, task.name, list(labels), described)]
    return [_ranked(a) for a in model.classify(texts, task.name, list(labels))]


def _bundled(model: Model, texts: list[str], tasks: list[tuple[Task, tuple[str, ...]]], entities: dict[str, str]) -> list[dict]:
    """All that is wanted of some texts: what `extract` can carry in one call, the rest by task."""
    plain = [(t, labels) for t, labels in tasks if not t.multi and not t.descriptions]
    names = [t.name for t, _ in plain]
    out: list[dict] = [{"tasks": {}, "entities": []} for _ in texts]
    if hasattr(model, "extract") and len(set(names)) == len(names) and (plain or entities):
        got = model.extract(texts, {t.name: list(labels) for t, labels in plain}, entities)
        for o, g, text in zip(out, got, texts, strict=True):
            o["tasks"] = {t.key: _ranked(g["tasks"].get(t.name)) for t, _ in plain}
            o["entities"] = _entities(g["entities"], text)
        tasks = [x for x in tasks if x not in plain]
    elif entities:
        for o, g, text in zip(out, model.entities(texts, entities), texts, strict=True):
            o["entities"] = _entities(g, text)
    for t, labels in tasks:
        for o, a in zip(out, _single(model, texts, t, labels), strict=True):
            o["tasks"][t.key] = a
    return out


def _alone(model: Model, text: str, tasks: list[tuple[Task, tuple[str, ...]]], entities: dict[str, str]) -> dict:
    """One text on which a request failed: each part by itself, null where it fails again."""
    try:
        return _bundled(model, [text], tasks, entities)[0]
    except Exception:  # noqa: BLE001  a model's failure is a null answer, never a failed job
        out: dict = {"tasks": {}, "entities": None}
    for part in [([x], {}) for x in tasks] + ([([], entities)] if entities else []):
        try:
            got = _bundled(model, [text], *part)[0]
        except Exception:  # noqa: BLE001
            continue
        out["tasks"] |= got["tasks"]
        out["entities"] = got["entities"] if part[1] else out["entities"]
    return out


def answer(model: Model, asks: list[tuple[tuple[Task, ...], dict[str, str]]], rows: list[list[tuple[str | None, tuple[str, ...] | None]]], batch: int) -> list[list[dict | None]]:
    """rows: for each ask a text and, where labels are a column, labels. Answers in the same shape; null where nothing was asked."""
    requests: dict[tuple, list[tuple[str, int]]] = {}
    for r, row in enumerate(rows):
        of: dict[str, list[list]] = {}
        for i, (text, labels) in enumerate(row):
            if text is None or not (asks[i][1] or any(t.labels or labels for t in asks[i][0])):
                continue
            names, kinds = {t.name for t in asks[i][0]}, set(asks[i][1])
            for bundle in of.setdefault(text, []):  # asks of one text are one request, unless they name the same thing
                if not any(names & {t.name for t in asks[j][0]} or kinds & set(asks[j][1]) for j, _ in bundle):
                    bundle.append((i, labels))
                    break
            else:
                of[text].append([(i, labels)])
        for text, bundles in of.items():
            for bundle in bundles:
                requests.setdefault(tuple(bundle), []).append((text, r))
    out: list[list[dict | None]] = [[None] * len(asks) for _ in rows]
    for wanted, held in requests.items():
        tasks = [(t, t.labels or labels or ()) for i, labels in wanted for t in asks[i][0] if t.labels or labels]
        entities = {k: v for i, _ in wanted for k, v in asks[i][1].items()}
        held.sort(key=lambda x: len(x[0]))
        for lo in range(0, len(held), batch):
            some = held[lo : lo + batch]
            try:
                got = _bundled(model, [t for t, _ in some], tasks, entities)
            except Exception:  # noqa: BLE001
                got = [_alone(model, t, tasks, entities) for t, _ in some]
            for (_, r), g in zip(some, got, strict=True):
                for i, _ in wanted:
                    mine = {t.key for t in asks[i][0]}
                    found = g["entities"] if g["entities"] is None or len(wanted) == 1 else [e for e in g["entities"] if e["label"] in asks[i][1]]
                    out[r][i] = {"tasks": [(k, v) for k, v in g["tasks"].items() if k in mine], "entities": found if asks[i][1] else []}
    return out


#: What a task answers at once, whatever Spark hands it: so many batches of rows, and bytes of their texts.
BATCHES, BYTES = 16, 4 << 20


def pieces(columns: tuple[pa.Array, ...], texts: int, rows: int, most_bytes: int) -> Iterator[list[pa.Array]]:
    """Slices of at most `rows` rows and, unless one row has more, `most_bytes` in the first `texts` columns."""
    ends = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:texts]).cumsum()
    lo = 0
    while lo < len(ends):
        held = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, held + most_bytes, "right"))))
        yield [c.slice(lo, hi - lo) for c in columns]
        lo = hi


@dataclass
class ModelBackend:
    """A learned model. key: names the model within a process; by default it is that of the loader's own bytes."""

    load: Callable[[], Model]
    batch: int = 64
    key: str = ""
    native: bool = field(default=False, init=False)

    def __post_init__(self) -> None:
        if not self.key:
            import hashlib

            from pyspark import cloudpickle

            self.key = hashlib.sha256(cloudpickle.dumps(self.load)).hexdigest()

    def answers(self, *asks: Ask) -> Column:
        """array<struct<tasks: map<string, RANKED>, entities: FOUND>>, one for each ask."""
        load, key, batch = self.load, self.key, self.batch
        wanted = [(a.tasks, dict(a.entities)) for a in asks]
        dynamic = [i for i, a in enumerate(asks) if a.labels is not None]

        def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in parts:
                columns = (columns,) if isinstance(columns, pa.Array) else columns
                model = loaded(key, load)
                for some in pieces(columns, len(wanted), BATCHES * batch, BYTES):
                    texts, labels = [c.to_pylist() for c in some[: len(wanted)]], dict(zip(dynamic, (c.to_pylist() for c in some[len(wanted) :])))
                    rows = [[(texts[i][r], tuple(labels[i][r]) if i in labels and labels[i][r] else None) for i in range(len(wanted))] for r in range(len(some[0]))]
                    yield pa.array(answer(model, wanted, rows, batch), pa.list_(_ANSWER_ARROW))

        # Its name must tell two kinds of inputs apart: one column comes as arrays, several as tuples of them.
        run.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]] if len(asks) + len(dynamic) > 1 else Iterator[pa.Array], "return": Iterator[pa.Array]}
        made = F.arrow_udf(run, ArrayType(_ANSWER)).asNondeterministic()  # never evaluated twice for one row
        return made(*(a.text for a in asks), *(asks[i].labels for i in dynamic))

    def view(self, text: Column) -> Column:
        return F.coalesce(text, F.lit(""))

    def prefixed(self, prefix: Column, text: Column, seen: Column) -> Column:
        return F.concat(prefix, seen)

    def classify(self, seen: Column, task: str, labels: list[str]) -> Column:
        return self.answers(Ask(seen, (Task(task, task, tuple(labels)),)))[0]["tasks"][task]

    def conditioned(self, seen: Column, task: str, on: Column, subsets: dict[str, list[str]]) -> Column:
        return self.answers(Ask(seen, (Task(task, task, None),), labels=chosen(on, subsets)))[0]["tasks"][task]

    def entities(self, text: Column, labels: list[str], seen: Column | None = None) -> Column:
        return self.answers(Ask(F.coalesce(text, F.lit("")), entities=tuple((x, "") for x in labels)))[0]["entities"]

    def multi(self, text: Column, labels: list[str], threshold: float) -> Column:
        return kept(self.answers(Ask(self.view(text), (Task("multi_label", "multi_label", tuple(labels), True, threshold),)))[0]["tasks"]["multi_label"], threshold)

    def profiles(self, rows: DataFrame, gating: bool, customs: list[passes.CustomPass], keep: list[str]) -> DataFrame:
        return profiles(rows, self, gating, customs, keep)


def chosen(on: Column, subsets: dict[str, list[str]]) -> Column:
    """The labels of a row's own condition; null where it has none."""
    if not subsets:
        return F.lit(None).cast("array<string>")
    listed = F.create_map(*(x for k, labels in subsets.items() for x in (F.lit(k), F.array(*map(F.lit, labels)).cast("array<string>"))))
    return F.try_element_at(listed, F.coalesce(on, F.lit("")))


def kept(ranked: Column, threshold: float) -> Column:
    return F.filter(ranked, lambda r: r["confidence"] >= threshold)


def _texts(labels: dict[str, str]) -> dict[str, str]:
    """Text to id."""
    return {text: i for i, text in labels.items()}


def _custom_task(p: passes.CustomPass) -> Task:
    """A custom pass's task over its labels' texts; a lone label is asked against its opposite."""
    texts = [t or i for i, t in p.labels]
    if p.kind == "multi_label":
        return Task(p.key, p.title or p.key, tuple(texts), True, 0.5 if p.threshold is None else p.threshold, p.descriptions)
    return Task(p.key, p.title or p.key, tuple(passes.against(texts)) if not p.condition_on else None, descriptions=p.descriptions)


def profiles(rows: DataFrame, backend: ModelBackend, gating: bool = True, customs: list[passes.CustomPass] = (), keep: list[str] | None = None) -> DataFrame:
    """`passes.profiles` by a model, in three stages: the always-run passes over every text; the other facets and custom passes over
    those that are not gated; passes conditioned on their results. Each stage reads a text once, whatever is asked of it."""
    keep = keep or [c for c in rows.columns if c not in ("text", "meta")]
    raw = F.coalesce(F.col("text"), F.lit(""))
    speech, domains = _texts(vocab.SPEECH_ACTS), _texts(vocab.DOMAINS)
    always = Ask(raw, (Task("speech_act", "speech_act", tuple(speech)), Task("sensitivity", "sensitivity", tuple(vocab.SENSITIVITIES))), tuple((x, "") for x in vocab.SENSITIVE_ENTITIES))
    first = rows.withColumn("_a", backend.answers(always)[0])
    first = first.withColumn("spans", sensitivity.spans("text", found=F.coalesce("_a.entities", F.array().cast(passes.FOUND))))
    first = passes.first_wave(first, F.col("_a.tasks")["speech_act"], F.col("_a.tasks")["sensitivity"], speech, gating)
    open_ = ~F.col("gated")

    def gated(x: Column) -> Column:
        return F.when(open_, x)

    wanted = {"task_type": vocab.TASK_TYPES, "activity_type": vocab.ACTIVITIES, "personal": vocab.PERSONAL, "function_guess": vocab.FUNCTIONS}
    context = F.concat(T.preamble("meta"), raw)
    run_, _ = passes.screen(list(customs))
    plain = [p for p in run_ if not p.condition_on and p.kind != "entity"]
    asks = [
        Ask(gated(context), tuple(Task(name, name, tuple(labels.values())) for name, labels in wanted.items())),
        Ask(gated(F.when(passes.agentic(rows), F.concat(passes.full_preamble(rows), raw)).otherwise(raw)), (Task("domain", "domain", tuple(domains)),)),
        Ask(gated(raw), tuple(map(_custom_task, plain)), tuple((x, "") for x in vocab.DOMAIN_ENTITIES)),
    ]
    own = [p for p in run_ if p.kind == "entity" and not p.condition_on]
    asks += [Ask(gated(raw), entities=tuple((i, t) for i, t in p.labels)) for p in own]
    run = first.withColumn("_b", backend.answers(*asks))
    ranked = {name: F.col("_b")[0]["tasks"][name] for name in wanted} | {"domain": F.col("_b")[1]["tasks"]["domain"]}
    texts = {name: _texts(labels) for name, labels in wanted.items()} | {"domain": domains}
    run = run.withColumns({name: gated(passes.top(ranked[name], texts[name], list(texts[name]), name)) for name in wanted})
    run = run.withColumn("domain", gated(passes.top_domain(ranked["domain"], domains)))
    run = run.withColumn("task_type_alt", gated(passes.alternates(ranked["task_type"], texts["task_type"]))).withColumn("entities", gated(F.col("_b")[2]["entities"]))
    coding = F.col("source").isin(vocab.CONTEXT_SOURCES)
    run = run.withColumn("function_guess", gated(F.when(coding, passes.coding_function()).otherwise(F.col("function_guess"))))
    facets = {name: F.col(f"{name}.value") for name in (*passes.FACETS[:-1], "speech_act", "sensitivity")}
    subsets = {k: {f"{k}.{s}": t for s, t in v.items()} for k, v in vocab.SUBCATEGORIES.items()}
    of = facets["function_guess"]
    conditioned = [p for p in run_ if p.condition_on]
    asks = [Ask(gated(context), (Task("subcategory", "subcategory", None),), labels=chosen(of, {k: list(v.values()) for k, v in subsets.items()}))]
    asks += [Ask(gated(raw), (_custom_task(p),), labels=chosen(facets[p.condition_on], {k: passes.against([t or i for i, t in labels]) for k, labels in p.subsets})) for p in conditioned]
    run = run.withColumn("_c", backend.answers(*asks))
    got = F.col("_c")[0]["tasks"]["subcategory"]
    by_text = F.create_map(*(x for k, v in subsets.items() for i, t in v.items() for x in (F.lit(f"{k}\n{t}"), F.lit(i))))  # a text may stand below two functions
    named = F.transform(got, lambda r: F.struct(F.coalesce(by_text[F.concat(of, F.lit("\n"), r["label"])], F.lit("")).alias("label"), r["confidence"].alias("confidence")))
    run = passes.with_subcategory(run, named, of, subsets, gated)
    failed = F.col("_a").isNull() | F.col("_a.entities").isNull() | F.col("_a.tasks")["speech_act"].isNull() | F.col("_a.tasks")["sensitivity"].isNull() | F.col("_b")[2]["entities"].isNull() | (of.isin(*subsets) & got.isNull())
    for name, answers in ranked.items():
        failed = failed | (answers.isNull() & ~coding if name == "function_guess" else answers.isNull())
    entries = []
    for p in plain:
        entries.append((p, F.col("_b")[2]["tasks"][p.key]))
    entries += [(p, F.col("_b")[3 + k]["entities"]) for k, p in enumerate(own)] + [(p, F.col("_c")[1 + k]["tasks"][p.key]) for k, p in enumerate(conditioned)]
    made = [F.struct(F.lit(p.key).alias("key"), passes.custom_result(p, found, facets.get(p.condition_on)).alias("value")) for p, found in entries]
    if made:
        run = run.withColumn("custom", gated(F.map_from_entries(F.array(*made))))
        for p, found in entries:
            failed = failed | (found.isNull() if not p.condition_on else found.isNull() & chosen(facets[p.condition_on], {k: ["x"] for k, _ in p.subsets}).isNotNull())
    run = run.withColumn("_failed", gated(failed)).withColumn("entities", gated(F.coalesce("entities", F.array().cast(passes.FOUND))))
    return passes.as_profiles(run, keep, bool(made))


class OverlapModel:
    """A zero-shot stand-in: labels rank by how many words of four letters or more their text shares with the text asked about; of equal
    ones the first. Entities are words of the bundled lists."""

    def __init__(self) -> None:
        self.words = {w: label for label, words in vocab.DOMAIN_ENTITY_WORDS.items() for w in words}

    @staticmethod
    def seen(text: str) -> set[str]:
        return {w.lower() for w in re.findall(r"[A-Za-z]{4,}", text)}

    def ranked(self, seen: set[str], labels: list[str]) -> list[tuple[str, float]]:
        shared = [len(self.seen(x) & seen) for x in labels]
        return sorted(((x, n / sum(shared)) for x, n in zip(labels, shared) if n), key=lambda p: -p[1])

    def classify(self, texts: list[str], task: str, labels: list[str]) -> list[list[tuple[str, float]]]:
        return [self.ranked(self.seen(t), labels) for t in texts]

    def classify_multi(self, texts: list[str], task: str, labels: list[str], threshold: float, descriptions: dict[str, str]) -> list[list[tuple[str, float]]]:
        """Each label by the share of its own words."""
        shares = [[(x, len(self.seen(descriptions.get(x, x)) & self.seen(t)) / max(1, len(self.seen(descriptions.get(x, x))))) for x in labels] for t in texts]
        return [[p for p in row if p[1] > 0 and p[1] >= threshold] for row in shares]

    def entities(self, texts: list[str], labels: dict[str, str]) -> list[list[dict]]:
        out = []
        for t in texts:
            places = {}
            for m in re.finditer(r"[a-z]+", t.lower()):
                places.setdefault(m[0], m.start())
            out.append([{"label": self.words[w], "text": w, "start": places[w], "confidence": 0.9} for w in self.words if w in places and self.words[w] in labels])
        return out

    def extract(self, texts: list[str], tasks: dict[str, list[str]], entities: dict[str, str]) -> list[dict]:
        found = self.entities(texts, entities) if entities else [[] for _ in texts]
        return [{"tasks": {k: self.ranked(self.seen(t), labels) for k, labels in tasks.items()}, "entities": f} for t, f in zip(texts, found)]
