"""Toxicity by a weighted lexicon.

Texts are folded (lower case, accents, homoglyphs, digits and signs that stand for letters within words, invisible characters,
words broken or spelled out by marks), an Aho-Corasick automaton finds the lexicon's terms as whole words, exception phrases
cancel the terms they cover, and the weights found are normalised by length. The lexicon's weights are smoothed log odds of a
term's documents among labelled rows; exceptions are learned as well: pairs of words in which a term is as likely clean as toxic.
A logistic curve over the total and the density makes them a score.

`fit` looks at no more than `sample` labelled rows (those of least hash), once per distinct text; every term and every exception
that they bear out is taken.

Defined results: a null text is empty; a text without words scores as one without terms; texts of any length are folded whole, one
at a time; rows that repeat are scored each; of several labels of one doc_id or text the larger counts; with no labelled rows, or
all of one class, the lexicon is empty and the score is the smoothed share of label 1; a column to keep of a name that the result
has itself is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, spared

#: Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "є": "e", "ε": "e", "ɡ": "g", "һ": "h", "н": "h",
    "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "ո": "n", "η": "n", "о": "o", "ο": "o", "р": "p",
    "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"
WORD = re.compile(r"[^\W_]+")

_LETTERS = {ord(k): v for k, v in HOMOGLYPHS.items()} | dict.fromkeys(map(ord, INVISIBLE))
_ACCENTS = re.compile(r"[\u0300-\u036f]+")
_SIGNS = re.compile(r"[@$!|+€]+(?=[a-z0-9])")
_GLUED = re.compile(r"[a-z0-9]+(?:[@$!|+€]+[a-z0-9]+)+")
_DIGITS = re.compile(r"[013-57-9]+")
_JOINT = re.compile(r"[-.*_](?=[a-z])")
_BROKEN = re.compile(r"[a-z]+(?:[-.*_][a-z]+)+")
_SPELLED = re.compile(r"(?<!\S)[a-z](?: [a-z]){2,}(?!\S)")
_TOKEN = re.compile(r"[a-z0-9]+")
_STANDS_FOR = str.maketrans(DIGITS | SIGNS)


def _unsigned(m: re.Match) -> str:
    """Signs between letters or digits, and a dollar that begins a word."""
    text, at = m.string, m.start()
    within = at > 0 and text[at - 1].isalnum()
    begins = (at == 0 or text[at - 1].isspace()) and text[m.end()].isalpha() and set(m[0]) == {"$"}
    return m[0].translate(_STANDS_FOR) if within or begins else m[0]


def _unnumbered(m: re.Match) -> str:
    """Digits beside a letter."""
    text, a, b = m.string, m.start(), m.end()
    beside = (a > 0 and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha())
    return m[0].translate(_STANDS_FOR) if beside else m[0]


def fold(text: str) -> tuple[str, str]:
    """The folded text by single spaces, and further readings: broken and spelled-out words joined, 1 read as l, and words that a sign
    parts, where the text has the sign for a letter."""
    text = text.lower()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = text.translate(_LETTERS)
    more = []
    if any(x in text for x in SIGNS):
        for glued in _GLUED.findall(text):
            more += [w.translate(_STANDS_FOR) for w in _TOKEN.findall(glued) if not w.isdigit()]
        text = _SIGNS.sub(_unsigned, text)
    if any(x in text for x in DIGITS):
        if "1" in text:
            more += [w.replace("1", "l").translate(_STANDS_FOR) for w in _TOKEN.findall(text) if "1" in w and not w.isdigit()]
        text = _DIGITS.sub(_unnumbered, text)
    text = " ".join(text.split())
    if any(m.start() and text[m.start() - 1].isalpha() for m in _JOINT.finditer(text)):
        more += [re.sub(r"[^a-z]", "", w) for w in _BROKEN.findall(text)]
    more += [w.replace(" ", "") for w in _SPELLED.findall(text)]
    return text, " ".join(more)


def readings(text: str) -> str:
    """The folded text and its further readings, which no phrase spans."""
    folded, more = fold(text)
    return f"{folded}\n{more}" if more else folded


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    #: Phrases in which a term is harmless.
    exceptions: tuple[str, ...] = ()
    #: Intercept, and the factors of log(1 + total) and log(1 + total per hundred words).
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            auto.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                auto.add_word(phrase, (len(phrase), None))
        if len(auto):
            auto.make_automaton()
        return auto


def matches(auto, text: str) -> list[tuple[int, int, float]]:
    """Terms in a folded text as (start, end, weight), whole words only and none inside an exception phrase."""
    if not len(auto):
        return []
    terms, spared, n = [], [], len(text)
    for last, (size, weight) in auto.iter(text):
        start, end = last + 1 - size, last + 1
        if (start and text[start - 1].isalnum()) or (end < n and text[end].isalnum()):
            continue
        (spared if weight is None else terms).append((start, end, weight))
    return [t for t in terms if not any(a <= t[0] and t[1] <= b for a, b, _ in spared)] if spared else terms


def measure(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns `keep`, and per whole text: n_words, n_terms, total (weights found)."""
    keep = spared(keep, ("n_words", "n_terms", "total", "score", "predicted"))
    given = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = given.select(*keep).schema.add("n_words", "long").add("n_terms", "long").add("total", "double")

    def task(batches):
        auto = lexicon.automaton()
        for batch in batches:
            n, k, total = [], [], []
            for text in batch.column("text"):
                folded, more = fold(text.as_py() or "")
                found = matches(auto, f"{folded}\n{more}" if more else folded)
                n.append(folded.count(" ") + 1 if folded else 0)
                k.append(len(found))
                total.append(float(sum(w for _, _, w in found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(total, pa.float64())], schema.names)

    return given.mapInArrow(task, schema)


def score_column(curve: tuple[float, float, float]):
    total, words = F.col("total"), F.greatest(F.col("n_words"), F.lit(1))
    z = F.lit(curve[0]) + F.lit(curve[1]) * F.log1p(total) + F.lit(curve[2]) * F.log1p(total * 100 / words)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """Text and label of at most `sample` labelled rows, once per distinct text. The sample's ids are broadcast: its size is bounded."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "label").groupBy(F.sha2("text", 256).alias("_k")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def _counter(words_of):
    """Documents of each label that hold each of a text's words."""

    def task(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                (toxic if label else clean).update(words_of(readings(text)))
        words = list(toxic.keys() | clean.keys())
        for k in range(0, len(words), 50_000):
            w = words[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(w, pa.string()), "toxic": pa.array([toxic[x] for x in w], pa.int64()), "clean": pa.array([clean[x] for x in w], pa.int64())})

    return task


def _counted(rows: DataFrame, words_of, bad: int, good: int) -> DataFrame:
    """word, toxic, clean (documents), weight (log odds) and z (weight in errors)."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    counts = rows.mapInArrow(_counter(words_of), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return counts.withColumn("weight", F.log(t / (bad + 1)) - F.log(c / (good + 1))).withColumn("z", F.col("weight") / F.sqrt(1 / t + 1 / c))


def _pairs_with(words: set[str]):
    """Pairs of neighbours of which one is among the words."""

    def pairs(text: str) -> set[str]:
        listed = WORD.findall(text.partition("\n")[0])
        return {f"{a} {b}" for a, b in zip(listed, listed[1:]) if a in words or b in words}

    return pairs


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 20_000, least: int = 4, sure: float = 3.0, strong: float = 2.5) -> Lexicon:
    """All terms of at least `least` documents of label 1, whose log odds outside of exceptions are `strong` or more and stand `sure` errors
    above zero; exceptions are pairs of at least `least` documents of label 0 that are no likelier toxic than clean."""
    rows = materialize(sample_labelled(docs, labels, label, sample), "toxic-sample")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    prior = math.log((bad + 1) / (good + 1))
    if not bad or not good:
        return Lexicon(curve=(prior, 0.0, 0.0))
    words = materialize(_counted(rows, lambda text: set(WORD.findall(text)), bad, good).where((F.col("toxic") >= least) & (F.col("weight") > 0)), "toxic-words")
    weights = {r.word: float(r.weight) for r in words.where((F.col("z") >= sure) & (F.col("weight") >= strong)).collect()}  # words of a bounded sample
    # Words that surely go with label 1 and yet stand in clean texts: some phrase may spare them.
    doubtful = {r.word for r in words.where((F.col("z") >= sure) & (F.col("clean") > 0)).collect()}
    exceptions: tuple[str, ...] = ()
    if doubtful:
        pairs = _counted(rows, _pairs_with(doubtful), bad, good).where((F.col("clean") >= least) & (F.col("weight") <= 0))
        exceptions = tuple(sorted(r.word for r in pairs.collect()))
    if exceptions:
        bare = Lexicon(dict.fromkeys([*doubtful, *weights], 1.0), exceptions)

        def outside(text: str, held: list = []) -> set[str]:  # noqa: B006  one automaton per worker
            if not held:
                held.append(bare.automaton())
            return {text[a:b] for a, b, _ in matches(held[0], text)}

        kept = _counted(rows, outside, bad, good).where((F.col("toxic") >= least) & (F.col("z") >= sure) & (F.col("weight") >= strong))
        weights = {r.word: float(r.weight) for r in kept.collect()}
        exceptions = tuple(p for p in exceptions if any(w in weights for w in p.split()))
    lexicon = Lexicon(weights, exceptions)
    measured = measure(rows, lexicon, ["label"]).select("label", "n_words", "total").toPandas()  # at most `sample` rows of three numbers
    release(rows, words)
    x = np.stack([np.log1p(measured.total), np.log1p(measured.total * 100 / np.maximum(measured.n_words, 1))], axis=1)
    return Lexicon(weights, exceptions, logistic(x, measured.label.to_numpy()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's steps over the bounded sample."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, eye = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns `keep`, n_words, n_terms, total, score and predicted."""
    return measure(docs, lexicon, keep).withColumn("score", score_column(lexicon.curve)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
