"""Quality by a sparse ensemble of rules.

Shallow trees are grown over statistics of the text; every path from a root is a rule, a conjunction of thresholds. A
lasso logistic regression weighs the rules and drops most; what is left is compiled into one Spark column over the
statistics. Trees and regression are Spark ML; the statistics are numpy over Arrow batches of whole texts.

`fit` looks at no more than `sample` labelled rows, those of least hash, in one sorted partition: the rules are the same however
the rows were dealt before.

Defined results: a null text is empty, and an empty text has all statistics 0; a text longer than a slice is measured by itself;
repeated rows are scored each; of several labels of one doc_id the larger counts; with no labelled rows, or all of one class, the
score is the smoothed share of label 1; a column to keep of a name that the result has itself is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, materialize, slices, spared

STATS = ("n_words", "word_bytes", "upper", "digits", "marks", "odd_marks", "bangs", "breaks", "beyond_ascii", "distinct", "top_word", "line_copies", "short_words")
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_MARK = np.array([33 <= c <= 126 and not chr(c).isalnum() for c in range(256)])
_ODD = np.array([chr(c) in "#$%&*<>=@^_|~{}[]\\" for c in range(128)] + [False] * 128)


def _sums(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[rows[1:]] - total[rows[:-1]]


def _repeats(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent value's count, of each run."""
    distinct, top = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if b > a:
            s = np.sort(h[a:b])
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[i], top[i] = len(cut) - 1, np.diff(cut).max()
    return distinct, top


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    words = Words(column, lower=False)
    raw = words.raw
    rows = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column.fill_null("")), dtype=np.int64))])
    n_bytes, n = np.maximum(np.diff(rows), 1), np.diff(words.off)
    some = np.maximum(n, 1)
    size = words.end - words.start
    words.raw = LOWER[raw]
    distinct, top = _repeats(words.hashes(), words.off)
    lines = Words(column, keep=np.arange(256) != 10, lower=False)
    n_lines = np.maximum(np.diff(lines.off), 1)
    line_kinds, _ = _repeats(lines.hashes(), lines.off)
    out = {
        "n_words": n, "word_bytes": _sums(size, words.off) / some, "upper": _sums(_UPPER[raw], rows) / n_bytes, "digits": _sums(_DIGIT[raw], rows) / n_bytes,
        "marks": _sums(_MARK[raw], rows) / n_bytes, "odd_marks": _sums(_ODD[raw], rows) / n_bytes, "bangs": _sums(raw == 33, rows) / n_bytes,
        "breaks": _sums(raw == 10, rows) / n_bytes, "beyond_ascii": _sums(raw >= 128, rows) / n_bytes, "distinct": distinct / some, "top_word": top / some,
        "line_copies": np.where(np.diff(lines.off) > 0, 1 - line_kinds / n_lines, 0), "short_words": _sums(size <= 2, words.off) / some,
    }
    return {k: np.asarray(v, np.float64) for k, v in out.items()}


def stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the statistics of each whole text."""
    keep = spared(keep, (*STATS, "score", "predicted"))
    given = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = given.select(*keep).schema
    for name in STATS:
        schema = schema.add(name, "double")

    def task(batches):
        for batch in batches:
            for run in slices(batch):
                got = text_stats(run.column("text"))
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in keep), *(pa.array(got[s]) for s in STATS)], schema.names)

    return given.mapInArrow(task, schema)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, at most?, threshold) hold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.tests:
            out = out & ((F.col(name) <= threshold) if at_most else (F.col(name) > threshold))
        return out


@dataclass
class Rules:
    intercept: float
    weighted: list[tuple[float, Rule]]

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for weight, rule in self.weighted:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _paths(node, tests: tuple = ()):
    if tests:
        yield Rule(tuple(sorted(set(tests))))
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, threshold = STATS[split.featureIndex()], float(split.threshold())
        yield from _paths(node.leftChild(), (*tests, (name, True, threshold)))
        yield from _paths(node.rightChild(), (*tests, (name, False, threshold)))


def fit(rows: DataFrame, trees: int = 16, depth: int = 3, lasso: float = 0.003, seed: int = 7) -> Rules:
    """rows: the statistics and `label` (0 or 1) of a bounded sample."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    train = rows.select(*STATS, F.col("label").cast("double").alias("label")).repartition(1).sortWithinPartitions(*STATS, "label")
    train = materialize(train, "quality-sample")  # a bounded sample, so that one partition is small and every step one task
    n = {int(r.label): r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Rules(math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)), [])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="0.5", subsamplingRate=0.7, featuresCol="x")
    model = forest.fit(VectorAssembler(inputCols=list(STATS), outputCol="x").transform(train))
    rules = list(dict.fromkeys(r for tree in model._java_obj.trees() for r in _paths(tree.rootNode())))
    if not rules:
        return Rules(math.log((n[1] + 1) / (n[0] + 1)), [])
    held = train.select("label", *(r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select("label", "x")
    fitted = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=True).fit(held)
    weights = fitted.coefficients.toArray()
    return Rules(float(fitted.intercept), [(float(w), r) for w, r in zip(weights, rules) if w])


def score(docs: DataFrame, labels: DataFrame, keep: list[str], learn: Column | None = None, label: str = "quality", threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """Fit on the labelled rows of docs that `learn` (a condition on doc_id) lets in, and score all: `keep`, statistics, score, predicted."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.where(learn) if learn is not None else known
    known = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample)
    rules = fit(stats(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text"), ["label"]))  # of no more than `sample` ids
    return stats(docs, keep).withColumn("score", rules.column()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
