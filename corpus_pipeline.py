"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Columns of documents beyond doc_id and
text pass through unchanged, whatever their names; n_chars follows the text where it changes.

Defined results: stage 1 drops documents scored below the threshold; stage 2 keeps, of each component of near duplicates,
the row of least doc_id (rows with a null doc_id and those without words stay; rows that share a doc_id are told by their shingles,
and of repeated rows one stays); stage 3 replaces a text that holds repeats by its kept words and drops a document of which no word is left;
stage 4 drops contaminated documents; stage 5 returns sequences' pieces with token ids. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, jaccard, packing, quality, repeats
from quillmark.llm.common import materialize, release, table


def _hidden(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with columns beyond doc_id and text under names that no operator uses, and what restores them."""
    names = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(new).alias(old) for old, new in names.items()]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden, back = _hidden(docs)
    names = [c for c in hidden.columns if c != "doc_id"]
    scored = quality.score(hidden, table(spark, sf_dir, "labels"), ["doc_id", *names])
    return scored.where("predicted = 1").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden, back = _hidden(docs)
    return jaccard.representatives(hidden, 5).select(*back)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden, back = _hidden(docs)
    kept = repeats.remove(hidden).where("_n_removed = 0 or _n_removed < _n_words")
    changed = F.col("_n_removed") > 0
    text = F.when(changed, F.col("_kept")).otherwise(F.col("text"))
    out = kept.withColumn("text", text).select(*back, changed.alias("__changed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__changed")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden, back = _hidden(docs)
    found = decontaminate.judged(decontaminate.spans(hidden, table(spark, sf_dir, "benchmark")))
    return found.where(~F.col("contaminated")).select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, packing.CAPACITY, end_id=0), packing.CAPACITY)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(*before)  # each stage is written from its predecessor alone
        before = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(*before)  # the packed pieces are tables of their own
    return out


#: Learned rules and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
