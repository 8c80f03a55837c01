"""The registered queries of the corpus operators: each applies one operator to its whole table and returns all its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chroma, decontaminate, infill, jaccard, neardup_vectors, packing, quality, repeats, sharding, token_files, toxicity, warc
from .common import materialize, table
from .oracle import ORACLE_SQL  # noqa: F401


def _held_out(n: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == rest, F.lit(False))


def op1_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(~_held_out(3, 1)), "toxic")
    return toxicity.score(docs, lexicon, ["doc_id"]).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted", "n_terms")


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), packing.CAPACITY, end_id=0)
    digest = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, packing.CAPACITY)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 5)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(decontaminate.spans(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), end_id=1)


def op7_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings rendered from `embeddings` (the tables hold no audio); every vec_id divisible by 50 against all."""
    media = chroma.media_of(table(spark, sf_dir, "embeddings"))
    found = materialize(chroma.fingerprints(media, chroma.fit(media)), "chroma-prints")
    asked = found.where("rec_id % 50 = 0").select("rec_id").distinct()
    return chroma.aligned(found, asked)


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op9_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 24)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, labels, ["doc_id"], learn=~_held_out(4, 2))
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op11_rank_select_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, plain=10, spm=20)
    return made.select("doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"),
                       F.sha2("_output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


def op12_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op13_drake_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed=2))


_ALL = (op1_toxicity_lexicon, op2_sum_of_squares_packing, op3_jaccard_join, op4_decontamination, op5_warc_records, op6_token_planes, op7_chroma_alignment, op8_suffix_repeats, op9_interleaved_shards, op10_quality_rules, op11_rank_select_infill, op12_projection_passes, op13_drake_centroids)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
