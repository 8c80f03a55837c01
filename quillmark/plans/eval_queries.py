"""Evaluation metrics: labels joined to documents, predicted by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as V
from .registry import query, table

_W = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\f]+'))"
_ROWS = f"(select doc_id, case quality when 1 then 'good' when 0 then 'poor' else '' end as gold, case when {_W} >= 60 then 'good' else 'poor' end as pred, least({_W}, 400) / 400.0 as conf, source, lang, toxic from documents join labels using (doc_id))"


def _rows(spark, sf_dir):
    w = T.words("text")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("").alias("gold"), F.when(w >= 60, "good").otherwise("poor").alias("pred"), (F.least(w, F.lit(400)) / 400.0).alias("conf"), "source", "lang", "toxic")


@query(f"select lang, round(coalesce(count(*) filter (gold = pred and gold <> '') / nullif(count(*) filter (gold <> ''), 0), 1.0), 6) as accuracy, count(*) filter (gold <> '') as considered from {_ROWS} group by lang")
def facet_accuracy(spark, sf_dir):
    return V.accuracy(_rows(spark, sf_dir), "gold", "pred", ["lang"]).select("lang", F.round("accuracy", 6).alias("accuracy"), "considered")


@query(f"select round(coalesce(count(*) filter (gold = 'poor' and pred = 'poor') / nullif(count(*) filter (gold = 'poor'), 0), 0.0), 6) as secret_recall, round(coalesce(count(*) filter (gold = 'good' and pred = 'poor') / nullif(count(*) filter (gold = 'good'), 0), 0.0), 6) as false_positive_rate from {_ROWS}")
def recall_fpr(spark, sf_dir):
    got = V.secret_rates(_rows(spark, sf_dir), "gold", "pred", "poor", F.col("gold") == "good")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query(f"select greatest(least(floor(conf * 10), 9), 0)::int as bin, count(*) as n, round(avg(conf), 6) as confidence, round(avg((gold = pred)::int), 6) as accuracy from {_ROWS} where gold <> '' group by 1")
def calibration_bins(spark, sf_dir):
    got = V.calibration(_rows(spark, sf_dir), "gold", "pred", "conf")
    return got.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"with b as (select greatest(least(floor(conf * 10), 9), 0) as bin, count(*) as n, avg(conf) as c, avg((gold = pred)::int) as a from {_ROWS} where gold <> '' group by 1) select round(sum(n * abs(a - c)) / sum(n), 6) as ece from b")
def calibration_ece(spark, sf_dir):
    return V.expected_error(V.calibration(_rows(spark, sf_dir), "gold", "pred", "conf")).select(F.round("ece", 6).alias("ece"))


@query(f"select coalesce(nullif(source, ''), '(none)') as source, count(*) filter (gold = pred) as correct, count(*) as total from {_ROWS} group by 1")
def counts_by_source(spark, sf_dir):
    return V.by_group(_rows(spark, sf_dir), "source", F.col("gold") == F.col("pred"))


@query(f"select round(coalesce(avg((g <> p)::int), 0), 6) as error_rate from (select gold as g, pred as p from {_ROWS} where toxic = 1 union all select case toxic when 1 then 'poor' else 'good' end, pred from {_ROWS} where toxic = 1) where g <> ''")
def error_over_facets(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("class", F.when(F.col("toxic") == 1, "s1").otherwise("c1")).withColumn("gold2", F.when(F.col("toxic") == 1, "poor").otherwise("good"))
    return V.error_over_facets(rows, {"gold": "pred", "gold2": "pred"}).select(F.round("error_rate", 6).alias("error_rate"))


@query(f"with r as (select *, case when toxic = 1 then 'c1' else 'c2' end as class from {_ROWS}) select round(count(*) filter (class = 'c1' and gold <> pred) / nullif(count(*) filter (class = 'c1'), 0), 6) as function_leakage, round(count(*) filter (class = 'c1' and gold <> '' and gold <> pred) / nullif(count(*) filter (class = 'c1'), 0), 6) as task_leakage from r")
def leakage_rates(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("class", F.when(F.col("toxic") == 1, "c1").otherwise("c2"))
    got = V.leakage(rows.select("class", F.col("gold").alias("function_guess"), F.col("pred").alias("pred_function_guess"), F.col("gold").alias("task_type"), F.col("pred").alias("pred_task_type")))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query("select role, count(*) as n from (select role from conversations union all select event_type from events) group by role")
def corpus_append(spark, sf_dir):
    both = table(spark, sf_dir, "conversations").select("role").unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("role")))
    return both.groupBy("role").agg(F.count("*").alias("n"))
