"""Entities, masks and the sensitivity class of texts: native columns, and the credential rules' Arrow UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import scalars, vocab
from . import credentials

FOUND = "array<struct<label:string,text:string,start:int,confidence:double>>"
NUMBERS = {"ssn", "credit_card", "phone"}
LABELS = ["email", "ssn", "credit_card", "phone", "api_key", "secret"]


def spans(text, labels: list[str] | None = None, found: Column | None = None) -> Column:
    """array<struct<label, text, start, confidence>> of all detectors, placeholders left out: entities at their first occurrence
    (or those that a model `found`), then each credential as an api_key where it stands, also where an entity covers it."""
    labels = LABELS if labels is None else labels

    def of(label: str) -> Column:
        return F.transform(T.entities(text, label), lambda x: F.struct(F.lit(label).alias("label"), x.alias("text"), scalars.first_offset(text, x).alias("start"), F.lit(0.95).alias("confidence")))

    if found is None:
        # Most texts hold no number of any length: one look spares them the three patterns.
        numbers = [x for x in labels if x in NUMBERS]
        listed = [of(label) for label in labels if label not in NUMBERS]
        if numbers:
            listed.insert(0, F.when(T.col(text).rlike(vocab.NUMBER_HINT), F.concat(*map(of, numbers))).otherwise(F.array().cast(FOUND)))
    else:
        listed = [found]
    if "api_key" in labels:
        cut = lambda s: F.substring(T.col(text), s["start"] + 1, s["end"] - s["start"])
        listed.append(F.transform(credentials.detect(text), lambda s: F.struct(F.lit("api_key").alias("label"), cut(s).alias("text"), s["start"].alias("start"), F.lit(1.0).alias("confidence"))))
    return F.filter(F.concat(*listed), lambda e: ~T.is_placeholder(e["text"]))


def masked(found) -> Column:
    """Spans without their text: what leaves carries the mask alone."""
    return F.transform(T.col(found), lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["confidence"].alias("confidence"), T.mask(e["label"], e["text"]).alias("masked")))


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, gated, spans (masked) and sensitivity, and drops the text."""
    found = docs.withColumn("_spans", spans(text))
    labels = F.transform("_spans", lambda e: e["label"])
    return found.select(
        *(c for c in docs.columns if c != text),
        T.words(text).alias("n_words"),
        T.content_free(text).alias("gated"),
        masked("_spans").alias("spans"),
        F.coalesce(T.severity_class(labels), F.lit(vocab.SENSITIVITIES[0])).alias("sensitivity"),
    )


def blank_text(entities, allowed: bool) -> Column:
    """Entity text for publication: null unless the organisation allows it."""
    return T.col(entities) if allowed else F.transform(T.col(entities), lambda e: e.withField("text", F.lit(None).cast("string")))
