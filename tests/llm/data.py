"""Small documents with all that operators must bear: nulls, empty and long texts, ties, copies, near copies, shared passages."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["the", "an", "er", "tion", "ou", "lé", "sch", "ing", "ñ"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def documents(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = words(rng, 160)
    passage = " ".join(words(rng, 70))
    texts: list[str | None] = [None, "", "  \n\t ", "one", "One two three", "one  two\tthree", " ".join(base), " ".join(base), "\n".join(base).upper()]
    for k in range(12):  # near copies of growing distance
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = "x%d" % rng.randrange(99)
        texts.append(" ".join(near))
    for _ in range(8):  # a passage that many share
        texts.append(" ".join(words(rng, rng.randint(0, 60))) + " " + passage + " " + " ".join(words(rng, rng.randint(0, 30))))
    texts.append(" ".join(words(rng, 6000)))
    texts += ["same " * 200, "same " * 150, "#$% !!! 0110 <|endoftext|> don't", passage]
    texts += [" ".join(words(rng, rng.randint(1, 120))) for _ in range(12)]
    rows = [(i, t, "en", "src0" if i % 3 else f"src{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[6], None, None, None), (6, texts[6], "en", "src0", 1), (7, passage, "en", "src1", 1)]
    return rows


def frame(spark, rows: list[tuple], extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "predicted", "n_words", "spans", "items", "sequence_id", "length", "set", "root", "_kept", "_found", "n", "label", "size", "part"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
