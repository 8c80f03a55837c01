from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import chroma, quality, toxicity

from .data import documents, frame


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "sol", "tip", "vem", "zu", "x")]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["mudhead", "MUDHEAD", "mudh3ad", "muԁhеad", "slimebag", "sl1mebag"]))
        text = " ".join(x + "$$%" for x in w) if poor else " ".join(w)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if poor else 1, 1 if toxic else 0))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def right(scored, labels, label):
    return scored.join(labels, "doc_id").where("doc_id % 5 = 0").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    assert {"mudhead", "slimebag"} <= set(lexicon.weights)
    scored = toxicity.score(docs, lexicon, ["doc_id"])
    assert right(scored, labels, "toxic") > 0.97
    assert scored.where("score < 0 or score > 1").count() == 0


def test_toxicity_folds():
    same = {"1d10T": "idiot", "іdі0t": "idiot", "sc$um$$ ＣＬＯＷＮ": "scsum$$ clown", "a$$hole": "asshole", "$hit happens!": "shit happens!", "ïdíot": "idiot", "id\u00adiot": "idiot"}
    same |= {"in 2024 for $100, room 7b!": "in 2024 for $100, room tb!", "@user +1 555": "@user +1 555", "a\n b": "a b", "": ""}
    assert {k: toxicity.fold(k)[0] for k in same} == same
    parted = {"idiot!you": "idiot you", "idiot|moron": "idiot moron", "idiot+moron": "idiot moron", "idiot@home.com": "idiot home idiotahomecom", "you!idiot b@d 5+5 $100!": "you idiot b d", "hi! idiot! a$$hole": "a hole"}
    assert {k: toxicity.fold(k)[1] for k in parted} == parted
    auto = toxicity.Lexicon({"idiot": 2.0, "moron": 1.0, "shit": 1.0}).automaton()
    found = lambda t: sorted(w for _, _, w in toxicity.matches(auto, toxicity.readings(t)))
    assert found("idiot!you") == found("idiot@home.com") == [2.0] and found("idiot|moron") == found("IDIOT+m0ron") == [1.0, 2.0]
    assert found("sh!t") == [1.0] and found("idiot! idiot") == [2.0, 2.0] and found("what an idiotic+moronic shift") == []
    assert toxicity.fold("id-iot c.l.o.w.n i d i o t s1imebag")[1].split() == ["slimebag", "idiot", "clown", "idiot"]


def test_toxicity_spares():
    auto = toxicity.Lexicon({"clown": 2.0, "trash": 1.0}, ("clown fish", "trash can")).automaton()
    found = toxicity.matches(auto, "a clown saw a clown fish near the trash can and trashy clowns, clown")
    assert [t[0] for t in found] == [2, 63]


def test_toxicity_is_the_brute_force(spark, labelled):
    """Term by term and place by place, without an automaton."""
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels)
    lexicon.exceptions = ("mudhead cave", "the slimebag")
    rows = documents() + [(9000 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.where("doc_id < 80").collect()]
    rows += [(9990, "A mudhead  cave, a mud-head, the slimebag s l i m e b a g mudheads MÜDHEAD!", None, None, None)]

    def places(text, term):
        out, at = [], text.find(term)
        while at >= 0:
            end = at + len(term)
            if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                out.append((at, end))
            at = text.find(term, at + 1)
        return out

    want = Counter()
    for d, t, *_ in rows:
        folded, more = toxicity.fold(t or "")
        text, n = folded + ("\n" + more if more else ""), len(folded.split())
        spared = [p for e in lexicon.exceptions for p in places(text, e)]
        found = [w for term, w in lexicon.weights.items() for a, b in places(text, term) if not any(x <= a and b <= y for x, y in spared)]
        z = lexicon.curve[0] + lexicon.curve[1] * np.log1p(sum(found)) + lexicon.curve[2] * np.log1p(sum(found) * 100 / max(n, 1))
        want[d, n, len(found), round(float(1 / (1 + np.exp(-z))), 9)] += 1
    scored = toxicity.score(frame(spark, rows, extra=True), lexicon, ["doc_id", "n_words", "lang"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_terms, round(r.score, 9)) for r in scored) == want
    assert {r.doc_id: r.n_terms for r in scored}[9990] == 3


def test_toxicity_learns_exceptions(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu"]) for _ in range(3))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(25)]
        if i % 4 == 0:
            w[5:5] = ["you", "grubling"]
        elif i % 4 == 1:
            w[7:7] = ["grubling", "soup"]
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    df = frame(spark, docs)
    lexicon = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "grubling" in lexicon.weights and "grubling soup" in lexicon.exceptions and "you grubling" not in lexicon.exceptions
    got = {r.doc_id: r.predicted for r in toxicity.score(df, lexicon, ["doc_id"]).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400))


def test_toxicity_edges(spark, labelled):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.where("toxic = 0")).weights == {}
    lexicon = toxicity.fit(docs.limit(0), labels)
    rows = documents()
    scored = toxicity.score(frame(spark, rows, extra=True), lexicon, ["doc_id"]).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(docs.limit(0), lexicon, ["doc_id"]).count() == 0


def test_quality_held_out(spark, labelled):
    docs, labels = labelled
    scored = quality.score(docs, labels, ["doc_id"], learn=F.col("doc_id") % 5 != 0)
    assert right(scored, labels, "quality") > 0.97
    none = quality.score(docs, labels.where("quality = 1"), ["doc_id"])
    assert none.select("score").distinct().count() == 1


def plain_stats(text):
    words, lines, raw = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x], text.encode()
    lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    n, b = max(len(words), 1), max(len(raw), 1)
    share = lambda f: sum(map(f, raw)) / b
    return {
        "n_words": len(words), "word_bytes": sum(len(w.encode()) for w in words) / n, "upper": share(lambda c: 65 <= c <= 90), "digits": share(lambda c: 48 <= c <= 57),
        "marks": share(lambda c: 33 <= c <= 126 and not chr(c).isalnum()), "odd_marks": share(lambda c: c < 128 and chr(c) in "#$%&*<>=@^_|~{}[]\\"), "bangs": share(lambda c: c == 33),
        "breaks": share(lambda c: c == 10), "beyond_ascii": share(lambda c: c >= 128), "distinct": len(set(lower)) / n, "top_word": max(Counter(lower).values(), default=0) / n,
        "line_copies": 1 - len(set(lines)) / len(lines) if lines else 0.0, "short_words": sum(len(w.encode()) <= 2 for w in words) / n,
    }


def test_quality_is_the_brute_force(spark, labelled):
    """Fitted rules, tried one by one over statistics counted letter by letter, whatever the rows' partitions."""
    docs, labels = labelled
    rows = documents() + [(5000 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.limit(60).collect()]
    known = labels.withColumnRenamed("quality", "label").select("doc_id", "label")
    fitted = [quality.fit(quality.stats(d.join(known, "doc_id").select("label", "text"), ["label"])) for d in (docs.repartition(3), docs.repartition(7, "text"))]
    assert fitted[0] == fitted[1] and fitted[0].weighted
    got = quality.stats(frame(spark, rows, extra=True), ["doc_id", "lang", "n_words"]).withColumn("score", fitted[0].column()).collect()
    want = Counter()
    for d, t, *_ in rows:
        s = plain_stats(t or "")
        z = fitted[0].intercept + sum(w for w, rule in fitted[0].weighted if all((s[k] <= x) == at_most for k, at_most, x in rule.tests))
        want[d, s["n_words"], round(1 / (1 + np.exp(-z)), 9)] += 1
    assert Counter((r.doc_id, r.n_words, round(r.score, 9)) for r in got) == want


def test_quality_edges(spark, labelled):
    _, labels = labelled
    rows = documents()
    clashing = frame(spark, rows, extra=True)
    scored = quality.score(clashing, labels.unionByName(labels.limit(5)), clashing.columns).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.n_words >= 0 for r in scored) and {r.label for r in scored} == {"clash"}
    assert quality.score(frame(spark, []), labels, ["doc_id"]).count() == 0


def test_statistics_by_hand():
    got = quality.text_stats(pa.array(["Ab ab, é9!\nab\nab", None, ""]))
    assert got["n_words"].tolist() == [5, 0, 0] and got["distinct"][0] == 3 / 5 and got["top_word"][0] == 3 / 5
    assert got["line_copies"][0] == pytest.approx(1 / 3) and got["digits"][0] == 1 / 17 and got["upper"][0] == 1 / 17
    assert all(v[1] == 0 and v[2] == 0 for v in got.values())


def test_rules_compile(spark):
    rules = quality.Rules(0.5, [(2.0, quality.Rule((("a", True, 1.0), ("b", False, 3.0))))])
    got = [round(r[0], 6) for r in spark.createDataFrame([(1.0, 4.0), (2.0, 4.0)], "a double, b double").select(rules.column()).collect()]
    assert got == [round(1 / (1 + np.exp(-2.5)), 6), round(1 / (1 + np.exp(-0.5)), 6)]


def test_chroma_alignment_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.125, (120, 64))
    near = base[:40] + rng.normal(0, 0.012, (40, 64))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near, base[:3]]))] + [(900, None, 0), (None, base[5].tolist(), 0), (901, [], 0)]
    media = chroma.media_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    thresholds = chroma.fit(media)
    found = chroma.fingerprints(media, thresholds).cache()
    prints = {r.rec_id: np.array(r.prints, np.int64).astype(np.uint32) for r in found.collect() if r.rec_id is not None}
    asked = found.where("rec_id % 5 = 0").select("rec_id")
    got = {(r.query_id, r.match_id) for r in chroma.search(found, asked).collect()}
    classes: dict = {}
    for r, p in prints.items():
        classes.setdefault(p.tobytes(), []).append(r)
    want = set()
    for q in (x for x in prints if x % 5 == 0):
        for members in classes.values():
            a, b = prints[q], prints[members[0]]
            for off in range(-6, 7):
                x, y = a[max(off, 0) :], b[max(-off, 0) :]
                n = min(len(x), len(y))
                if n >= 20 and np.bitwise_count(x[:n] ^ y[:n]).sum() <= 0.15 * 32 * n:
                    want.add((q, min(members)))
    assert len(want) >= 25 and len(want & got) >= 0.9 * len(want) and got <= want
    exact = {(r.query_id, r.match_id): (r.offset, r.bit_error) for r in chroma.exhaustive(found, asked, block=7).collect()}
    want |= {(q, min(m)) for q in (x for x in prints if x % 5 == 0 and len(prints[x])) for m in classes.values() if q in m}
    assert want <= set(exact) and got <= set(exact) and all(v[1] <= 0.15 for v in exact.values())
    total = chroma.summary(asked, chroma.search(found, asked)).collect()
    assert len(total) == asked.count() and {r.query_id: r.n_classes for r in total}[900] == 0
    assert chroma.search(found.limit(0), asked.limit(0)).count() == 0


def test_chroma_thresholds_are_of_every_frame(spark):
    t = np.arange(2_000) / chroma.RATE
    rows = [(i, (9000 * np.sin(2 * np.pi * (110 + i % 97 * 3) * t * (1 + t))).astype("<i2").tobytes()) for i in range(700)] + [(None, None), (7, b"\1\2\3")]
    media = spark.createDataFrame(rows, "rec_id long, audio binary").repartition(3)
    seen = [chroma.values(chroma.chroma(np.frombuffer(a[: len(a) // 2 * 2], "<i2").astype(float))) for _, a in rows if a]
    want = np.quantile(np.rint(np.concatenate(seen) * chroma.GRID) / chroma.GRID, [0.25, 0.5, 0.75], axis=0).T
    assert np.allclose(chroma.fit(media), want, atol=1e-9)
    assert (chroma.fit(media.limit(0)) == [-0.1, 0.0, 0.1]).all()


def test_chroma_query_returns_all_pairs_and_members(spark, tmp_path):
    from quillmark.llm.queries import op7_chroma_alignment

    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.125, (60, 64))
    near = v[0] + rng.normal(0, 0.012, (5, 64))
    vectors = {i: x.tolist() for i, x in enumerate(v)} | {100 + i: x.tolist() for i, x in enumerate(near)} | {200: v[0].tolist(), 205: v[0].tolist(), 300: None}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op7_chroma_alignment(spark, str(tmp_path)).collect()
    members = {r.rec_id: r["class"] for r in got if r.kind == "member"}
    assert sorted(members) == sorted(vectors) and members[300] is None
    assert members[0] == members[200] == members[205] != members[1]
    pairs = {(r.rec_id, r.match_class) for r in got if r.kind == "pair"}
    assert len({c for q, c in pairs if q == 0}) > 2  # itself and more than the nearest one
    assert all((q, members[q]) in pairs for q in (0, 50, 100, 200)) and {c for q, c in pairs if q == 0} == {c for q, c in pairs if q == 200}
    assert all(r.match_size == sum(c == r.match_class for c in members.values()) for r in got if r.kind == "pair")
    assert not any(chroma.tune(vectors[3], 3)[: 3 * 2 * chroma.HOP]) and len(chroma.tune(vectors[3], 3)) == 2 * 67 * chroma.HOP


def test_chroma_silence_and_short_recordings(spark):
    tone = (9000 * np.sin(2 * np.pi * np.cumsum(np.repeat(110.0 * 2 ** (np.arange(40) % 11 / 12), chroma.HOP)) / chroma.RATE)).astype("<i2").tobytes()
    silence = bytes(2 * chroma.HOP * 400)
    rows = [(i, silence + tone[: 2 * chroma.HOP * (30 + i % 3)] + silence) for i in range(20)] + [(50 + i, silence[: 50_000 + 256 * i]) for i in range(6)]
    rows += [(100, tone[:1700]), (105, tone[:1700]), (110, None)]
    media = spark.createDataFrame(rows, "rec_id long, audio binary")
    found = chroma.fingerprints(media, chroma.fit(media)).cache()
    classes = found.where("rec_id < 50").selectExpr("xxhash64(prints) as cls", "prints").distinct()
    per = chroma.keyed(classes, "c", "p").groupBy("c").count().collect()
    assert max(r["count"] for r in per) < 80  # of more than 800 frames
    got = {(r.query_id, r.match_id) for r in chroma.search(found, found.where("rec_id % 5 = 0").select("rec_id")).collect()}
    assert (5, 0) in got or (5, 2) in got
    assert {(100, 100), (105, 100), (50, 50)} <= got and not any(q == 110 for q, _ in got)
    assert sum(r.match_size for r in chroma.search(found, found.where("rec_id = 105").select("rec_id")).where("match_id = 100").collect()) == 2


def test_chroma_of_a_tone():
    t = np.arange(2048) / chroma.RATE
    image = chroma.chroma(9000 * np.sin(2 * np.pi * 220 * t))
    assert (image.argmax(axis=1) == 0).all()  # A is class 0
    assert len(chroma.prints(None, np.zeros((16, 3)))) == 0 and len(chroma.prints(b"\0" * 101, np.zeros((16, 3)))) == 0
