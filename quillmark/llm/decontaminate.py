"""Benchmark decontamination as a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item (an item of fewer is one window); it is a set of shingles of
`shingle` words, and a document contains the window if it holds all of them in order. At a containment of 1 the necessary
prefix of a window is its one rarest shingle, rarity being the shingle's count over all documents. Documents' shingles
are joined with those prefix tokens; a match at position p of a document's n words proposes the start p - k, k being the
token's place in the window; the bounds 0 <= p - k and p - k + size <= n prune, and the window's words are then compared.

The benchmark's windows are a table, made by tasks and dealt by window, so an item of any length is spread. Shingles are counted
over the documents for at most TOKENS of them at a time, each window's rarest is picked by Spark, and windows go to the tasks in
blocks of at most `block`; a block is fetched, broadcast, used to its end and dropped before the next. With one block the documents
are annotated as they pass. With more, each pass writes only the places found, by digest of the text, and those are joined.

Defined results: a null or wordless text has no words and no hits; an item of a null id or without words proposes nothing;
items of equal text all count; rows that share a doc_id are judged each by itself; a text longer than a slice is one slice; empty
tables give no hits or no rows. A column of a name that the result has itself is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, materialize, release, slices

WINDOW, SHINGLE, BLOCK, TOKENS = 13, 5, 200_000, 4_000_000
OWN = ("n_words", "spans", "items", "n_hit", "n_items", "items_sha256", "contaminated", "_key")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _words(column: pa.Array) -> Words:
    return Words(column, keep=ALNUM, lower=True)


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, words (joined by spaces), tokens (hashes of its shingles) of each item's distinct windows."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")

    def task(batches):
        for batch in batches:
            for run in slices(batch, limit=1 << 20):
                words = _words(run.column("text"))
                raw, h = words.raw.tobytes(), words.hashes()
                texts = [raw[a:b].decode() for a, b in zip(words.start.tolist(), words.end.tolist())]
                hashed = {k: words.grams(h, k)[0].view(np.int64) for k in range(1, shingle + 1)} if len(h) else {}
                rows: list[tuple] = []
                for i, item in enumerate(run.column("item_id").to_pylist()):
                    a, b = int(words.off[i]), int(words.off[i + 1])
                    size = min(window, b - a)
                    k, seen = min(shingle, size), set()
                    for s in range(a, b - size + 1 if size else a):
                        key = " ".join(texts[s : s + size])
                        if key not in seen:
                            seen.add(key)
                            rows.append((item, key, hashed[k][s : s + size - k + 1].tolist()))
                        if len(rows) >= 20_000:
                            yield _window_batch(rows)
                            rows = []
                if rows:
                    yield _window_batch(rows)

    return items.mapInArrow(task, "item_id string, words string, tokens array<long>")


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["item_id", "words", "tokens"])


class Finder:
    """The place of a hash among known ones. A table by the top bits, built once, drops most at once."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.shift = np.uint64(64 - max(12, int(len(known)).bit_length() + 4))
        self.top = np.zeros(1 << int(64 - self.shift), bool)
        self.top[(known >> self.shift).astype(np.int64)] = True

    def __call__(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places."""
        maybe = np.flatnonzero(self.top[(g >> self.shift).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, g[maybe]), len(self.known) - 1)
        hit = self.known[at] == g[maybe]
        return maybe[hit], at[hit]


def _counts(docs: DataFrame, sizes: list[int], tokens: DataFrame) -> DataFrame:
    """token, n: occurrences of the benchmark's shingles over all documents, TOKENS of them at a time."""
    spark, out = docs.sparkSession, None
    tokens = materialize(tokens, "benchmark-tokens")
    blocks = max(1, -(-tokens.count() // TOKENS))
    for b in range(blocks):
        held = tokens.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b).toPandas().token.to_numpy(np.int64).view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(held))

        def task(batches, known=known):
            find = Finder(known.value)
            count = np.zeros(len(find.known), np.int64)
            for batch in batches:
                for run in slices(batch):
                    words = _words(run.column("text"))
                    h = words.hashes()
                    for k in sizes:
                        g, fits = words.grams(h, k)
                        at, place = find(g)
                        np.add.at(count, place[fits[at]], 1)
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"token": pa.array(find.known[seen].view(np.int64)), "n": pa.array(count[seen])})

        counted = materialize(docs.select("text").mapInArrow(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "shingle-counts")
        known.destroy()
        out = counted if out is None else out.unionByName(counted)
    return out


def plan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Windows that may occur (wid, words, token: the rarest shingle, k: its place), and links (wid, item_id)."""
    listed = materialize(windows(benchmark, window, shingle), "benchmark-windows")
    known = listed.groupBy("words").agg(F.first("tokens").alias("tokens"))
    known = materialize(known.withColumn("wid", F.monotonically_increasing_id()), "windows")
    tokens = known.select(F.explode("tokens").alias("token")).distinct()
    sizes = sorted(r.k for r in known.select(F.least(F.size(F.split("words", " ")), F.lit(shingle)).alias("k")).distinct().collect())  # no more than `shingle` rows
    counted = _counts(docs, sizes, tokens)
    each = known.select("wid", F.posexplode("tokens").alias("k", "token")).join(counted, "token", "left")
    rarest = each.groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "k")).alias("r")).where("r.n > 0")
    chosen = rarest.join(known.select("wid", "words"), "wid").select("wid", "words", "r.token", "r.k")
    links = listed.join(known.select("words", "wid"), "words").select("wid", "item_id").distinct()
    out = materialize(chosen, "window-prefixes"), materialize(links, "window-items")
    release(listed, known)
    return out


class Matcher:
    """Finds the windows of a block in texts."""

    def __init__(self, rows: pa.Table, shingle: int):
        self.words = [w.encode().split(b" ") for w in rows["words"].to_pylist()]
        self.sizes = sorted({min(shingle, len(w)) for w in self.words})
        self.shingle, self.places = shingle, {}
        token = rows["token"].to_numpy().view(np.uint64)
        self.find = Finder(np.unique(token))
        where = np.searchsorted(self.find.known, token)
        for i, (p, k) in enumerate(zip(where.tolist(), rows["k"].to_pylist())):
            self.places.setdefault(p, []).append((i, k))

    def __call__(self, words: Words):
        """(row, first word within the row, words, window's number in the block) of every occurrence."""
        h, row = words.hashes(), None
        for k in self.sizes:
            g, fits = words.grams(h, k)
            at, place = self.find(g)
            ok = fits[at]
            for p, t in zip(at[ok].tolist(), place[ok].tolist()):
                row = words.row() if row is None else row
                r = int(row[p])
                lo, hi = int(words.off[r]), int(words.off[r + 1])
                for i, j in self.places[t]:
                    ws, s = self.words[i], p - j
                    if min(self.shingle, len(ws)) != k or s < lo or s + len(ws) > hi:
                        continue
                    if all(words.raw[words.start[s + q] : words.end[s + q]].tobytes() == ws[q] for q in range(len(ws))):
                        yield r, s - lo, len(ws), i


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """All columns of docs, with n_words, spans (merged, in words, end exclusive) and items (ids with occurring windows)."""
    docs = docs.drop(*OWN)
    chosen, links = plan(docs, benchmark, window, shingle)
    held = chosen.join(links, "wid")
    if (pairs := held.count()) <= block:
        return _annotated(docs, held.groupBy("wid", "words", "token", "k").agg(F.array_sort(F.collect_list("item_id")).alias("ids")), shingle)
    return _joined(docs, chosen, links, shingle, -(-pairs // block))


def _annotated(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """One block: the documents pass once and take their spans and items along."""
    state = docs.sparkSession.sparkContext.broadcast(chosen.toArrow())  # no more than a block
    names = docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"

    def task(batches):
        matcher, ids = Matcher(state.value, shingle), state.value["ids"].to_pylist()
        for batch in batches:
            for run in slices(batch):
                words = _words(run.column("text"))
                hits: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for r, s, n, i in matcher(words):
                    hits.setdefault(r, []).append((s, s + n))
                    items.setdefault(r, set()).update(ids[i])
                found_spans, found_items = [], []
                for r in range(run.num_rows):
                    out: list[dict] = []
                    for a, b in sorted(hits.get(r, ())):
                        if out and a <= out[-1]["end"]:
                            out[-1]["end"] = max(out[-1]["end"], b)
                        else:
                            out.append({"start": a, "end": b})
                    found_spans.append(out)
                    found_items.append(sorted(items.get(r, ())))
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in names), pa.array(np.diff(words.off)), pa.array(found_spans, _SPAN), pa.array(found_items, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])

    return docs.mapInArrow(task, ddl)


def _joined(docs: DataFrame, chosen: DataFrame, links: DataFrame, shingle: int, blocks: int) -> DataFrame:
    """More blocks: a pass for each writes the places found, which are joined with the documents by the text's digest at the end."""
    sc, found = docs.sparkSession.sparkContext, None
    for b in range(blocks):
        state = sc.broadcast(chosen.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b).toArrow())

        def task(batches, state=state):
            matcher, wid = Matcher(state.value, shingle), state.value["wid"].to_pylist()
            for batch in batches:
                for run in slices(batch):
                    text = run.column("text")
                    rows, digests = [], {}
                    for r, s, n, i in matcher(_words(text)):
                        if r not in digests:
                            digests[r] = hashlib.md5(text[r].as_py().encode()).hexdigest()
                        rows.append((digests[r], s, s + n, wid[i]))
                    for lo in range(0, len(rows), 50_000):
                        key, start, end, w = zip(*rows[lo : lo + 50_000])
                        yield pa.RecordBatch.from_pydict({"_key": pa.array(key), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()), "wid": pa.array(w, pa.int64())})

        # Copies of a text find the same; they are made one before they are shuffled.
        got = materialize(docs.select("text").mapInArrow(task, "_key string, start long, end long, wid long").distinct(), "window-places")
        state.destroy()
        found = got if found is None else found.unionByName(got)
    places = found.select("_key", "start", "end").distinct().groupBy("_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    items = found.select("_key", "wid").distinct().join(links, "wid").groupBy("_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = materialize(places.join(items, "_key").withColumn("spans", merged("spans")), "window-hits")  # so that the join may split a text's copies
    text = F.coalesce("text", F.lit(""))
    n_words = F.size(F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))).cast("long")
    out = docs.withColumn("_key", F.md5(text)).withColumn("n_words", n_words).join(hits, "_key", "left").drop("_key")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.withColumn("spans", F.coalesce("spans", none)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def merged(column: str):
    """Overlapping or touching spans made one, natively."""
    pair = "struct<start:bigint,end:bigint>"
    return F.expr(
        f"aggregate(array_sort({column}), cast(array() as array<{pair}>), (acc, x) -> case when size(acc) > 0 and x.start <= element_at(acc, -1).end "
        f"then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) else concat(acc, array(x)) end)"
    )


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )
