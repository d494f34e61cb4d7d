"""Substring deduplication with sharded FM-indexes (operator 1).

A window is `window` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller doc_id.

1. Every window is named by its minimizer, the smallest hash among its word sequences of length `seed`: equal windows
   have equal minimizers, and neighbouring windows mostly share one, so that a document is a few runs of windows.
2. Runs whose minimizer only one document has are done. Equal runs of several documents are one piece from here on,
   with the smallest doc_id of them.
3. Pieces go to shards by their minimizer, so that equal windows meet in one shard. Minimizers with more pieces than
   `heavy` are cut into single windows; equal ones are merged, each task's own before they are sent, and the different ones dealt by their hash. A
   shard therefore holds no window of a heavy minimizer twice, however many documents share it.
4. Each shard builds a compressed FM-index of its pieces and streams them through it by backward search.
   Where the matching statistics reach the window's length, the interval's smallest doc_id is reported.
5. The reported intervals go back to the documents' runs, and a word is removed where a window's smallest doc_id is
   below the document's own.

Null texts have no words. Rows with a null doc_id lose nothing and count for no other row. Rows that repeat a doc_id are judged each
on its own text; equal windows of one doc_id never remove each other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .session import small_batches, stored
from .text import BASE, INVERSE, U, blocks, covered, mix, per_row, powers, windows, word_hashes, words

#: Bits of a word's place in its text: no text that Spark can hold has 2^31 words.
POSITION_BITS = 31


def minimizer_runs(h: np.ndarray, row: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, run hash, first window, windows) of each run of neighbouring windows with one minimizer."""
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(U), none.astype(U), none, none
    with np.errstate(over="ignore"):
        grams = np.zeros(len(h) - seed + 1, U)
        for j in range(seed):
            grams = grams * U(BASE) + h[j : j + len(grams)]
        grams = mix(grams)
        begin = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
        place = np.arange(len(grams)) - begin[np.searchsorted(begin, np.arange(len(grams)), "right") - 1]
        # the hash above, the place below: the smallest is the leftmost of the smallest hashes
        key = ((grams >> U(POSITION_BITS)) << U(POSITION_BITS)) | place.astype(U)
        span, width = window - seed + 1, 1
        least = key
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(key) - span + 1], least[span - width : span - width + len(key) - span + 1])
        ok = row[window - 1 :] == row[:n]
        at = np.flatnonzero(ok)
        if not len(at):
            return none.astype(U), none.astype(U), none, none
        least = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
        first = np.flatnonzero(new)
        start = at[first]
        count = np.diff(np.append(first, len(at)))
        total = np.zeros(len(h) + 1, U)
        np.cumsum(h * powers(BASE, len(h)), out=total[1:])
        end = start + count + window - 1
        content = mix((total[end] - total[start]) * powers(INVERSE, len(h))[start] + count.astype(U))
        where = start - begin[np.searchsorted(begin, start, "right") - 1]
        gram = grams[start + ((least[first] & U((1 << POSITION_BITS) - 1)).astype(np.int64) - where)]
        return gram, content, start, count


def _runs(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, off in blocks(batch.column("text")):
                start, end, row = words(data, off)
                gram, content, first, count = minimizer_runs(word_hashes(data, start, end), row, window, seed)
                owner = row[first]
                begin = np.searchsorted(row, np.arange(b - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array(count.astype(np.int32)), batch.column("doc_id").slice(a, b - a).take(pa.array(owner)), pa.array(tag[a:b][owner]), pa.array((first - begin[owner]).astype(np.int32))],
                    ["gram", "content", "n", "doc_id", "tag", "start"],
                )

    return run


def _pieces(window: int):
    """The words of the wanted pieces of each document, as hashes; heavy ones window by window, under the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for a, b, data, off in blocks(batch.column("text")):
                start, end, row = words(data, off)
                h = word_hashes(data, start, end)
                begin = np.searchsorted(row, np.arange(b - a + 1))
                out: list[tuple] = []
                for r in range(a, b):
                    own = h[begin[r - a] : begin[r - a + 1]]
                    for w in wanted[r]:
                        part = own[w["start"] : w["start"] + w["n"] + window - 1]
                        if w["heavy"]:
                            _, x = windows(part, np.zeros(len(part), np.int64), window)
                            for j, h_j in enumerate(x.view(np.int64).tolist()):
                                out.append((h_j, w["gram"], w["content"], w["n"], j, w["low"], part[j : j + window].tobytes()))
                        else:
                            out.append((w["shard"], w["gram"], w["content"], w["n"], -1, w["low"], part.tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE.types, strict=True)], schema=PIECE)

    return run


PIECE = pa.schema([("shard", pa.int64()), ("gram", pa.int64()), ("content", pa.int64()), ("n", pa.int32()), ("skip", pa.int32()), ("low", pa.int64()), ("words", pa.binary())])


def report(sequences: list[np.ndarray], low: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each sequence the smallest `low` of the sequences that hold it, by one FM-index of them all."""
    sizes = np.array([len(s) for s in sequences])
    names, ids = np.unique(np.concatenate(sequences), return_inverse=True)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = ids + 1
    del ids, names
    index = FMIndex(text, window, np.repeat(low, sizes + 1))
    size, at = index.statistics(text, starts, ends, window)
    found = np.where(size >= window, index.least[index.of[at]], np.iinfo(np.int64).max)
    return [found[s : e - window + 1] for s, e in zip(starts, ends, strict=True)]


def _shard(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gram", "content"], ignore_index=True)
        found = report([np.frombuffer(x, U) for x in pdf["words"]], pdf["low"].to_numpy(np.int64), window)
        count = np.array([len(x) for x in found])
        flat = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), count)
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        who = owner[first]
        inside = first - (np.cumsum(count) - count)[who]
        return pd.DataFrame({"gram": pdf["gram"].to_numpy()[who], "content": pdf["content"].to_numpy()[who], "n": pdf["n"].to_numpy()[who], "first": inside, "last": inside + np.diff(np.append(first, len(flat))) - 1, "least": flat[first]})

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone").to_pylist()
            for a, b, data, off in blocks(batch.column("text")):
                start, end, row = words(data, off)
                n = per_row(np.ones(len(row)), row, b - a)
                raw, removed, digest, texts = data.tobytes(), [], [], []
                for r in range(a, b):
                    own = raw[off[r - a] : off[r - a + 1]].split()
                    drop = 0
                    if gone[r]:
                        at = np.concatenate([np.arange(g["x"], g["y"] + 1) for g in gone[r]])
                        out = covered(int(n[r - a]), at, window)
                        drop = int(out.sum())
                        own = list(compress(own, (~out).tolist()))
                    removed.append(drop)
                    text = b" ".join(own)
                    digest.append(hashlib.sha256(text).hexdigest())
                    texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(removed, pa.int64()), pa.array(digest), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = 8, shard_words: int = 1_000_000, heavy: int = 5_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    # The tables that joins have on their narrow side are written first: of known size, and with nothing between shuffle
    # and join, so that adaptive execution splits a hot minimizer's rows.
    runs = stored(docs.where("doc_id IS NOT NULL").mapInArrow(_runs(window, seed), "gram long, content long, n int, doc_id long, tag long, start int"))
    shared = stored(runs.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram"))
    runs = stored(runs.join(shared, "gram", "left_semi"))
    pieces = runs.groupBy("gram", "content", "n").agg(F.min(F.struct("doc_id", "tag", "start")).alias("m")).select("gram", "content", "n", F.col("m.doc_id").alias("low"), F.col("m.tag").alias("tag"), F.col("m.start").alias("start"))
    pieces = stored(pieces)
    crowded = stored(pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > heavy).select("gram", F.lit(True).alias("heavy")))
    total = pieces.agg(F.sum((F.col("n") + window).cast("long"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("gram"), F.lit(max(1, -(-total // shard_words))))
    dealt = pieces.join(crowded, "gram", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    wanted = dealt.groupBy(F.col("low").alias("doc_id"), "tag").agg(F.collect_list(F.struct(shard.alias("shard"), "gram", "content", "n", "start", "low", "heavy")).alias("wanted"))
    held = stored(docs.where("doc_id IS NOT NULL").join(wanted, ["doc_id", "tag"]).select("text", "wanted").mapInArrow(_pieces(window), "shard long, gram long, content long, n int, skip int, low long, words binary"))
    reported = "gram long, content long, n int, first long, last long, least long"
    found = held.where("skip < 0").groupBy("shard").applyInPandas(_shard(window), reported)
    # windows of heavy minimizers: one row each different one
    single = held.where("skip >= 0").groupBy(F.col("shard").alias("gram"), "words").agg(F.min("low").alias("low")).withColumns({"content": F.lit(0).cast("long"), "n": F.lit(1)})
    single = stored(single)
    shards = max(1, -(-single.count() * (window + 1) // shard_words))
    known = single.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy("shard").applyInPandas(_shard(window), reported)
    known = stored(known.groupBy(F.col("gram").alias("shard")).agg(F.min("least").alias("least")))
    place = F.col("skip").cast("long")
    back = held.where("skip >= 0").select("shard", "gram", "content", "n", "skip").join(known, "shard").select("gram", "content", "n", place.alias("first"), place.alias("last"), "least")
    least = stored(found.unionByName(back))
    hit = runs.join(least, ["gram", "content", "n"]).where("least < doc_id")
    gone = hit.groupBy("doc_id", "tag").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("x"), (F.col("start") + F.col("last")).alias("y"))).alias("gone"))
    return docs.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "gone").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept_text")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
v AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM v),
f AS (SELECT doc_id, i, CAST(min(doc_id) OVER (PARTITION BY h) < doc_id AS INTEGER) AS hit FROM k),
c AS (SELECT p.doc_id, p.i, word, coalesce(max(hit) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i),
g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
