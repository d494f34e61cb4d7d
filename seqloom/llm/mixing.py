"""Mixing sources to target weights (operator 4).

The words of each source, in an order fixed by the documents' ids, are cut into blocks of `block` words. Every output
shard draws how many of its slots each source fills from a multinomial with the target shares; the slots of a source
are numbered through the shards, up to its quota, and a closing shard takes what the draws left over. Slot j of a source with n blocks
is block p(j mod n) of round j div n, where p is a pseudorandom permutation of that source and round (a Feistel
network on the numbers of the full blocks; a source's last block, if short, is the last of its round, so that targets
are met to the word). Slots meet blocks in a join on (source, block).

A null source is a source of its own, the last in order; null texts have no words, and documents without words take
none. Repeated rows count each. Documents with a null doc_id are mixed like others. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import small_batches, stored
from .text import U, mix

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 1024


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words for each source: share * all words by weight; none above most * its size, the excess going to the others by weight."""
    total, out, full = share * sum(sizes), [0.0] * len(sizes), set()
    while len(full) < len(sizes):
        rest = total - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        out = [most * sizes[i] if i in full else rest * w / weight for i, w in enumerate(weights)]
        above = {i for i in range(len(sizes)) if i not in full and out[i] > most * sizes[i]}
        if not above:
            break
        full |= above
    return [most * n if i in full else x for i, (n, x) in enumerate(zip(sizes, out, strict=True))]


def running_totals(df: DataFrame, group: str, bucket: str, order: Sequence[str], value: str, buckets: int) -> DataFrame:
    """df with `before`, the sum of value over earlier rows of its group, in order of (bucket, *order).

    buckets: above any bucket's number. A group's buckets are summed range by range, at most `RANGES` of them; only the
    ranges' totals meet in one task, then the buckets of a range, then the rows of a bucket."""
    width = max(1, -(-buckets // RANGES))
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum")).withColumn("_range", F.floor(F.col(bucket) / width))
    tops = sums.groupBy(group, "_range").agg(F.sum("_sum").alias("_top"))
    tops = tops.select(group, "_range", (F.sum("_top").over(Window.partitionBy(group).orderBy("_range")) - F.col("_top")).alias("_start"))
    inside = F.sum("_sum").over(Window.partitionBy(group, "_range").orderBy(bucket)) - F.col("_sum")
    sums = sums.withColumn("_base", inside).join(tops, [group, "_range"]).select(group, bucket, (F.col("_start") + F.col("_base")).alias("_base"))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum(value).over(inner) - F.col(value)).join(sums, [group, bucket]).withColumn("before", F.col("_base") + F.col("_in")).drop("_in", "_base")


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at index: six Feistel rounds, walked until the result is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    out, at = index.astype(U), np.arange(len(index))
    while len(at):
        x = out[at]
        left, right = x >> U(half), x & mask
        with np.errstate(over="ignore"):
            for r in range(6):
                left, right = right, left ^ (mix(right + mix(np.array([key * 8 + r], U))) & mask)
        out[at] = (left << U(half)) | right
        at = at[out[at] >= U(n)]
    return out.astype(np.int64)


def _drawn(shares: list[float], slots: int, per_shard: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"].tolist():
                counts = np.random.default_rng([seed, s]).multinomial(min(per_shard, slots - s * per_shard), shares)
                yield pd.DataFrame({"src": np.arange(len(shares)), "shard": s, "n": counts})

    return run


def _slots(block: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                j = np.arange(r.first, r.end)
                turn = j // r.blocks
                to = np.empty(len(j), np.int64)
                for t in np.unique(turn):
                    i = j[turn == t] % r.blocks
                    i[i < r.blocks - 1] = permuted(i[i < r.blocks - 1], r.blocks - 1, seed * 1_000_003 + r.src * 1009 + int(t))
                    to[turn == t] = i
                yield pd.DataFrame({"src": r.src, "shard": r.shard, "slot": j, "turn": turn, "blk": to, "words": np.where(j == r.quota - 1, r.last, block)})

    return run


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 512, per_shard: int = 1 << 14, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents, takes). documents: doc_id, text_hash, src, size, source_size, target, before (its words' place in the
    source). takes: src, shard, slot, turn, blk, words: the slots of the mix, each with the block that fills it and the
    number of its words used. weights repeat over the sources in order of code points."""
    spark = docs.sparkSession
    small_batches(spark)
    sized = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    # one row a source, as many as the mix has weights for
    found = sorted(((r[0], r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    aims = targets([r[1] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    plan = []
    for i, ((name, size, _), aim) in enumerate(zip(found, aims, strict=True)):
        n = -(-size // block)
        turns, rest = divmod(round(aim), size) if size else (0, 0)
        more = -(-rest // block)
        plan.append((i, name, size, float(aim), n, turns * n + more, rest - (more - 1) * block if more else block))
    sources = spark.createDataFrame(plan or [], "src int, source string, source_size long, target double, blocks long, quota long, last long")
    placed = sized.join(sources.select("src", "source", "source_size", "target").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    buckets = max(1, sum(r[2] for r in found) // 1024)
    placed = running_totals(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))), "src", "bucket", ["doc_id", "text_hash"], "size", buckets).drop("bucket")
    slots = sum(p[5] for p in plan)
    shards = -(-slots // per_shard)
    shares = [p[5] / slots for p in plan] if slots else []
    draws = spark.range(0, shards, 1, max(1, min(shards, 1000))).mapInPandas(_drawn(shares, slots, per_shard, seed), "src int, shard long, n long")
    draws = draws.unionByName(sources.select("src", F.lit(shards).cast("long").alias("shard"), F.col("quota").alias("n")))  # the closing shard could fill any quota
    numbered = running_totals(draws.withColumn("bucket", F.floor(F.col("shard") / 1024)), "src", "bucket", ["shard"], "n", shards // 1024 + 1).join(sources, "src")
    runs = numbered.select("src", "shard", "blocks", "quota", "last", F.col("before").alias("first"), F.least("quota", F.col("before") + F.col("n")).alias("end")).where("first < end")
    runs = runs.withColumn("first", F.explode(F.sequence("first", F.col("end") - 1, F.lit(per_shard).cast("long")))).withColumn("end", F.least("end", F.col("first") + per_shard))
    # a run of few bytes becomes `per_shard` slots: as many tasks as there are runs, about, whatever their bytes
    runs = runs.repartition(max(1, min(shards + len(plan), 10_000)), "src", "first")
    takes = runs.mapInPandas(_slots(block, seed), "src int, shard long, slot long, turn long, blk long, words long")
    return placed, takes


def _overlaps(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in: blk, x, y: its words are those from x to y of the block."""
    last = F.col("before") + F.col("size")
    cut = placed.where("size > 0").withColumn("blk", F.explode(F.sequence(F.floor(F.col("before") / block), F.floor((last - 1) / block))))
    return cut.withColumn("x", F.greatest(F.col("before") - F.col("blk") * block, F.lit(0))).withColumn("y", F.least(last - F.col("blk") * block, F.lit(block)))


def taken(docs: DataFrame, block: int = 512, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, text, source)."""
    placed, takes = mixed(docs, block=block, **parameters)
    uses = takes.groupBy("src", "blk").agg(F.count_if(F.col("words") == block).alias("whole"), F.coalesce(F.max(F.when(F.col("words") < block, F.col("words"))), F.lit(0)).alias("part"))
    got = _overlaps(placed, block).join(uses, ["src", "blk"]).select("doc_id", "text_hash", "src", "before", (F.col("whole") * (F.col("y") - F.col("x")) + F.greatest(F.least("y", "part") - F.col("x"), F.lit(0))).alias("w"))
    kept = placed.select("doc_id", "text_hash", "src", "before", "size", "source_size", "target", F.lit(0).cast("long").alias("w"))
    zero = F.lit(None).cast("long")
    rows = kept.unionByName(got.withColumns({"size": zero, "source_size": zero, "target": F.lit(None).cast("double")}))
    one = rows.where("size IS NULL OR size > 0").groupBy("doc_id", "text_hash", "src", "before").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("w").cast("long").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return one.select(columns).unionByName(kept.where("size = 0").select("doc_id", "size", "source_size", "target", F.col("w").alias("taken")))


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, size: pd.Series, spans: pd.Series) -> pd.Series:
    import re

    out = []
    for t, n, xs in zip(text, size, spans, strict=True):
        if sum(x["y"] - x["x"] for x in xs) == n:
            out.append(t)
            continue
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        joined: list[list[int]] = []
        for x in sorted((int(x["x"]), int(x["y"])) for x in xs):
            if joined and joined[-1][1] == x[0]:
                joined[-1][1] = x[1]
            else:
                joined.append(list(x))
        out.append(" ".join(t[at[x][0] : at[y - 1][1]] for x, y in joined))
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame, block: int = 512, **parameters) -> DataFrame:
    """The mix as documents: a row of docs for each round in which it is drawn, with the words drawn in that round (the
    whole text where all are). Rows that repeat a doc_id and its text stand as one, with the takes of all."""
    placed, takes = mixed(docs, block=block, **parameters)
    got = _overlaps(placed, block).join(takes, ["src", "blk"]).withColumn("y", F.least("y", "words")).where("x < y")
    start = F.col("blk") * block - F.col("before")
    spans = got.groupBy("doc_id", "text_hash", "before", "size", "turn").agg(F.collect_list(F.struct((start + F.col("x")).alias("x"), (start + F.col("y")).alias("y"))).alias("spans"))
    keyed = docs.withColumn("_mix_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_mix_hash"])
    spans = spans.select(F.col("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_text"), F.col("size").alias("_mix_size"), F.col("spans").alias("_mix_spans"))
    out = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["_mix_id"]) & (F.col("_mix_hash") == F.col("_mix_text")))
    out = out.withColumn("text", _cut("text", "_mix_size", "_mix_spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
