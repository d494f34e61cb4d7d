"""Quality rules with host-level verdicts (operator 5).

Each document's rule counts come from its whole text. Documents that fail a base rule are counted by host, hosts'
failure rates are shrunk towards the corpus by a beta prior that is fitted to all hosts by the method of moments, and hosts
whose shrunk rate is above `most` lose all their documents; the verdict goes back to the documents in a join that
Spark broadcasts only if the table of hosts is small.

Counts are per row, so that repeated rows count each. A null host is a host of its own. Null and empty texts have no
words and fail. A null doc_id is no key here and changes nothing. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small_batches, stored
from .text import SPACE, U, blocks, mix, per_row, windows, word_hashes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False  # continuation bytes start no code point
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _seen_before(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys within rows: whether an equal one came before, and whether there is an equal one at all."""
    with np.errstate(over="ignore"):
        both = mix(key + mix(row.astype(U) + U(1)))
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    later, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return later, shared


def counts(data: np.ndarray, off: np.ndarray, window: int = 8) -> list[np.ndarray]:
    n = len(off) - 1
    start, end, row = words(data, off)
    h = word_hashes(data, start, end)
    ink = ~SPACE[data]
    rows = np.repeat(np.arange(n), np.diff(off))
    chars = np.bincount(rows[ink & LEAD[data]], minlength=n)
    symbols = np.bincount(rows[SYMBOL[data]], minlength=n)
    # lines: cut at \n and at the ends of texts, compared byte by byte through their hashes
    edge = np.unique(np.concatenate((off, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1)))
    s, e = edge[:-1], edge[1:]
    line = data[s] != 10 if len(s) else np.zeros(0, bool)
    s, e = s[line], e[line]
    inked = np.concatenate(([0], np.cumsum(ink)))
    some = inked[e] > inked[s]
    s, e = s[some], e[some]
    at = rows[s] if len(s) else np.zeros(0, np.int64)
    later, _ = _seen_before(word_hashes(data, s, e), at)
    first, w = windows(h, row, window)
    _, shared = _seen_before(w, row[first])
    d = np.zeros(len(h) + 1, np.int64)
    hit = first[shared]
    d[: len(h)] += np.bincount(hit, minlength=len(h))[: len(h)]
    d -= np.bincount(hit + window, minlength=len(h) + 1)[: len(h) + 1]
    repeated = np.cumsum(d[: len(h)]) > 0
    return [per_row(np.ones(len(row)), row, n), chars, symbols, np.bincount(at[later], minlength=n), np.bincount(row[repeated], minlength=n)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in blocks(batch.column("text")):
            values = [pa.array(v.astype(np.int64)) for v in counts(data, off)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("host").slice(a, b - a), *values], ["doc_id", "host", *NAMES])


def host_rates(judged: DataFrame, pooled: float = 1e6) -> DataFrame:
    """host, documents, failures, rate (shrunk) from judged (host, base_failed).

    pooled: the prior's strength, in documents, where the hosts' rates differ no more than chance has it: all get nearly the mean."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.count_if("base_failed").alias("failures"))
    # moments of the hosts' rates, weighted by documents: mean m, and the variance between hosts beyond chance
    rate = F.col("failures") / F.col("documents")
    t = hosts.agg(F.sum("documents").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.col("documents") * rate * rate).alias("s"), F.sum(F.col("documents") * F.col("documents")).alias("q")).first()
    n, f, k = t["n"] or 0, t["f"] or 0, t["k"]
    mean = f / n if n else 0.0
    strength = pooled
    if k > 1 and 0 < mean < 1:
        between = ((t["s"] - n * mean * mean) - (k - 1) * mean * (1 - mean)) / (n - t["q"] / n)
        if between > 0:
            strength = max(1.0, mean * (1 - mean) / between - 1)
    return hosts.withColumn("rate", (F.col("failures") + mean * strength) / (F.col("documents") + strength))


def judge(docs: DataFrame, host: str, most: float = 0.5, fewest_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """doc_id, host, counts, base_failed, host_rate, kept for each row of docs (doc_id, text, and the column `host`)."""
    small_batches(docs.sparkSession)
    types = ", ".join(f"{c} long" for c in NAMES)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(host).cast("string").alias("host")).mapInArrow(_counted, f"doc_id long, host string, {types}")
    judged = stored(counted.withColumn("base_failed", (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))))
    rates = host_rates(judged).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    out = judged.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source").drop("host").withColumn("host_rate", F.round("host_rate", 6))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
v AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, CASE WHEN i <= len(ws) - 7 THEN md5(array_to_string(ws[i:i + 7], ' ')) END AS h FROM v),
r AS (SELECT doc_id, i, CAST(h IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h) > 1 AS INTEGER) AS hit FROM k),
c AS (SELECT doc_id, sum(cov) AS n FROM (SELECT doc_id, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS cov FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS d, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM j GROUP BY source),
t AS (SELECT sum(d) AS n, sum(f) / sum(d) AS m, count(*) AS k, sum(f * f / d) AS s, sum(d * d) AS q FROM h),
u AS (SELECT m, CASE WHEN k > 1 AND m > 0 AND m < 1 THEN ((s - n * m * m) - (k - 1) * m * (1 - m)) / (n - q / n) ELSE 0 END AS b FROM t),
z AS (SELECT m, CASE WHEN b > 0 THEN greatest(1, m * (1 - m) / b - 1) ELSE 1e6 END AS st FROM u),
rt AS (SELECT source, (f + m * st) / (d + st) AS rate FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept FROM j JOIN rt ON rt.source IS NOT DISTINCT FROM j.source
"""
