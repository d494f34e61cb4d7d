"""Language identification by multilingual mixtures (operator 3).

A model of byte n-grams (orders 1 to 4, hashed to a fixed number of cells, additively smoothed, orders mixed) is
counted for each language on at most about `most_learned` labelled documents, a documented bound on the classifier's
sample; its table has a fixed size, so it may go to every task.

A document is cut into segments of a few words; the model gives each segment a likelihood under each language. Expectation-maximisation
estimates the proportions of the languages in the mixture. The set of languages is chosen by penalised likelihood: it
starts from the best single one and takes in, one at a time, the language that raises the mixture's likelihood most,
while that is worth more than `penalty` * ln(segments) for the additional proportion. The document's language is the
one with the largest proportion, its score that proportion times the certainty of the likelihoods.

Texts that are null or have no letter are `und` with score 0. Repeated rows are judged each; a null doc_id is judged
and not learned from. Without labelled rows every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small_batches
from .text import LOWER, SPACE, blocks, words

ORDERS = (1, 2, 3, 4)
CELL_BITS = 15
UNKNOWN = "und"
#: Bytes that count as letters when ASCII; other letters are looked for in the text itself.
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def cells(data: np.ndarray, order: int) -> np.ndarray:
    """The cell of the n-gram that begins at each byte (white space folded to one byte), the last ones padded."""
    x = np.where(SPACE[data], 32, LOWER[data]).astype(np.uint32)
    x = np.append(x, np.full(order, 32, np.uint32))
    code = np.zeros(len(data), np.uint32)
    for j in range(order):
        code |= x[j : j + len(data)] << np.uint32(8 * j)
    if order == 1:
        return code.astype(np.int64)
    with np.errstate(over="ignore"):
        return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELL_BITS)).astype(np.int64)


def _counts(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(languages), len(ORDERS), 1 << CELL_BITS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = [place[x] for x in batch.column("lang").to_pylist()]
            for a, b, data, off in blocks(batch.column("text")):
                of = np.repeat(np.array(lang[a:b]), np.diff(off))
                for k, order in enumerate(ORDERS):
                    c = np.bincount(of * (1 << CELL_BITS) + cells(data, order), minlength=len(languages) << CELL_BITS)
                    table[:, k] += c.reshape(len(languages), -1)
        lang, k, cell = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(table[lang, k, cell])], ["lang", "k", "cell", "n"])

    return run


def learn(docs: DataFrame, learn_from: Column, most_learned: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Languages, and per byte log-likelihoods [order, cell, language]."""
    marked = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn_from)
    sizes = {r[0]: r[1] for r in marked.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((len(ORDERS), 1 << CELL_BITS, 0), np.float32)
    each = most_learned / len(languages)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, each / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    counted = marked.where(place < share).select("lang", "text").mapInArrow(_counts(languages), "lang int, k int, cell int, n long").groupBy("lang", "k", "cell").agg(F.sum("n").alias("n"))
    table = np.zeros((len(ORDERS), 1 << CELL_BITS, len(languages)))
    got = counted.toPandas()  # at most languages * orders * cells rows
    table[got["k"], got["cell"], got["lang"]] = got["n"]
    alpha = 0.5
    total = table.sum(axis=1, keepdims=True)
    live = np.maximum((table.sum(axis=2, keepdims=True) > 0).sum(axis=1, keepdims=True), 1)
    return languages, np.log((table + alpha) / (total + alpha * live)).astype(np.float32)


def mixtures(lik: np.ndarray, doc: np.ndarray, n: int, penalty: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [document, language] of the chosen sets for segments' log-likelihoods lik [segment, language], and
    the posterior of each document's best single language."""
    k = lik.shape[1]
    segments = np.bincount(doc, minlength=n)
    some = np.flatnonzero(segments)
    at = np.concatenate(([0], np.cumsum(segments[some])))[:-1]
    top = lik.max(axis=1, keepdims=True)
    p = np.exp(lik - top)
    alone = np.full((n, k), 0.0)
    alone[some] = np.add.reduceat(lik - top, at, axis=0) if len(some) else 0
    best = alone.argmax(axis=1)
    value = alone[np.arange(n), best]
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    share = chosen.astype(float)
    certain = 1 / np.exp(np.maximum(alone - value[:, None], -700)).sum(axis=1)
    open_ = segments >= 2
    for _ in range(k - 1):
        ids = np.flatnonzero(open_)
        if not len(ids):
            break
        new_value, new_share, new_set = np.full(n, -np.inf), share.copy(), chosen.copy()
        for add in range(k):
            docs = ids[~chosen[ids, add]]
            if not len(docs):
                continue
            pick = np.zeros(n, bool)
            pick[docs] = True
            rows = np.flatnonzero(pick[doc])
            local = np.searchsorted(docs, doc[rows])
            begin = np.searchsorted(local, np.arange(len(docs)))
            sets = chosen[docs].copy()
            sets[:, add] = True
            theta = sets / sets.sum(axis=1, keepdims=True)
            q = p[rows] * sets[local]
            for _ in range(rounds):
                r = q * theta[local]
                r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
                theta = np.add.reduceat(r, begin, axis=0) / segments[docs, None]
            ll = np.add.reduceat(np.log(np.maximum((q * theta[local]).sum(axis=1), 1e-300)), begin)
            better = ll > new_value[docs]
            d = docs[better]
            new_value[d], new_share[d], new_set[d] = ll[better], theta[better], sets[better]
        gain = new_value - value - penalty * np.log(np.maximum(segments, 2))
        open_ &= gain > 0
        value = np.where(open_, new_value, value)
        share[open_], chosen[open_] = new_share[open_], new_set[open_]
    return share, certain


def _predict(languages: list[str], table: np.ndarray, segment_words: int, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in blocks(batch.column("text"), 1 << 19):
                n = b - a
                start, end, row = words(data, off)
                letters = np.concatenate(([0], np.cumsum(ASCII_LETTER[data])))
                has = letters[off[1:]] > letters[off[:-1]]
                raw = data.tobytes()
                for r in np.flatnonzero(~has & (np.diff(off) > 0)):
                    has[r] = any(c.isalpha() for c in raw[off[r] : off[r + 1]].decode("utf-8", "replace"))
                name, score = [UNKNOWN] * n, np.zeros(n)
                if languages and len(start):
                    begin = np.searchsorted(row, np.arange(n))
                    cut = np.flatnonzero((np.arange(len(row)) - begin[row]) % segment_words == 0)
                    doc = row[cut]
                    lik = np.zeros((len(cut), len(languages)), np.float32)
                    for k, order in enumerate(ORDERS):
                        lik += np.add.reduceat(table[k][cells(data, order)], start[cut], axis=0)
                    # n-grams overlap: an order's likelihoods are averaged, and tempered by its length
                    share, certain = mixtures(lik.astype(float) / (len(ORDERS) * 2.0), doc, n, penalty)
                    which = share.argmax(axis=1)
                    score = np.where(has, np.clip(share.max(axis=1) * certain, 0, 1), 0.0)
                    name = [languages[w] if ok else UNKNOWN for w, ok in zip(which.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learn_from: Column, most_learned: int = 8_000, segment_words: int = 8, penalty: float = 2.0, seed: int = 5) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text, lang); lang is read only where learn_from holds."""
    small_batches(docs.sparkSession)
    languages, table = learn(docs, learn_from, most_learned, seed)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_predict(languages, table, segment_words, penalty), "doc_id long, lang_pred string, score double")


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(4) != 2)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
