"""Toxicity scores (operator 6): gradient-boosted trees over dense text features, with isotonic calibration.

Labelled rows for training are those of the folds that may be learned from; at most about `most_labelled` of them, chosen by
a hash of the doc_id, are read (a bound on the classifier's sample only). From half of them a lexicon is counted:
words and word beginnings whose share among toxic documents is far above their share among others. The other half, on
which the lexicon was not fitted, trains Spark ML's gradient-boosted trees and the isotonic calibration, a third of it for the latter. Every document
is then scored on its whole text.

Features: lexicon densities by whole word and by word beginning (also with look-alike digits and signs folded to
letters and inner punctuation dropped), the strongest and the summed weights, hits near words of the second person, capitals, punctuation,
obfuscation rates and length. Null and empty texts get the features of an empty text, so a score as well. If no
labelled row, or only one class, can be learned from, the score is the share of toxic rows (0 without any).
Labels that repeat a doc_id count each; a null doc_id has no label and is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small_batches, stored
from .text import LOWER, U, blocks, mix, word_hashes, words

NAMES = ["n_words", "word_density", "word_sum", "word_max", "stem_density", "stem_sum", "stem_max", "folded_sum", "near_second_person", "second_person", "capitals", "punctuation", "obfuscation", "mean_word"]
STEMS = (4, 5, 6)
#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
#: Signs that stand for letters in obfuscated words.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
FOLD = LOWER.copy()
for _a, _b in LOOKALIKE.items():
    FOLD[ord(_a)] = ord(_b)


def trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without punctuation at their ends (all of a word's, if it has nothing else)."""
    start, end = start.copy(), end.copy()
    going = np.arange(len(start))
    while len(going):
        going = going[(start[going] < end[going]) & PUNCTUATION[data[np.minimum(start[going], len(data) - 1)]]]
        start[going] += 1
    going = np.arange(len(start))
    while len(going):
        going = going[(start[going] < end[going]) & PUNCTUATION[data[end[going] - 1]]]
        end[going] -= 1
    return start, end


def tagged(h: np.ndarray, tag: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + U(tag + 1) * U(0x9E3779B97F4A7C15))


def terms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(tag, indices of words, hashes): whole words under tag 0, beginnings of n bytes under tag n; lower case."""
    low = LOWER[data]
    s, e = trimmed(low, start, end)
    some = np.flatnonzero(s < e)
    s, e = s[some], e[some]
    out = [(0, some, tagged(word_hashes(low, s, e), 0))]
    for n in STEMS:
        long = np.flatnonzero(e - s > n)
        out.append((n, some[long], tagged(word_hashes(low, s[long], s[long] + n), n)))
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a term, by task."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, off in blocks(batch.column("text")):
            start, end, row = words(data, off)
            got = []
            for _, i, h in terms(data, start, end):
                order = np.lexsort((h, row[i]))
                hs, rs = h[order], row[i][order]
                first = np.ones(len(hs), bool)
                first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
                got.append((hs[first], rs[first]))
            h, r = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
            distinct, inverse = np.unique(h, return_inverse=True)
            bad = np.bincount(inverse, weights=toxic[a:b][r], minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((np.bincount(inverse, minlength=len(distinct)) - bad).astype(np.int64))], ["term", "bad", "good"])


def _features(lexicon: list[tuple[int, float]]):
    pairs = sorted((np.int64(h).view(U), w) for h, w in lexicon)
    keys, weights = np.array([k for k, _ in pairs], U), np.array([w for _, w in pairs])

    def weight(h: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, weights[at], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [w.encode() for w in SECOND_PERSON]
        ends = np.cumsum([len(w) for w in raw])
        person = np.sort(tagged(word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends), 0))
        for batch in batches:
            for a, b, data, off in blocks(batch.column("text")):
                n = b - a
                start, end, row = words(data, off)
                sums = lambda v, i=slice(None): np.bincount(row[i], weights=v, minlength=n)  # noqa: E731, B023

                def highest(v: np.ndarray, i: np.ndarray) -> np.ndarray:
                    out = np.zeros(n)  # noqa: B023
                    hit = np.flatnonzero(v)
                    np.maximum.at(out, row[i[hit]], v[hit])  # noqa: B023
                    return out

                count = np.bincount(row, minlength=n).astype(float)
                per = np.maximum(count, 1)
                found = terms(data, start, end)
                _, i0, h0 = found[0]
                w0 = weight(h0)
                stems = np.zeros(len(start))
                for _, i, h in found[1:]:
                    np.maximum.at(stems, i, weight(h))
                hit = np.zeros(len(start))
                hit[i0] = w0
                second = np.zeros(len(start), bool)
                if len(h0):
                    second[i0] = person[np.minimum(np.searchsorted(person, h0), len(person) - 1)] == h0
                strong = np.maximum(hit, stems) > 0
                near = np.zeros(len(start), bool)
                for k in range(1, 4):
                    same = row[k:] == row[:-k]
                    near[k:] |= strong[k:] & second[:-k] & same
                    near[:-k] |= strong[:-k] & second[k:] & same
                # words in which letters mix with digits or signs, and what they read as
                before = lambda table: np.concatenate(([0], np.cumsum(table[data])))  # noqa: E731, B023
                ts, te = trimmed(data, start, end)
                let, dig, pun = before(LETTER), before(DIGIT), before(PUNCTUATION)
                odd = (let[te] > let[ts]) & ((dig[te] > dig[ts]) | (pun[te] > pun[ts]))
                fold = np.flatnonzero(odd)
                folded = np.zeros(len(start))
                if len(fold):
                    plain = [bytes(FOLD[data[ts[i] : te[i]]]).translate(None, b".-_*'") for i in fold.tolist()]
                    stop = np.cumsum([len(x) for x in plain])
                    flat = np.frombuffer(b"".join(plain), np.uint8)
                    begin = stop - [len(x) for x in plain]
                    whole = np.flatnonzero(begin < stop)
                    folded[fold[whole]] = weight(tagged(word_hashes(flat, begin[whole], stop[whole]), 0))
                byte = lambda table: np.add.reduceat(np.append(table[data].astype(np.int64), 0), np.minimum(off[:-1], len(data))) * (np.diff(off) > 0)  # noqa: E731, B023
                size = np.maximum(np.diff(off), 1)
                upper = np.zeros(256, bool)
                upper[65:91] = True
                values = [
                    count, sums(hit > 0) / per, sums(hit), highest(w0, i0), sums(stems > 0) / per, sums(stems), highest(stems, np.arange(len(start))),
                    sums(folded), sums(near), sums(second) / per, byte(upper) / size, byte(PUNCTUATION) / size, sums(odd) / per, size / per,
                ]
                rest = [batch.column(c).slice(a, n) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(np.asarray(v, float)) for v in values)], [*(c for c in batch.schema.names if c != "text"), *NAMES])

    return run


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, most_labelled: int = 20_000, lexicon_terms: int = 4096, seed: int = 3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (0 or 1) for each row of docs (doc_id, text).

    labels: doc_id, toxic. learn_from: which rows may be learned from, by doc_id. most_labelled: about how many
    labelled rows are read for training. lexicon_terms: the most terms of the lexicon, which goes to all tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learn_from)
    n = marked.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    sample = marked.where(place < min(1.0, most_labelled / max(n, 1)))
    sample = stored(docs.join(sample, "doc_id").select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(6)).cast("int").alias("part")))
    seen = {(r[0], r[1]): r[2] for r in sample.groupBy(F.col("part") < 3, "toxic").count().collect()}
    share = sum(v for (_, y), v in seen.items() if y) / max(sum(seen.values()), 1)
    one = all(seen.get((half, y), 0) for half in (True, False) for y in (0, 1))
    if not one:
        return docs.select("doc_id", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    bad, good = seen[True, 1], seen[True, 0]
    counted = sample.where("part < 3").select("text", "toxic").mapInArrow(_frequencies, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    top = counted.where(f"bad >= {max(3, bad // 500)}").select("term", odds.alias("w"), "bad").where("w > 2").orderBy(F.desc(F.col("w") * F.log1p("bad")), "term").limit(lexicon_terms).collect()
    featured = _features([(r[0], float(r[1])) for r in top])
    types = ", ".join(f"{c} double" for c in NAMES)
    rows = stored(sample.where("part >= 3").select("doc_id", "toxic", "part", "text").mapInArrow(featured, f"doc_id long, toxic int, part int, {types}"))
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features")
    rows = vectors.transform(rows)
    fit = rows.where("part < 5")
    positive = fit.where("toxic = 1").count()
    if not 0 < positive < fit.count():
        fit = rows
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, seed=seed).fit(fit)
    margin = F.element_at(vector_to_array("rawPrediction"), 2)
    held = trees.transform(rows.where("part = 5")).select(margin.alias("margin"), F.col("toxic").cast("double").alias("y"))
    # calibrated by a step function of at most one step a held-back row
    steps = IsotonicRegression(featuresCol="margin", labelCol="y").fit(held) if held.count() else None
    features = vectors.transform(docs.mapInArrow(featured, f"doc_id long, {types}"))
    out = trees.transform(features).select("doc_id", margin.alias("margin"))
    out = steps.transform(out).withColumnRenamed("prediction", "score") if steps else out.select("doc_id", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score"))
    # steps are flat over wide ranges: a millionth of the raw margin's chance keeps the order inside them
    fine = 1 / (1 + F.exp(-2 * F.col("margin"))) if steps else F.col("score")
    value = ((1 - 1e-6) * F.col("score") + 1e-6 * fine) if steps else F.col("score")
    return out.select("doc_id", value.alias("score")).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, labels, fold(5) != 0)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
