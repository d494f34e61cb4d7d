"""Statistics of an evaluation: rank tests with Holm's correction, intervals of the area under a curve by a bootstrap
over speakers, DeLong's comparison of two scores, error correlation, the gate that uses them.

Rows meet in one task only as ranges of a score. Rows with a null score or class take no part."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import two_sided_p, z_threshold
from ..sources.shared import stored
from . import decisions

U = np.uint64


def running(rows: DataFrame, keys: list[str], order: list[str], sums: list[str], per_task: int = 100_000) -> DataFrame:
    """With before_<c> for each of `sums`: the sum of c over the rows of the same keys that come before in the order.
    Rows are dealt by ranges of keys and order, so that a key may hold any number of them; only the ranges' sums meet."""
    ranged = stored(rows.repartitionByRange(max(1, -(-rows.count() // per_task)), *keys, *order).withColumn("_r", F.spark_partition_id()))
    first = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_r", *keys).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums)).select("_r", *keys, *(F.coalesce(F.sum(f"_t_{c}").over(first), F.lit(0)).alias(f"_o_{c}") for c in sums))
    inner = Window.partitionBy("_r", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums})
    return own.join(offsets, ["_r", *keys]).withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_o_{c}") for c in sums}).drop("_r", *(f"_o_{c}" for c in sums))


def rank_tests(rows: DataFrame, keys: list[str], value: str, y: str, continuity: bool = True) -> DataFrame:
    """keys, n1 (rows with y = 1), n0, u (of y = 1), z, p (two-sided): Mann and Whitney's test in each group, by mid-ranks,
    with the variance corrected for ties. z and p are null where a class is empty or all values are equal."""
    some = rows.where(F.col(value).isNotNull() & F.col(y).isNotNull())
    by = some.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) != 1).alias("_n"))
    t = (F.col("_p") + F.col("_n")).cast("double")
    total = running(by, keys, ["_v"], ["_n"]).groupBy(*keys).agg(
        F.sum("_p").alias("n1"), F.sum("_n").alias("n0"), F.sum(F.col("_p") * (F.col("before__n") + F.col("_n") / 2.0)).alias("u"), F.sum(t * t * t - t).alias("_ties")
    )
    n, both = F.col("n1") + F.col("n0"), F.col("n1").cast("double") * F.col("n0")
    variance = F.when(n > 1, both / 12 * (n + 1 - F.col("_ties") / (n.cast("double") * (n - 1))))
    off = F.col("u") - both / 2
    shift = F.signum(off) * F.least(F.abs(off), F.lit(0.5)) if continuity else F.lit(0.0)
    z = F.when(variance > 0, (off - shift) / F.sqrt(variance))
    return total.select(*keys, "n1", "n0", "u", z.alias("z"), two_sided_p(z).alias("p"))


def holm(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """With p_holm: step-down adjusted p-values over the tests of each family (few rows); null p stays null and counts for nothing."""
    some = F.col(p).isNotNull()
    order = Window.partitionBy(*family, some).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*family))
    stepped = tests.withColumn("_s", F.when(some, F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))))
    return stepped.withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


#: Cumulated probabilities of a Poisson variable of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def poisson_weights(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """[rows, replicates] Poisson draws of mean 1 that depend on a row's hash, the replicate and the seed only."""
    with np.errstate(over="ignore"):
        keys = mixed(np.arange(1, replicates + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    share = (mixed(mixed(hashes.astype(np.int64).view(U))[:, None] ^ keys) >> U(11)) * 2.0**-53
    return np.searchsorted(POISSON, share.ravel(), "right").reshape(share.shape).astype(float)


def _tallied(replicates: int, seed: int, rows: int = 128):
    """A task's range of scores as three rows: its first score, its last, and all between (u: weighted pairs won among themselves)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = lambda: np.zeros(replicates)
        part, first, open_, inner = None, None, None, [zero(), zero(), zero()]

        def between(ps, ns):  # whole groups in a row, none of them the range's first or last
            if len(ps):
                below = inner[2] + np.cumsum(ns, axis=0) - ns / 2
                inner[0] += np.einsum("gr,gr->r", ps, below)
                inner[1] += ps.sum(axis=0)
                inner[2] += ns.sum(axis=0)

        weights = {}  # of a speaker's hash: few speakers have many rows
        for pdf in batches:
            part = int(pdf["_r"].iloc[0]) if len(pdf) else part
            for k in range(0, len(pdf), rows):
                one = pdf.iloc[k : k + rows]
                v, y, c = one["_v"].to_numpy(float), one["_y"].to_numpy(float)[:, None], one["_c"].to_numpy(float)[:, None]
                hashes, of = np.unique(one["_h"].to_numpy(), return_inverse=True)
                if len(weights) > 2000:
                    weights = {}
                new = np.array([h for h in hashes.tolist() if h not in weights], np.int64)
                weights |= dict(zip(new.tolist(), poisson_weights(new, replicates, seed), strict=True)) if len(new) else {}
                w = np.stack([weights[h] for h in hashes.tolist()])[of] * c
                starts = np.concatenate(([0], np.flatnonzero(np.diff(v)) + 1))
                ps = w * y
                ns = w - ps
                if len(starts) < len(v):
                    ps, ns = np.add.reduceat(ps, starts), np.add.reduceat(ns, starts)
                scores, at = v[starts], 0
                if open_ is not None:
                    if open_[0] == scores[0]:
                        ps[0] += open_[1]
                        ns[0] += open_[2]
                    elif first is None:
                        first = open_
                    else:
                        between(open_[1][None], open_[2][None])
                if first is None and len(scores) > 1:
                    first, at = (scores[0], ps[0].copy(), ns[0].copy()), 1
                between(ps[at:-1], ns[at:-1])
                open_ = (scores[-1], ps[-1].copy(), ns[-1].copy())
        if open_ is None:
            return
        out = [(part, 2, open_[0], zero(), open_[1], open_[2])]
        if first is not None:
            out += [(part, 0, first[0], zero(), first[1], first[2]), (part, 1, None, *inner)]
        yield pd.DataFrame(out, columns=["part", "side", "score", "u", "p", "n"]).astype({"score": float})

    return run


def replicate_aucs(rows: DataFrame, score: str, y: str, speaker: str, replicates: int = 1000, seed: int = 42, per_task: int = 50_000) -> DataFrame:
    """r, auc: the area under the curve of each replicate, in which a speaker's rows all weigh a Poisson number; null
    where a class has no weight.

    All replicates go with one pass over ranges of the score. A range gives sums a replicate, so that what is shuffled
    then is a few rows a range and replicate; a score that several ranges share is put together there."""
    some = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(F.col(score).cast("double").alias("_v"), F.col(y).cast("int").alias("_y"), F.xxhash64(speaker).alias("_h"))
    one = stored(some.groupBy("_v", "_y", "_h").agg(F.count(F.lit(1)).alias("_c")))  # equal rows of a speaker weigh alike
    ranges = max(1, -(-one.count() // per_task))
    # by the hash too, so that a score with many rows spans ranges
    dealt = one.repartitionByRange(ranges, "_v", "_h").withColumn("_r", F.spark_partition_id()).sortWithinPartitions("_v")
    sums = stored(dealt.mapInPandas(_tallied(replicates, seed), "part int, side int, score double, u array<double>, p array<double>, n array<double>"))
    each = sums.select((F.col("part") * 3 + F.col("side")).alias("place"), F.when(F.col("side") != 1, F.col("score")).alias("score"), "side", F.posexplode(F.arrays_zip("u", "p", "n")).alias("r", "x"))
    shared = F.when(F.col("side") != 1, F.col("score"))
    # `score` is null for what lies between: such rows stay apart by their place
    grouped = each.groupBy("r", shared.alias("score"), F.when(F.col("side") == 1, F.col("place")).alias("own")).agg(F.min("place").alias("place"), F.sum("x.u").alias("u"), F.sum("x.p").alias("p"), F.sum("x.n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = grouped.withColumn("won", F.col("p") * before + F.when(F.col("own").isNull(), F.col("p") * F.col("n") / 2).otherwise(F.col("u")))
    both = F.sum("p") * F.sum("n")
    return won.groupBy("r").agg(F.when(both > 0, F.sum("won") / both).alias("auc"))


def auc_interval(rows: DataFrame, score: str, y: str, speaker: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """auc, low, high: with the interval between the replicates' percentiles, and the number of replicates that have both classes."""
    tail = (1 - level) / 2
    spread = replicate_aucs(rows, score, y, speaker, replicates, seed).agg(F.percentile("auc", [tail, 1 - tail]).alias("q"), F.count("auc").alias("replicates"))
    return decisions.auc(rows, score, y).crossJoin(spread).select("auc", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "replicates")  # a row each


def placed(rows: DataFrame, score: str, y: str, name: str) -> DataFrame:
    """With `name`: the share of the other class that a row beats: of negatives below a positive, of positives above a
    negative, equal ones by half."""
    points = decisions.roc_points(rows, score, y).select(F.col("score").alias("_v"), (F.col("below") + F.col("n") / 2.0).alias("_b"), (F.col("above") + F.col("p") / 2.0).alias("_a"))
    n = rows.agg(F.count_if(F.col(y) == 1).alias("_n1"), F.count_if(F.col(y) != 1).alias("_n0"))
    joined = rows.join(points, F.col(score).cast("double") == F.col("_v")).join(F.broadcast(n))  # one row
    return joined.withColumn(name, F.when(F.col(y) == 1, F.col("_b") / F.col("_n0")).otherwise(F.col("_a") / F.col("_n1"))).drop("_v", "_b", "_a", "_n1", "_n0")


def delong(rows: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """auc_a, auc_b, difference (b less a), variance, z, p of two scores of the same rows, by the covariance of the rows' placements."""
    some = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()).select(a, b, y)
    both = placed(placed(some, a, y, "_pa"), b, y, "_pb")
    sums = both.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("n"), F.avg("_pa").alias("ma"), F.avg("_pb").alias("mb"), F.var_samp("_pa").alias("va"), F.var_samp("_pb").alias("vb"), F.covar_samp("_pa", "_pb").alias("c"))
    of = lambda c, k: F.max(F.when(F.col("_y") == k, F.col(c)))
    spread = F.coalesce(F.col("va") + F.col("vb") - 2 * F.col("c"), F.lit(0.0)) / F.col("n")
    out = sums.withColumn("_s", spread).agg(of("ma", 1).alias("auc_a"), of("mb", 1).alias("auc_b"), F.sum("_s").alias("variance"))
    z = F.when(F.col("variance") > 0, (F.col("auc_b") - F.col("auc_a")) / F.sqrt("variance"))
    return out.select("auc_a", "auc_b", (F.col("auc_b") - F.col("auc_a")).alias("difference"), "variance", z.alias("z"), two_sided_p(z).alias("p"))


def eer_threshold(rows: DataFrame, score: str, y: str) -> DataFrame:
    """threshold: the score at and above which rows are flagged where both error rates are nearest; the highest such score."""
    points = decisions.roc_points(rows, score, y)
    total = points.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    gap = F.abs((F.col("nn") - F.col("below")) / F.col("nn") - (1 - (F.col("above") + F.col("p")) / F.col("np")))
    return points.join(F.broadcast(total)).agg(F.min(F.struct(gap.alias("gap"), (-F.col("score")).alias("s"))).alias("m")).select((-F.col("m.s")).alias("threshold"))  # one row


def error_correlation(rows: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """threshold_a, threshold_b, correlation of the two scores' errors at them; null if one of them errs never or always."""
    cuts = eer_threshold(rows, a, y).toDF("threshold_a").crossJoin(eer_threshold(rows, b, y).toDF("threshold_b"))  # a row each
    wrong = lambda s, t: ((F.col(s) >= F.col(t)) != (F.col(y) == 1)).cast("double")
    some = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(cuts))
    found = some.select("threshold_a", "threshold_b", wrong(a, "threshold_a").alias("_a"), wrong(b, "threshold_b").alias("_b")).groupBy("threshold_a", "threshold_b").agg(F.avg("_a").alias("ma"), F.avg("_b").alias("mb"), F.avg(F.col("_a") * F.col("_b")).alias("ab"))
    spread = F.sqrt(F.col("ma") * (1 - F.col("ma")) * F.col("mb") * (1 - F.col("mb")))
    return found.select("threshold_a", "threshold_b", F.when(spread > 0, (F.col("ab") - F.col("ma") * F.col("mb")) / spread).alias("correlation"))


def least_shift(sigma: Column, alpha: float, checks: int, beta: float = 0.2) -> Column:
    """The least shift of a check's mean that `checks` tests at a joint level alpha find with a chance of 1 - beta."""
    return (z_threshold(alpha, checks) + NormalDist().inv_cdf(1 - beta)) * sigma


def gate(tests: DataFrame, interval: DataFrame, comparison: DataFrame, most_p: float = 0.01, least_auc: float = 0.75, most_p_fused: float = 0.05) -> DataFrame:
    """One row: distributions differ in a test after Holm's correction; the score's area is large enough, its lower bound
    beside it; fusion (score b of the comparison) is better than one score alone; all three."""
    differ = tests.agg(F.min("p_holm").alias("p_holm")).select("p_holm", F.coalesce(F.col("p_holm") < most_p, F.lit(False)).alias("differ"))
    large = interval.select("auc", "low", (F.col("auc") >= least_auc).alias("large"))
    better = comparison.select("difference", F.col("p").alias("p_fused"), F.coalesce((F.col("difference") > 0) & (F.col("p") < most_p_fused), F.lit(False)).alias("better"))
    return differ.crossJoin(large).crossJoin(better).withColumn("passed", F.col("differ") & F.col("large") & F.col("better"))  # a row each
