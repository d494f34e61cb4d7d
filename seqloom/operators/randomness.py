"""Randomness of bit sequences: Markov chi-square, transitions, predictors by counting, profiles, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sequences as S


def markov_counts(seq: DataFrame, bit: str, order: int) -> DataFrame:
    """clip, ctx, b, o: how often bit b follows context ctx, one added to every cell of the full grid."""
    return all_markov_counts(seq, bit, (order,)).drop("order")


def all_markov_counts(seq: DataFrame, bit: str, orders: tuple[int, ...]) -> DataFrame:
    """clip, order, ctx, b, o for every order: the sequence is read for its windows once, and once for the clips there are."""
    grid = seq.select("clip").distinct().select("clip", F.explode(F.array(*map(F.lit, orders))).alias("order"))
    grid = grid.select("clip", "order", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.col("order")).cast("long") - 1)).alias("ctx"))
    cells = grid.select("clip", "order", "ctx", F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
    seen = S.all_windows(seq, bit, orders).groupBy("clip", F.col("w").alias("order"), "ctx", F.col("y").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return cells.join(seen, ["clip", "order", "ctx", "b"], "left").select("clip", "order", "ctx", "b", (F.coalesce("c", F.lit(0)) + 1).alias("o"))


def markov_chi2(counts: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """clip, chi2 against uniform bits, or against reference (ctx, b, p)."""
    row = F.sum("o").over(Window.partitionBy("clip", "ctx"))
    rated = counts.withColumn("n", row)
    rated = rated.withColumn("p", F.lit(0.5)) if reference is None else rated.join(F.broadcast(reference), ["ctx", "b"], "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
    e = F.col("n") * F.col("p")
    return rated.groupBy("clip").agg(F.sum(F.when(e > 0, F.pow(F.col("o") - e, 2) / e)).alias("chi2"))


def transition_profile(counts: DataFrame) -> DataFrame:
    """ctx, b, p over all clips (one added a cell, once)."""
    total = counts.groupBy("ctx", "b").agg((F.sum(F.col("o") - 1) + 1).alias("o"))
    return total.select("ctx", "b", (F.col("o") / F.sum("o").over(Window.partitionBy("ctx"))).alias("p"))


def block_transitions(seq: DataFrame, bit: str, w: int) -> DataFrame:
    """clip, ctx, next, c: counts of a window of w bits followed by the next w bits, at every place."""
    ahead = seq.select("clip", "i", S.context(bit, w).alias("ctx"))
    after = F.lead("ctx", w).over(S.in_clip())
    last = F.max("i").over(Window.partitionBy("clip"))
    pairs = ahead.withColumn("next", after).withColumn("last", last).where((F.col("i") >= w) & F.col("next").isNotNull())
    return pairs.groupBy("clip", "ctx", "next").agg(F.count(F.lit(1)).alias("c"))


def counted_predictor(seq: DataFrame, bit: str, w: int, share: float = 0.8) -> DataFrame:
    """clip, n_test, delta: the test accuracy, less a half, of the bit that the training part saw more often after the same context."""
    return counted_predictors(seq, bit, (w,), share).drop("w")


def counted_predictors(seq: DataFrame, bit: str, widths: tuple[int, ...], share: float = 0.8) -> DataFrame:
    """clip, w, n_test, delta for windows of every width in one pass: a context's training and test bits are counted
    together, so that nothing is joined."""
    rows = S.all_windows(seq, bit, widths).withColumn("train", F.col("i") < F.floor(F.col("n") * share))
    y, train = F.col("y"), F.col("train")
    per = rows.groupBy("clip", "w", "ctx").agg(
        F.coalesce(F.sum(F.when(train, 2 * y - 1)), F.lit(0)).alias("lean"), F.count_if(~train).alias("n"), F.coalesce(F.sum(F.when(~train, y)), F.lit(0)).alias("ones")
    )
    right = F.when(F.col("lean") > 0, F.col("ones")).otherwise(F.col("n") - F.col("ones"))
    out = per.groupBy("clip", "w").agg(F.sum("n").alias("n_test"), F.sum(right).alias("right")).where("n_test > 0")
    return out.select("clip", "w", "n_test", (F.col("right") / F.col("n_test") - 0.5).alias("delta"))


def legacy_statistics(seq: DataFrame, bit: str, w: int) -> DataFrame:
    """clip, n, chi2: the mean over test windows of the chi-square of their context's training bits against evenness,
    summed only over the bits that occurred; test windows whose context training has not seen are skipped."""
    n = F.count(F.lit(1)).over(Window.partitionBy("clip"))
    rows = S.windows(seq, bit, w).withColumn("half", F.floor((n + w) / 2))
    c1, c0 = F.sum("y"), F.sum(1 - F.col("y"))
    chi = lambda c, half: F.when(c > 0, F.pow(c - half, 2) / half).otherwise(0.0)
    half = F.count(F.lit(1)) / 2
    seen = rows.where("i < half").groupBy("clip", "ctx").agg((chi(c1, half) + chi(c0, half)).alias("chi2"))
    return rows.where("i >= half").join(seen, ["clip", "ctx"]).groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.avg("chi2").alias("chi2"))


def contingency_chi2(a, b, c, d):
    """Chi-square of a 2x2 table with one added to each cell and Yates' correction."""
    a, b, c, d = a + 1, b + 1, c + 1, d + 1
    n = a + b + c + d
    short = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2.0)
    return n * short * short / ((a + b) * (c + d) * (a + c) * (b + d))


def profile(deltas: DataFrame, keys: list[str], style: str) -> DataFrame:
    """Statistics of `delta` by keys. rich: mu0, sigma0 (sample), median0, mad0, sigma_samp (needs n_test), n; simple: mu0, sigma0 (population, floored), n."""
    valid = deltas.where(F.col("delta").isNotNull())
    if style == "simple":
        return valid.groupBy(*keys).agg(F.avg("delta").alias("mu0"), F.greatest(F.stddev_pop("delta"), F.lit(1e-6)).alias("sigma0"), F.count(F.lit(1)).alias("n"))
    if style != "rich":
        raise ValueError(f"style must be rich or simple, not {style!r}")
    mid = valid.groupBy(*keys).agg(F.median("delta").alias("median0"))
    off = F.median(F.abs(F.col("delta") - F.col("median0")))
    out = valid.join(mid, keys).groupBy(*keys).agg(
        F.avg("delta").alias("mu0"), F.coalesce(F.nullif(F.stddev_samp("delta"), F.lit(0.0)), F.lit(1e-4)).alias("sigma0"), F.max("median0").alias("median0"),
        F.coalesce(F.nullif(off * 1.4826, F.lit(0.0)), F.lit(1e-4)).alias("mad0"), (1 / (2 * F.sqrt(F.avg("n_test")))).alias("sigma_samp"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("sigma_spk", F.sqrt(F.greatest(F.lit(0.0), F.col("sigma0") * F.col("sigma0") - F.col("sigma_samp") * F.col("sigma_samp"))))


def z_scores(deltas: DataFrame, reference: DataFrame, keys: list[str], style: str = "rich", robust: bool = False) -> DataFrame:
    """deltas with z against the reference; a missing entry is centred at 0 (scale 1e-4 rich, 1 simple)."""
    centre, scale = ("median0", "mad0") if robust else ("mu0", "sigma0")
    known = reference.select(*keys, F.col(centre).alias("_c"), F.col(scale).alias("_s"))
    default = 1e-4 if style == "rich" else 1.0
    s = F.coalesce("_s", F.lit(default))
    s = F.when(s == 0, 1e-4).otherwise(s) if style == "rich" else F.greatest(s, F.lit(1e-9))
    return deltas.join(known, keys, "left").withColumn("z", (F.col("delta") - F.coalesce("_c", F.lit(0.0))) / s).drop("_c", "_s")


def strongest(scored: DataFrame, by: str) -> DataFrame:
    """by, s2: the largest absolute z, 0 where none is valid."""
    return scored.groupBy(by).agg(F.coalesce(F.max(F.abs("z")), F.lit(0.0)).alias("s2"))
