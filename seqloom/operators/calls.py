"""What a call goes through before and beside the detectors: trimming, long analysis windows, priors, a stub detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def trimmed(seq: DataFrame, value: str, rate: int, gate_db: float = -40.0, least_s: float = 2.0, peak_db: float = -1.0) -> DataFrame:
    """clip, i, value: each clip from its first to its last sample of `gate_db` below full scale (1) or louder, counted
    from 0 again, with its peak at `peak_db`. Clips that are shorter than `least_s` seconds then, or never as loud, go.

    The edges and the peak are one partial aggregate; samples between loud ones stay, however low."""
    level = F.abs(F.col(value))
    loud = level >= 10 ** (gate_db / 20)
    edges = seq.groupBy("clip").agg(F.min(F.when(loud, F.col("i"))).alias("_first"), F.max(F.when(loud, F.col("i"))).alias("_last"), F.max(level).alias("_peak"))
    edges = edges.where(F.col("_last") - F.col("_first") + 1 >= least_s * rate)
    kept = seq.join(edges, "clip").where(F.col("i").between(F.col("_first"), F.col("_last")))
    return kept.select("clip", (F.col("i") - F.col("_first")).alias("i"), (F.col(value) / F.col("_peak") * 10 ** (peak_db / 20)).alias(value))


def long_windows(segments: DataFrame, seconds: int = 5) -> DataFrame:
    """Rows (clip, i, second, ...) keyed by windows of so many seconds: clip becomes a struct (clip, win), i counts from 0
    in each window, second goes. All operators that work by clip then work by window, and no window is put together in one row."""
    keyed = segments.withColumn("_win", F.floor(F.col("second") / seconds))
    start = keyed.groupBy("clip", "_win").agg(F.min("i").alias("_start"))
    out = keyed.join(start, ["clip", "_win"])
    rest = [c for c in segments.columns if c not in ("clip", "i", "second")]
    return out.select(F.struct("clip", F.col("_win").alias("win")).alias("clip"), (F.col("i") - F.col("_start")).alias("i"), *rest)


def without_prior(log_odds: Column, positives: Column, negatives: Column) -> Column:
    """The log likelihood ratio in the log odds of a model that learned from so many rows of either class."""
    return log_odds - F.ln(positives / negatives)


def stub_llr(label: Column) -> Column:
    """A detector for tests of streams and calls: 2 for spoof, -2 for all else."""
    return F.when(label == "spoof", 2.0).otherwise(-2.0)


def executed_threshold(deltas: DataFrame, keys: list[str], alpha: float = 0.01, most: int = 64) -> DataFrame:
    """keys, n_checks, z, n_strong, suspicious: the bound that corrects for the checks that ran (delta is not null), not
    for those of the grid. A check is strong where |delta| reaches z / (2 sqrt(n_test)). Keys of which no check ran have no z.

    The bounds for 1 to `most` checks are constants of the plan; more checks than that are an error."""
    table = F.lit([scalars.z_threshold(alpha, m) for m in range(1, most + 1)])
    ran = deltas.groupBy(*keys).agg(F.count("delta").alias("n_checks"), F.collect_list(F.when(F.col("delta").isNotNull(), F.abs("delta") * 2 * F.sqrt("n_test"))).alias("_found"))
    bound = F.when(F.col("n_checks") > most, F.raise_error(F.lit("more checks than `most`")).cast("double")).when(F.col("n_checks") > 0, F.element_at(table, F.greatest(F.col("n_checks"), F.lit(1)).cast("int")))
    strong = F.size(F.filter("_found", lambda v: v >= F.col("z")))
    return ran.withColumn("z", bound).select(*keys, "n_checks", "z", F.when(F.col("z").isNull(), 0).otherwise(strong).alias("n_strong"), F.coalesce((F.col("z").isNotNull() & (strong > 0)), F.lit(False)).alias("suspicious"))
