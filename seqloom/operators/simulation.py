"""Calls out of segments, their errors with bounds, and the choice of a barrier.

scores: clip, seg (from 0), speaker, y (1 spoof), llr. A call's rows are few (`most`), calls spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import barriers, rate_bound
from . import decisions, statistics


def joined_calls(scores: DataFrame, length: int = 30) -> DataFrame:
    """call (speaker, y, n), i, llr: the clips of a speaker and class one after the other, cut every `length` segments.

    Clips are numbered by their counts of segments, so that a speaker with many rows is many small sums."""
    clips = scores.groupBy("speaker", "y", "clip").agg(F.count(F.lit(1)).alias("_c"))
    first = statistics.running(clips, ["speaker", "y"], ["clip"], ["_c"]).select("speaker", "y", "clip", F.col("before__c").alias("_b"))
    place = F.col("_b") + F.row_number().over(Window.partitionBy("speaker", "y", "clip").orderBy("seg")) - 1
    out = scores.join(first, (scores["speaker"].eqNullSafe(first["speaker"])) & (scores["y"] == first["y"]) & (scores["clip"] == first["clip"])).select(scores["speaker"], scores["y"], scores["clip"], "seg", "llr", "_b")
    at = out.withColumn("_at", place)
    return at.select(F.struct("speaker", "y", F.floor(F.col("_at") / length).cast("long").alias("n")).alias("call"), "y", F.pmod("_at", F.lit(length)).cast("long").alias("i"), "llr")


def outcomes(calls: DataFrame, alpha: float = 0.01, beta: float = 0.05, most: int = 30, prior: float = 0.0) -> DataFrame:
    """call, y, verdict, seconds (segments until the verdict, or all), lambda: how each call ends. prior: what the sum starts from."""
    at_start = F.when(F.row_number().over(Window.partitionBy("call").orderBy("i")) == 1, F.col("llr") + prior).otherwise(F.col("llr"))
    rows = decisions.sprt(calls.select(F.col("call").alias("clip"), "y", "i", at_start.alias("llr")), "llr", alpha, beta, most)
    decided = F.col("verdict") != "pending"
    last = F.max_by(F.struct("verdict", "lambda"), "k")
    out = rows.groupBy("clip", "y").agg(last.alias("e"), F.coalesce(F.min(F.when(decided, F.col("k"))), F.max("k")).alias("seconds"))
    return out.select(F.col("clip").alias("call"), "y", F.when(F.col("e.verdict") == "pending", "undecided").otherwise(F.col("e.verdict")).alias("verdict"), F.col("seconds").cast("long").alias("seconds"), F.col("e.lambda").alias("lambda"))


def error_rates(ended: DataFrame, keys: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """keys, y, calls, errors (suspicious live calls, normal spoofed ones), rate, bound (one-sided), undecided, and the
    mean and the 90th percentile of the seconds to a verdict."""
    keys = keys or []
    wrong = F.col("verdict") == F.when(F.col("y") == 0, "suspicious").otherwise("normal")
    time = F.when(F.col("verdict") != "undecided", F.col("seconds"))
    out = ended.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("calls"), F.count_if(wrong).alias("errors"), F.avg((F.col("verdict") == "undecided").cast("double")).alias("undecided"), F.avg(time).alias("mean_seconds"), F.percentile(time, 0.9).alias("p90_seconds"))
    return out.select(*keys, "y", "calls", "errors", (F.col("errors") / F.col("calls")).alias("rate"), rate_bound(F.col("errors"), F.col("calls"), level).alias("bound"), "undecided", "mean_seconds", "p90_seconds")


def first_passages(calls: DataFrame, upper: list[float], lower: float, most: int = 30) -> DataFrame:
    """call, y, step, verdict, seconds, for every upper barrier `upper[step]`, in one pass: a call keeps the steps at which its sum
    reaches a new height; the first of them at or above a barrier is that barrier's passage."""
    w = Window.partitionBy("call").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("k", F.row_number().over(Window.partitionBy("call").orderBy("i"))).where(F.col("k") <= most).withColumn("c", F.sum("llr").over(w))
    rows = rows.withColumn("top", F.max("c").over(w))
    before = F.lag("top").over(Window.partitionBy("call").orderBy("i"))
    rows = rows.withColumn("_new", before.isNull() | (F.col("top") > before))
    by = rows.groupBy("call", "y").agg(F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("k", "top")))).alias("heights"), F.min(F.when(F.col("c") <= lower, F.col("k"))).alias("low"), F.max("k").alias("n"))

    def passage(a: Column) -> Column:
        return F.try_element_at(F.filter("heights", lambda h: h["top"] >= a), F.lit(1))["k"]

    each = by.select("call", "y", "low", "n", F.posexplode(F.transform(F.array(*map(F.lit, upper)), passage)).alias("step", "high"))
    suspicious = F.col("high").isNotNull() & (F.col("low").isNull() | (F.col("high") <= F.col("low")))
    verdict = F.when(suspicious, "suspicious").when(F.col("low").isNotNull(), "normal").otherwise("undecided")
    return each.select("call", "y", "step", verdict.alias("verdict"), F.when(suspicious, F.col("high")).otherwise(F.coalesce("low", "n")).cast("long").alias("seconds"))


def tuned(calls: DataFrame, target: float, alpha: float = 0.01, beta: float = 0.05, most: int = 30, step: float = 0.25, steps: int = 40) -> DataFrame:
    """One row: the lowest upper barrier, `step` apart, under which the bound of the live calls' error rate is at most
    `target`, else the highest; with the lower barrier, both error rates, the bound and the mean time to a verdict."""
    upper, lower = barriers(alpha, beta)
    levels = [upper + step * k for k in range(steps + 1)]
    rates = error_rates(first_passages(calls, levels, lower, most), ["step"])
    live, spoof = rates.where("y = 0"), rates.where("y = 1").select("step", F.col("rate").alias("beta_hat"), F.col("mean_seconds").alias("seconds_spoof"))
    all_ = live.join(spoof, "step", "left").withColumn("met", F.col("bound") <= target)
    best = all_.agg(F.coalesce(F.min(F.when(F.col("met"), F.struct("step", "met", "rate", "bound", "beta_hat", "mean_seconds", "seconds_spoof"))), F.max(F.struct("step", "met", "rate", "bound", "beta_hat", "mean_seconds", "seconds_spoof"))).alias("b"))
    return best.select(F.col("b.step").alias("step"), (upper + step * F.col("b.step")).alias("upper"), F.lit(lower).alias("lower"), F.col("b.met").alias("met"), F.col("b.rate").alias("alpha_hat"), F.col("b.bound").alias("alpha_up"), F.col("b.beta_hat").alias("beta_hat"), F.col("b.mean_seconds").alias("seconds_live"), F.col("b.seconds_spoof").alias("seconds_spoof"))
