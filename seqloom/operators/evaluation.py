"""Evaluation of the two detectors and their fusion on calibration and test segments.

scores: clip, seg, y (1 spoof), s1, s2."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import decisions

#: Checks that are run where time is short: (mode, windows, direction).
REDUCED = (("block", 8, "fwd"), ("block", 16, "fwd"), ("block", 32, "fwd"), ("bit", 16, "fwd"))


def reduced(deltas: DataFrame) -> DataFrame:
    """The rows of deltas (mode, w, dir) that belong to the reduced set."""
    return deltas.where(F.array_contains(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(w).alias("w"), F.lit(d).alias("dir")) for m, w, d in REDUCED)), F.struct("mode", F.col("w").cast("int").alias("w"), "dir")))


def first_of_each(rows: DataFrame, label: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each label."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def metrics(scores: DataFrame, score: str) -> DataFrame:
    """auc, eer of a score; a half each with one class."""
    return decisions.auc(scores, score, "y").crossJoin(decisions.eer(scores, score, "y"))  # a row each


def fusion_metrics(calib: DataFrame, test: DataFrame) -> DataFrame:
    """auc, eer on test of a regression on (s1, s2) that calib gives; a half each with too few rows or one class."""
    enough = lambda df, least: (lambda r: r["n"] >= least and r["k"] > 1)(df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).first())
    half = calib.sparkSession.range(1).select(F.lit(0.5).alias("auc"), F.lit(0.5).alias("eer"))
    if not enough(calib, 4) or not enough(test, 2):
        return half
    model = decisions.fit_calibrator(calib, ["s1", "s2"], "y")
    return metrics(decisions.calibrated(test, ["s1", "s2"], model), "llr")


def by_clip(scores: DataFrame, features: list[str], model, name: str) -> DataFrame:
    """clip, y, and the last verdict and sum of the sequential test on the model's ratios."""
    rows = decisions.calibrated(scores.withColumn("i", F.col("seg")), features, model)
    out = decisions.sprt(rows, "llr")
    # no verdict by the last segment leaves the clip pending
    return out.groupBy("clip", "y").agg(F.max_by("verdict", "k").alias(f"verdict_{name}"), F.max_by("lambda", "k").alias(f"lambda_{name}"))


def sprt_statistics(clips: DataFrame, verdict: str) -> DataFrame:
    """accuracy, fa_rate, detection_rate, live_normal, spoof_suspicious, total_clips."""
    v, live = F.col(verdict), F.col("y") == 0
    out = clips.agg(F.count_if(live & (v == "normal")).alias("live_normal"), F.count_if(~live & (v == "suspicious")).alias("spoof_suspicious"), F.count_if(live & (v == "suspicious")).alias("_fa"), F.count_if(live).alias("_live"), F.count(F.lit(1)).alias("total_clips"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total, spoof = F.col("total_clips"), F.col("total_clips") - F.col("_live")
    return out.select(share(F.col("live_normal") + F.col("spoof_suspicious"), total).alias("accuracy"), share(F.col("_fa"), F.col("_live")).alias("fa_rate"), share(F.col("spoof_suspicious"), spoof).alias("detection_rate"), "live_normal", "spoof_suspicious", "total_clips")


def calibration(calib: DataFrame, test: DataFrame, per_label: int = 150, clips_per_label: int = 12) -> DataFrame:
    """One row: the calibrator that is chosen, its coefficients, the test metrics of both scores, and the sequential
    test's statistics under the calibrator of s1 alone and that of both. s1 alone is kept unless both are more accurate,
    or as accurate with no worse rates and a weight of s2 above 0.01."""
    calib = first_of_each(calib, "y", ["clip", "seg"], per_label)
    chosen = first_of_each(test.select("clip", "y").distinct(), "y", ["clip"], clips_per_label)
    test = test.join(chosen.select("clip"), "clip", "left_semi")
    one, two = decisions.fit_calibrator(calib, ["s1"], "y"), decisions.fit_calibrator(calib, ["s1", "s2"], "y")
    clips = by_clip(test, ["s1"], one, "s1").join(by_clip(test, ["s1", "s2"], two, "s1_s2"), ["clip", "y"])
    stats = [sprt_statistics(clips, f"verdict_{k}").select(F.struct("*").alias(f"sprt_{k}")) for k in ("s1", "s1_s2")]
    means = test.agg(*(F.avg(F.when(F.col("y") == y, F.col(s))).alias(f"mean_{s}_{name}") for s in ("s1", "s2") for y, name in ((0, "live"), (1, "spoof"))), F.count(F.lit(1)).alias("test_segments"), F.countDistinct("clip").alias("test_clips"))
    out = means
    for k in ("s1", "s2"):
        out = out.crossJoin(metrics(test, k).toDF(f"auc_{k}", f"eer_{k}"))  # a row each
    out = out.crossJoin(stats[0]).crossJoin(stats[1])
    weight = float(two[0][1]) if two else 0.0
    a, b = F.col("sprt_s1_s2"), F.col("sprt_s1")
    better = (a["accuracy"] > b["accuracy"]) | ((a["accuracy"] == b["accuracy"]) & (a["fa_rate"] <= b["fa_rate"]) & (a["detection_rate"] >= b["detection_rate"]) & F.lit(weight > 0.01))
    params = lambda m: F.lit(None).cast("struct<coef:array<double>,intercept:double>") if m is None else F.struct(F.lit(m[0]).alias("coef"), F.lit(m[1]).alias("intercept"))
    return out.select(F.when(better, "(s1, s2)").otherwise("(s1 only)").alias("calibrator_type"), F.when(better, params(two)).otherwise(params(one)).alias("calibrator_params"), F.lit(weight).alias("s2_weight"), *out.columns)


def fused(calib: DataFrame, test: DataFrame, channels: list[str]) -> DataFrame:
    """test with fusion: the log odds by its channel's regression on (s1, s2), which calib gives. Null in channels where
    calib has fewer than 4 rows or one class. The fits are a job each; test is scanned once for all."""
    seen = {r["channel"]: r for r in calib.where(F.col("channel").isin(channels)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).collect()}
    out = F.lit(None).cast("double")
    for channel in channels:
        if channel in seen and seen[channel]["n"] >= 4 and seen[channel]["k"] > 1:
            (a, b), c = decisions.fit_calibrator(calib.where(F.col("channel") == channel), ["s1", "s2"], "y")
            out = F.when(F.col("channel") == channel, F.col("s1") * a + F.col("s2") * b + c).otherwise(out)
    return test.withColumn("fusion", out)


def channel_metrics(test: DataFrame, scores: list[str]) -> DataFrame:
    """channel, n_test, and auc_<score>, eer_<score> for each of the scores, with one scan for all channels and scores."""
    rows = test.select("channel", "y", F.inline(F.array(*(F.struct(F.lit(s).alias("_score"), F.col(s).cast("double").alias("_value")) for s in scores))))
    rates = decisions.rates_by_key(rows, ["channel", "_score"], "_value", "y")
    own = lambda s, c: F.coalesce(F.max(F.when(F.col("_score") == s, F.col(c))), F.lit(0.5)).alias(f"{c}_{s}")
    return rates.groupBy("channel").agg(F.max("n").alias("n_test"), *(own(s, c) for s in scores for c in ("auc", "eer")))


def stage0(calib: DataFrame, test: DataFrame, channels: list[str]) -> DataFrame:
    """channel, the metrics of s1, s2 and their fusion on test, n_test, and whether s1 passes the gate of 0.65. calib and
    test have a column channel. A channel without test rows has a half in every measure."""
    known = test.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(channels)], "channel string")
    found = channel_metrics(fused(calib, test.where(F.col("channel").isin(channels)), channels), ["s1", "s2", "fusion"])
    half = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    names = {"d1_auc": "auc_s1", "d1_eer": "eer_s1", "d2_auc": "auc_s2", "d2_eer": "eer_s2", "fusion_auc": "auc_fusion", "fusion_eer": "eer_fusion"}
    return known.join(found, "channel", "left").select("channel", *(half(c).alias(n) for n, c in names.items()), F.coalesce("n_test", F.lit(0)).alias("n_test"), (half("auc_s1") >= 0.65).alias("passes"))
