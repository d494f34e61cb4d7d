"""Sequential verdicts, evaluation of detectors, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import barriers
from ..sources.shared import stored
from . import sequences as S


def sprt(rows: DataFrame, llr: str, alpha: float = 0.01, beta: float = 0.05, most: int = 8) -> DataFrame:
    """With k, lambda and verdict: the running sum of llr in each clip (order i), frozen from the first row at which it
    crosses a barrier or `most` rows are over; the upper barrier is looked at first."""
    upper, lower = barriers(alpha, beta)
    w = S.in_clip().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k", F.row_number().over(S.in_clip())).withColumn("_c", F.sum(llr).over(w))
    stop = (F.col("_c") >= upper) | (F.col("_c") <= lower) | (F.col("k") >= most)
    first = F.min(F.when(stop, F.struct("k", "_c"))).over(w)
    rows = rows.withColumn("_s", first)
    c = F.coalesce(F.col("_s")["_c"], F.col("_c"))
    verdict = F.when(F.col("_s").isNull(), "pending").when(c >= upper, "suspicious").when(c <= lower, "normal").otherwise("undecided")
    return rows.withColumn("lambda", c).withColumn("verdict", verdict).drop("_c", "_s")


def with_prior(rows: DataFrame, llr: str, prior: float) -> DataFrame:
    """llr with the prior log odds added in each clip's first row (order i), so that the test's sums start there."""
    return rows.withColumn(llr, F.col(llr) + F.when(F.lag("i").over(S.in_clip()).isNull(), F.lit(float(prior))).otherwise(F.lit(0.0)))


def final_verdicts(rows: DataFrame) -> DataFrame:
    """clip, verdict: the last that is not pending, else undecided."""
    return rows.groupBy("clip").agg(F.coalesce(F.max_by(F.when(F.col("verdict") != "pending", F.col("verdict")), F.when(F.col("verdict") != "pending", F.col("k"))), F.lit("undecided")).alias("verdict"))


def call_log(rows: DataFrame) -> DataFrame:
    """clip, verdict, seconds, lambda of each call: the rows that were scored up to the first verdict that is not pending,
    and the sum there; of a call without one, all its rows and the last sum, undecided."""
    done = F.when(F.col("verdict") != "pending", F.struct("k", "verdict", "lambda"))
    ended = F.coalesce(F.min(done), F.max(F.struct("k", F.lit("undecided").alias("verdict"), "lambda"))).alias("_e")
    return rows.groupBy("clip").agg(ended).select("clip", "_e.verdict", F.col("_e.k").cast("long").alias("seconds"), "_e.lambda")


def latest_before(value: str) -> Column:
    """The last value that an earlier row of the clip has."""
    return F.last(value, True).over(S.in_clip().rowsBetween(Window.unboundedPreceding, -1))


def auc(scored: DataFrame, score: str, y: str) -> DataFrame:
    """auc by mid-ranks. Rows meet in one task only as one row a distinct score, and those are summed bucket by bucket."""
    by = roc_points(scored, score, y)
    total = by.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("u"))
    return total.select(F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).otherwise(0.5).alias("auc"))


def edges_below(edges: Column, coarse: Column, x: Column, step: int = 16) -> Column:
    """How many of the sorted edges are below x; coarse: every step-th of them, so that a row is compared with few."""
    count = lambda some: F.size(F.filter(some, lambda e: e < x))
    at = count(coarse) * step
    return at + count(F.slice(edges, at + 1, F.lit(step - 1)))


def roc_points(scored: DataFrame, score: str, y: str, buckets: int = 256) -> DataFrame:
    """score, p, n (rows of either class at a score), below (negatives with lower scores) and above (positives with higher ones)."""
    by = scored.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    by = stored(by)  # what gives the scores is not run again for every use of the points
    edges = by.agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or [0.0]
    edges = sorted(set(edges))
    doubles = lambda some: F.array(*map(F.lit, some)).cast("array<double>")
    placed = by.withColumn("bucket", edges_below(doubles(edges), doubles(edges[15::16]), F.col("score")))
    sums = placed.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    v = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("bn").over(w), F.lit(0)).alias("bb"), F.coalesce(F.sum("bp").over(v), F.lit(0)).alias("ba"))
    inner = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_b", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("_a", F.coalesce(F.sum("p").over(outer), F.lit(0)))
    return out.join(F.broadcast(sums), "bucket").select("score", "p", "n", (F.col("bb") + F.col("_b")).alias("below"), (F.col("ba") + F.col("_a")).alias("above"))


def eer(scored: DataFrame, score: str, y: str) -> DataFrame:
    """eer at the vertex where false positive and false negative rate are nearest; the first on ties, from the highest score down."""
    points = roc_points(scored, score, y)
    total = points.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    rated = points.join(F.broadcast(total)).select("score", ((F.col("nn") - F.col("below")) / F.col("nn")).alias("fpr"), (1 - (F.col("above") + F.col("p")) / F.col("np")).alias("fnr"))
    best = rated.agg(F.min(F.struct(F.abs(F.col("fpr") - F.col("fnr")).alias("gap"), (-F.col("score")).alias("s"), "fpr", "fnr")).alias("m"))
    # the vertex before any row: rates 0 and 1
    return best.select(F.when(F.col("m").isNull(), 0.5).when(F.col("m.gap") >= 1, 0.5).otherwise((F.col("m.fpr") + F.col("m.fnr")) / 2).alias("eer"))


def rates_by_key(scored: DataFrame, keys: list[str], score: str, y: str, buckets: int = 256) -> DataFrame:
    """keys, n, auc, eer: both measures for each key in one plan, by the rules of `auc` and `eer`; a half each with one class.

    Rows without a score or a class take no part; a null key is a key. Before anything is sorted there is one row a key and
    distinct score, and a task sorts the scores of one of a key's buckets, so that no task holds a key."""
    same = lambda a, b: reduce(Column.__and__, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys))
    named = [F.col(k).alias(f"_{k}") for k in keys]
    by = scored.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("_x")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    edges = by.groupBy(*named).agg(F.percentile_approx("_x", [i / buckets for i in range(1, buckets)], 10_000).alias("_edges")).withColumn("_coarse", F.filter("_edges", lambda e, k: k % 16 == 15))
    # a row a key: dealt by key, all of a key's scores would lie in one task
    placed = by.join(F.broadcast(edges), same(by, edges)).select(*keys, "_x", "p", "n", edges_below(F.col("_edges"), F.col("_coarse"), F.col("_x")).alias("_b"))
    sums = placed.groupBy(*named, F.col("_b").alias("_bucket")).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    own = Window.partitionBy(*(f"_{k}" for k in keys))  # at most `buckets` rows each
    before = own.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(f"_{k}" for k in keys), "_bucket", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bn"), F.sum("_p").over(own).alias("np"), F.sum("_n").over(own).alias("nn"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_ip", F.coalesce(F.sum("p").over(inner), F.lit(0))).withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    points = ranked.join(sums, same(ranked, sums) & (ranked["_b"] == sums["_bucket"])).select(*keys, "_x", "p", "n", "np", "nn", (F.col("_bp") + F.col("_ip")).alias("fn"), (F.col("_bn") + F.col("_in")).alias("tn"))
    fpr, fnr = (F.col("nn") - F.col("tn")) / F.col("nn"), F.col("fn") / F.col("np")
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    found = points.groupBy(*keys).agg(
        F.sum(F.col("p") + F.col("n")).alias("n"),
        F.coalesce(F.max(F.when(both, F.lit(1.0) / (F.col("np") * F.col("nn")))) * F.sum(F.col("p") * (F.col("tn") + F.col("n") / 2.0)), F.lit(0.5)).alias("auc"),
        F.min(F.when(both, F.struct(F.abs(fpr - fnr).alias("gap"), (-F.col("_x")).alias("s"), fpr.alias("fpr"), fnr.alias("fnr")))).alias("m"),
    )
    return found.select(*keys, "n", "auc", F.when(F.col("m").isNull() | (F.col("m.gap") >= 1), 0.5).otherwise((F.col("m.fpr") + F.col("m.fnr")) / 2).alias("eer"))


def confusion(verdicts: DataFrame, positive: Column, flagged: Column) -> DataFrame:
    return verdicts.agg(
        F.avg((positive == flagged).cast("double")).alias("accuracy"),
        F.avg(F.when(~positive, flagged.cast("double"))).alias("false_alarm_rate"),
        F.avg(F.when(positive, flagged.cast("double"))).alias("detection_rate"),
    )


def fit_calibrator(rows: DataFrame, features: list[str], label: str, c: float = 1.0):
    """Logistic regression of label on features with an L2 penalty like one of strength c on the summed loss: (coefficients, intercept); None with one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = rows.groupBy(label).count().collect()
    if len(counts) < 2:
        return None
    n = sum(r["count"] for r in counts)
    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(rows.dropna(subset=[*features, label]))
    model = LogisticRegression(featuresCol="_v", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200).fit(vectors)
    return [float(v) for v in model.coefficients], float(model.intercept)


def calibrated(rows: DataFrame, features: list[str], model) -> DataFrame:
    """With llr: the model's log odds; without a model the mean of the features."""
    if model is None:
        return rows.withColumn("llr", sum((F.col(f) for f in features), F.lit(0.0)) / len(features))
    coefficients, intercept = model
    return rows.withColumn("llr", sum((F.col(f) * w for f, w in zip(features, coefficients, strict=True)), F.lit(intercept)))


def passport(metrics: DataFrame) -> DataFrame:
    """One JSON document a row, numbers rounded to four decimals."""
    rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    return metrics.select(F.to_json(F.struct(*rounded)).alias("passport"))
