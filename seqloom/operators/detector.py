"""The classifier over cepstral statistics: augmentation by channels, training, and scores as a dot product in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    """A standardised linear model."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float


def augmented(segments: DataFrame, channels: list[str], simulate: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Segments (clip, samples, ...) times channels, with column channel. simulate gives (clip, samples) of the first
    piece that is speech after a channel; a segment without one, and the channel clean, keep their samples."""
    out = None
    for channel in channels:
        if channel == "clean":
            one = segments
        else:
            heard = simulate(segments.select("clip", "samples"), channel).select("clip", F.col("samples").alias("_heard"))
            one = segments.join(heard, "clip", "left").withColumn("samples", F.coalesce("_heard", "samples")).drop("_heard")
        one = one.withColumn("channel", F.lit(channel))
        out = one if out is None else out.unionByName(one)
    return out


def train(rows: DataFrame, features: str = "features", label: str = "y", c: float = 1.0) -> Linear | None:
    """Logistic regression on standardised features, with a penalty like one of strength c on the summed loss; None with one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    if rows.select(label).distinct().count() < 2:
        return None
    vectors = rows.select(array_to_vector(F.col(features)).alias("v"), F.col(label).cast("double").alias("y"))
    found = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    n = found["count"]
    mean, scale = found["mean"].tolist(), [math.sqrt(v * (n - 1) / n) or 1.0 for v in found["variance"]]
    scaled = rows.select(array_to_vector(standardised(F.col(features), mean, scale)).alias("v"), F.col(label).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500).fit(scaled)
    return Linear(mean, scale, [float(w) for w in model.coefficients], float(model.intercept))


def standardised(features: Column, mean: list[float], scale: list[float]) -> Column:
    return F.transform(F.arrays_zip(features.alias("x"), F.lit(mean).alias("m"), F.lit(scale).alias("s")), lambda z: (z["x"] - z["m"]) / z["s"])


def logit(features: Column, model: Linear) -> Column:
    """The log odds, within those of 1e-7."""
    terms = F.zip_with(standardised(features, model.mean, model.scale), F.lit(model.weights), lambda x, w: x * w)
    most = math.log((1 - 1e-7) / 1e-7)
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.aggregate(terms, F.lit(model.intercept), lambda a, x: a + x)))
