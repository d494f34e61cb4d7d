"""Splits that keep together what belongs together: rows that share a speaker, a voice, a text or any other key, directly
or over others, are one component, and a component goes into one part as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.manifest import numbered
from ..sources.shared import stored


def components(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """`name`, component (the smallest name in it), for rows with a unique `name`; keys that are null link nothing.

    Each round a key takes the least label of its rows and a row the least of its keys'; then a row takes its label's
    own label, which halves the way. Keys with many rows are a partial minimum and a join that has one row a key on one side."""
    member = stored(rows.select(name, F.explode(F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key"))) for k in keys)))).alias("k")).select(F.col(name).alias("id"), "k"))
    labels, before = rows.select(F.col(name).alias("id"), F.col(name).alias("label")), None
    while True:
        least = member.join(labels, "id").groupBy("k").agg(F.min("label").alias("m"))
        own = member.join(least, "k").groupBy("id").agg(F.min("m").alias("m"))
        near = labels.join(own, "id", "left").select("id", F.least("label", "m").alias("label"))
        far = near.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        labels = stored(near.join(far, near["label"] == far["_i"]).select("id", F.least("label", "_l").alias("label")))
        now = labels.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).first()
        if now == before:
            return labels.select(F.col("id").alias(name), F.col("label").alias("component"))
        before = now


def constrained_split(rows: DataFrame, name: str, keys: list[str], order: Column, confined: Column | None = None, calib: float = 0.3, train: float = 0.4) -> DataFrame:
    """rows with component and split: components in the given order (of their column `component`), by shares of their
    number, in calib, train and test; a component with a row that is `confined` is in test, beside the shares of the rest."""
    found = components(rows, name, keys)
    whole = rows.join(found, name)
    kept = whole.groupBy("component").agg(F.max(F.coalesce(confined, F.lit(False)) if confined is not None else F.lit(False)).alias("_c"))
    free = kept.where("NOT _c").select("component", order.alias("_o"))
    n = free.count()
    at = numbered(free, ["_o", "component"], "_at").select("component", "_at")
    part = F.when(F.col("_at") < int(calib * n), "calib").when(F.col("_at") < int(calib * n) + int(train * n), "train").otherwise("test")
    return whole.join(at, "component", "left").withColumn("split", part).drop("_at")


def broken(split: DataFrame, keys: list[str], part: str = "split") -> DataFrame:
    """kind, key, parts: keys whose rows are in more than one part; none should be."""
    rows = split.select(part, F.explode(F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key"))) for k in keys)))).alias("k"))
    return rows.groupBy("k.kind", "k.key").agg(F.countDistinct(part).alias("parts")).where("parts > 1")
