"""Clip manifests: scans, caps, splits, work lists, and the tables that runs leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored


def load(spark: SparkSession, path: str, split: str | None = None, label: str | None = None) -> DataFrame:
    """The manifest; filters reach the Parquet scan. A split of `all`, or one that the table has no column for, filters nothing."""
    out = spark.read.parquet(path)
    if split not in (None, "all") and "split" in out.columns:
        out = out.where(F.col("split") == split)
    return out if label is None else out.where(F.col("label") == label)


def save(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").parquet(path)


def capped(rows: DataFrame, speaker: str, label: str, order: list[str], per_speaker: int = 5, per_label: int = 300, parts: int = 64) -> DataFrame:
    """The first rows of each speaker, and of those the first of each label, in order of arrival. A label's candidates
    are first cut to its cap in each of `parts`, so that few rows of a label meet in one task."""
    n = F.row_number().over(Window.partitionBy(label, speaker).orderBy(*order))
    rows = rows.withColumn("_n", n).where(F.col("_n") <= per_speaker).withColumn("_p", F.pmod(F.xxhash64(*order), F.lit(parts)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(label, "_p").orderBy(*order))).where(F.col("_n") <= per_label)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_n") <= per_label).drop("_n", "_p")


def numbered(rows: DataFrame, order: list[str], name: str, per_task: int = 100_000) -> DataFrame:
    """With the rows' places in the given order, from 0: rows are dealt by ranges of the order, and only the ranges'
    sizes meet in one task. The ranges are drawn from a sample, anew in every plan; the dealt table is therefore written
    once, so that sizes and rows are of the same ranges."""
    ranged = stored(rows.repartitionByRange(max(1, -(-rows.count() // per_task)), *order).withColumn("_r", F.spark_partition_id()))
    sizes = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return ranged.join(F.broadcast(sizes), "_r").withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1).drop("_r", "_b")


def speaker_split(rows: DataFrame, speaker: str, order: Column, calib: float = 0.3, train: float = 0.4) -> DataFrame:
    """speaker, split: speakers in the given order (a seeded hash, say); the first share calibrates, the next trains, the rest tests; each has one at least."""
    people = rows.select(F.col(speaker).alias("speaker")).where("speaker IS NOT NULL").distinct().withColumn("_o", order)
    n = people.count()
    c, t = max(1, int(calib * n)), max(1, int(train * n))
    if c + t >= n:
        t = max(0, n - c - 1)
    at = numbered(people, ["_o", "speaker"], "_at")
    return at.select("speaker", F.when(F.col("_at") < c, "calib").when(F.col("_at") < c + t, "train").otherwise("test").alias("split"))


def disjoint(rows: DataFrame, speaker: str, split: str) -> DataFrame:
    """Speakers that are in more than one split; none should be."""
    return rows.groupBy(speaker).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def interleaved(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Two sources in turn, with columns turn and source; the longer one's rest comes last."""
    rows = [numbered(df, o, "turn").withColumn("turn", F.col("turn") + 1).withColumn("source", F.lit(k)) for k, (df, o) in enumerate(((a, order_a), (b, order_b)))]
    return rows[0].unionByName(rows[1])


def work_list(clips: DataFrame, channels: list[str]) -> DataFrame:
    return clips.withColumn("channel", F.explode(F.array(*map(F.lit, channels))))


def outstanding(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The part of the work list that earlier runs have not left results of."""
    return work.join(done.select(*keys), keys, "left_anti")


def picked_channel(pool: list[str], key: Column, seed: int) -> Column:
    if not pool:
        raise ValueError("the pool of channels is empty")
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(pool))) + 1).cast("int"))


def with_fallback(rows: DataFrame, profiles: DataFrame, channel: str = "channel", base: str = "clean") -> DataFrame:
    """Rows with the profile of their channel, or that of the base channel."""
    columns = [c for c in profiles.columns if c != channel]
    own = profiles.select(channel, F.struct(*columns).alias("_own"))
    other = profiles.where(F.col(channel) == base).select(F.struct(*columns).alias("_base")).limit(1)
    spare = other.collect()  # one row
    out = rows.join(own, channel, "left")
    found = F.coalesce("_own", F.lit(None).cast(own.schema["_own"].dataType)) if not spare else F.coalesce("_own", F.struct(*(F.lit(spare[0]["_base"][c]).cast(profiles.schema[c].dataType).alias(c) for c in columns)))
    return out.select(*rows.columns, found.alias("profile")).select(*rows.columns, "profile.*")


def membership(rows: DataFrame, splits: DataFrame, speaker: str) -> DataFrame:
    """Rows with the split of their speaker; those without a speaker have none."""
    return rows.join(splits.withColumnRenamed("speaker", speaker), speaker, "left")


def row_split(rows: DataFrame, speaker: str, order: list[Column], calib: float = 0.3, train: float = 0.4) -> DataFrame:
    """rows with a split: by rows in the given order where there is one speaker at most, by speakers (ordered by the hash of their name) otherwise."""
    people = rows.select(speaker).where(F.col(speaker).isNotNull()).distinct().limit(2).count()
    if people > 1:
        return membership(rows, speaker_split(rows, speaker, F.xxhash64("speaker")), speaker)
    n = rows.count()
    c, t = max(1, int(calib * n)), max(1, int(train * n))
    if c + t >= n:
        t = max(0, n - c - 1)
    keyed = rows.withColumns({f"_o{k}": o for k, o in enumerate(order)})
    at = numbered(keyed, [f"_o{k}" for k in range(len(order))], "_at")
    return at.withColumn("split", F.when(F.col("_at") < c, "calib").when(F.col("_at") < c + t, "train").otherwise("test")).select(*rows.columns, "split")


def chained(*sources: DataFrame) -> DataFrame:
    """Sources one after the other, with the number of each in column part."""
    out = None
    for k, df in enumerate(sources):
        one = df.withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def with_audio(manifest: DataFrame, clips: DataFrame) -> DataFrame:
    """Manifest rows with sr and samples of their file; rows whose file is missing or no audio go."""
    return manifest.join(clips.where("samples IS NOT NULL"), "path")


def uploads(files: DataFrame, most_bytes: int = 60 * 256 * 1024) -> DataFrame:
    """files (content binary) with status: 200, 413 for too large ones, 400 for empty or missing ones."""
    size = F.length("content")
    return files.withColumn("status", F.when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > most_bytes, 413).otherwise(200))


def first_seconds(clips: DataFrame, seconds: int = 60) -> DataFrame:
    """Clips (sr, samples) cut to their first seconds."""
    return clips.withColumn("samples", F.slice("samples", F.lit(1), F.col("sr") * seconds))


def run_grid(spark: SparkSession, generators: list[str], seeds: list[int]) -> DataFrame:
    return spark.createDataFrame([(g, s) for g in generators for s in seeds], "generator string, seed long")


def save_clips(clips: DataFrame, path: str) -> None:
    """Clips in a folder a channel."""
    clips.write.mode("overwrite").partitionBy("channel").parquet(path)
