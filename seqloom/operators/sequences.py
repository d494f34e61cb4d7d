"""Ordered sequences: frames, speech segments, windows, blocks, splits.

A sequence table is long: `clip`, `i` (from 0, without gaps) and a value column. All windows are partitioned by clip, so that clips
spread over tasks and a clip's rows are ordered inside one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, clip: str, order: list[str]) -> DataFrame:
    """With columns clip and i, the row's place in its clip."""
    return df.withColumn("clip", F.col(clip)).withColumn("i", F.row_number().over(Window.partitionBy(clip).orderBy(*order)).cast("long") - 1)


def in_clip(order: str = "i") -> Window:
    return Window.partitionBy("clip").orderBy(order)


def framed(seq: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """With the frame number; whole: rows of a last, shorter frame go."""
    out = seq.withColumn("frame", F.floor(F.col("i") / length))
    return out.where((F.count(F.lit(1)).over(Window.partitionBy("clip", "frame"))) == length) if whole else out


def binarised(seq: DataFrame, value: str, frame: int) -> DataFrame:
    """bit: 1 where the value is above its frame's median."""
    out = framed(seq, frame)
    return out.withColumn("bit", (F.col(value) > F.median(value).over(Window.partitionBy("clip", "frame"))).cast("int"))


def frame_power(seq: DataFrame, value: str, frame: int) -> DataFrame:
    return framed(seq, frame).groupBy("clip", "frame").agg(F.avg(F.col(value) * F.col(value)).alias("power"), F.count(F.lit(1)).alias("n"))


def active_power(seq: DataFrame, value: str, frame: int, gate_db: float = 30.0) -> DataFrame:
    """clip, power: mean square of the samples of whole frames within gate_db of the loudest; of all samples if the clip is silent."""
    power = framed(seq, frame).groupBy("clip", "frame").agg(F.sum(F.col(value) * F.col(value)).alias("energy"), F.count(F.lit(1)).alias("n"))
    whole = F.col("n") == frame
    level = F.when(whole, F.col("energy") / F.col("n"))
    top = F.max(level).over(Window.partitionBy("clip"))
    rated = power.withColumn("active", F.coalesce(whole & (level >= top * 10 ** (-gate_db / 10)) & (top > 0), F.lit(False)))
    own = lambda c: F.sum(F.when(F.col("active"), F.col(c)))
    return rated.groupBy("clip").agg(F.coalesce(own("energy") / own("n"), F.sum("energy") / F.sum("n")).alias("power"))


def normalised(seq: DataFrame, value: str, peak: float = 0.9) -> DataFrame:
    top = F.max(F.abs(value)).over(Window.partitionBy("clip"))
    return seq.withColumn("scaled", F.when(top > 0, F.col(value) / top * peak).otherwise(F.col(value)))


def segments(speech: DataFrame, quota: int = 50, least: float = 0.5) -> DataFrame:
    """Rows of speech frames (clip, i) with the segment that each falls in; a last segment below least * quota frames goes."""
    place = F.row_number().over(in_clip()) - 1
    out = speech.withColumn("seg", F.floor(place / quota))
    return out.withColumn("in_seg", F.count(F.lit(1)).over(Window.partitionBy("clip", "seg"))).where(F.col("in_seg") >= least * quota)


def speech_mask(power: DataFrame, gate_db: float = 30.0) -> DataFrame:
    """Energy voice activity: a frame is speech if it is within gate_db of the clip's loudest."""
    return power.withColumn("speech", F.col("power") >= F.max("power").over(Window.partitionBy("clip")) * 10 ** (-gate_db / 10))


def chosen_frames(frames: DataFrame, which: str) -> DataFrame:
    if which == "all":
        return frames
    if which not in ("voiced", "unvoiced"):
        raise ValueError(f"frames must be all, voiced or unvoiced, not {which!r}")
    return frames.where(F.col("voiced") if which == "voiced" else ~F.col("voiced"))


def turned(seq: DataFrame) -> DataFrame:
    """The sequence from its end."""
    return seq.withColumn("i", F.max("i").over(Window.partitionBy("clip")) - F.col("i"))


def context(bit: str, order: int) -> Column:
    """The number that the `order` bits before a row make, the oldest the most significant; null where they are not all there."""
    w = in_clip()
    return sum((F.lag(bit, k).over(w) * (1 << (k - 1)) for k in range(2, order + 1)), F.lag(bit, 1).over(w)) if order else F.lit(0)


def windows(seq: DataFrame, bit: str, w: int) -> DataFrame:
    """clip, i, ctx, y: each window of w bits as a number, and the bit after it; i counts windows."""
    out = seq.select("clip", "i", context(bit, w).cast("long").alias("ctx"), F.col(bit).alias("y")).where(F.col("i") >= w)
    return out.withColumn("i", F.col("i") - w)


def all_windows(seq: DataFrame, bit: str, widths: tuple[int, ...]) -> DataFrame:
    """clip, w, i, ctx, y, n: the windows of every width, and n, how many of that width the clip has. The sequence is read and sorted once."""
    return masked(seq.select("clip", "i", F.col(bit).alias("y"), longest_context(bit, max(widths)), F.count(F.lit(1)).over(Window.partitionBy("clip")).alias("_n")), widths).select(
        "clip", "w", (F.col("i") - F.col("w")).alias("i"), "ctx", "y", (F.col("_n") - F.col("w")).alias("n")
    )


def longest_context(bit: str, most: int) -> Column:
    """The context of `most` bits; those before the sequence count as 0."""
    order = in_clip()
    return sum((F.coalesce(F.lag(bit, k).over(order), F.lit(0)).cast("long") * (1 << (k - 1)) for k in range(1, most + 1)), F.lit(0).cast("long")).alias("_c")


def masked(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """A row for each width whose window is whole, with w and ctx: a shorter context is the end of a longer one."""
    each = F.array(*(F.struct(F.lit(w).alias("w"), F.col("_c").bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("ctx")) for w in widths))
    return rows.withColumn("_e", F.explode(each)).select("*", "_e.*").drop("_e", "_c").where(F.col("i") >= F.col("w"))


def blocks(seq: DataFrame, bit: str, w: int) -> DataFrame:
    """clip, b, code, n: blocks of w bits as numbers; those that are not whole go."""
    place = F.col("i") % w
    out = seq.groupBy("clip", F.floor(F.col("i") / w).alias("b")).agg(F.sum(F.col(bit) * F.pow(F.lit(2), w - 1 - place).cast("long")).alias("code"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") == w).drop("n")


def block_pairs(seq: DataFrame, bit: str, w: int) -> DataFrame:
    after = F.lead("code").over(in_clip("b"))
    return blocks(seq, bit, w).withColumn("next", after).where("next IS NOT NULL")


def split(rows: DataFrame, order: str = "i", share: float = 0.8, most: int | None = None) -> DataFrame:
    """part: `train` for the first share of a clip's rows (of them only the last `most`, the others go), `test` for the rest."""
    n = F.count(F.lit(1)).over(Window.partitionBy("clip"))
    at = F.row_number().over(in_clip(order)) - 1
    cut = F.floor(n * share)
    out = rows.withColumn("part", F.when(at < cut, "train").otherwise("test"))
    return out if most is None else out.withColumn("_in", at >= cut - most).where("part = 'test' OR _in").drop("_in")
