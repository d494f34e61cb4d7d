"""Reference profiles of live speech by channel, and the analysis of segments against them.

deltas: clip, check_id, n_test, delta. segments: clip, channel, speaker. bits: clip, i, bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import randomness

ORDERS = (1, 2, 4)
LEAST_SEGMENTS, LEAST_SPEAKERS, LEAST_BITS = 500, 50, 20


def headers(segments: DataFrame) -> DataFrame:
    """channel, n_segments, n_speakers, underpowered."""
    out = segments.groupBy("channel").agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("speaker").alias("n_speakers"))
    return out.withColumn("underpowered", (F.col("n_segments") < LEAST_SEGMENTS) | (F.col("n_speakers") < LEAST_SPEAKERS))


def statistics(deltas: DataFrame, segments: DataFrame, style: str = "rich") -> DataFrame:
    """The deltas' statistics by channel and check."""
    return randomness.profile(deltas.join(segments.select("clip", "channel"), "clip"), ["channel", "check_id"], style)


def long_enough(bits: DataFrame, least: int = LEAST_BITS) -> DataFrame:
    """The bits of clips that have `least` or more."""
    return bits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("clip"))).where(F.col("_n") >= least).drop("_n")


def transitions(bits: DataFrame, bit: str, segments: DataFrame, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """channel, order, ctx, b, p: how often a bit follows a context in a channel's clips, one added to every cell."""
    counts = randomness.all_markov_counts(bits, bit, orders).join(segments.select("clip", "channel"), "clip")
    total = counts.groupBy("channel", "order", "ctx", "b").agg((F.sum(F.col("o") - 1) + 1).alias("o"))
    return total.select("channel", "order", "ctx", "b", (F.col("o") / F.sum("o").over(Window.partitionBy("channel", "order", "ctx"))).alias("p"))


def markov_p(bits: DataFrame, bit: str, segments: DataFrame, pi0: DataFrame | None, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """clip, order, chi2, p: each clip's transitions against its channel's, or against evenness."""
    counts = randomness.all_markov_counts(bits, bit, orders).join(segments.select("clip", "channel"), "clip")
    if pi0 is None:
        counts = counts.withColumn("p", F.lit(0.5))
    else:
        known = pi0.select("channel", "order", "ctx", "b", "p")
        counts = counts.join(known, ["channel", "order", "ctx", "b"], "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
    # of a context's cells the expected counts share its total
    row = Window.partitionBy("clip", "order", "ctx")
    e = F.sum("o").over(row) * F.col("p")
    rated = counts.select("clip", "order", F.when(e > 0, F.pow(F.col("o") - e, 2) / e).alias("term"))
    chi = rated.groupBy("clip", "order").agg(F.sum("term").alias("chi2"))
    tail = F.coalesce(*(F.when(F.col("order") == k, scalars.chi2_tail(F.col("chi2"), 1 << k)) for k in orders))
    return chi.select("clip", "order", "chi2", tail.alias("p"))


def analysed(deltas: DataFrame, segments: DataFrame, stats: DataFrame, chances: DataFrame, style: str = "rich", robust: bool = False) -> DataFrame:
    """clip, s2, n_checks, delta and z by check, p by check (two-sided normal) and chi2_p by order of each segment."""
    z = randomness.z_scores(deltas.join(segments.select("clip", "channel"), "clip"), stats, ["channel", "check_id"], style, robust)
    pack = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct("check_id", v)))))
    z = z.withColumn("p", scalars.two_sided_p(F.col("z")))
    scores = z.groupBy("clip").agg(F.coalesce(F.max(F.abs("z")), F.lit(0.0)).alias("s2"), F.count("z").alias("n_checks"), pack("delta").alias("delta"), pack("z").alias("z"), pack("p").alias("p"))
    tails = chances.groupBy("clip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("order_"), F.col("order")).alias("k"), F.col("p").alias("v"))))).alias("chi2_p"))
    return scores.join(tails, "clip", "left")


def save(path: str, stats: DataFrame, head: DataFrame, pi0: DataFrame, config: dict[str, str]) -> None:
    """One JSON line a channel, with the configuration that it holds for."""
    fields = [c for c in stats.columns if c not in ("channel", "check_id")]
    checks = stats.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("check_id", *fields))).alias("checks"))
    cells = pi0.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("order", "ctx", "b", "p"))).alias("pi0"))
    known = F.map_from_arrays(F.array(*map(F.lit, config)), F.array(*map(F.lit, config.values())))
    out = head.join(checks, "channel").join(cells, "channel", "left").withColumn("config", known)
    out.select(F.to_json(F.struct(*out.columns)).alias("value")).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, config: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics, header, transitions); an error where a profile was built with another configuration."""
    raw = spark.read.schema(
        "channel string, n_segments long, n_speakers long, underpowered boolean, config map<string,string>, "
        "checks array<struct<check_id:string,mu0:double,sigma0:double,median0:double,mad0:double,sigma_samp:double,n:long,sigma_spk:double>>, pi0 array<struct<order:int,ctx:long,b:int,p:double>>"
    ).json(path)
    for r in raw.select("channel", "config").collect():  # one row a channel
        other = {k: v for k, v in config.items() if (r["config"] or {}).get(k) != v}
        if other:
            raise ValueError(f"the profile of {r['channel']} was built with another {', '.join(sorted(other))}")
    return raw.select("channel", F.inline("checks")), raw.select("channel", "n_segments", "n_speakers", "underpowered"), raw.select("channel", F.inline("pi0"))
