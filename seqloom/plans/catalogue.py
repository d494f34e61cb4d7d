"""Queries over the driver's tables, each with the SQL that must give the same rows.

`events` stand for sample streams of sessions (clip = user_id, non-speech = error), `lineitem` for long streams (clip =
l_suppkey), `orders` for likelihood ratios of customers' calls, `customer` and `orders` for manifests, `labels` with
`documents` for scored detections. Doubles are rounded to six decimals on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import channel_spec, g711, scalars
from ..operators import channel, decisions, randomness, signal
from ..operators import sequences as S
from ..sources import manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def events(spark: SparkSession, d: str) -> DataFrame:
    return S.indexed(spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("clip", "i", F.col("value").alias("x"), (F.col("event_type") != "error").alias("speech"), "event_type")


def items(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    return S.indexed(spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", *order), "l_suppkey", order).select("clip", "i", F.col("l_extendedprice").alias("x"))


def bits(spark: SparkSession, d: str) -> DataFrame:
    return S.binarised(items(spark, d), "x", 160).select("clip", "i", "bit")


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/customer.parquet")
    return t.select("c_custkey", F.when(F.col("c_acctbal") < 0, "spoof").otherwise("live").alias("label"), F.col("c_nationkey").alias("speaker"), F.when(F.col("c_custkey") % 10 < 3, "calib").when(F.col("c_custkey") % 10 < 7, "train").otherwise("test").alias("split"))


E_SQL = "e AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, event_type <> 'error' AS speech, event_type FROM events)"
I_SQL = "s AS (SELECT l_suppkey AS clip, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS i, l_extendedprice AS x FROM lineitem)"
B_SQL = I_SQL + ", b AS (SELECT clip, i, CAST(x > median(x) OVER (PARTITION BY clip, i // 160) AS INTEGER) AS bit FROM s)"
M_SQL = "m AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'spoof' ELSE 'live' END AS label, c_nationkey AS speaker, CASE WHEN c_custkey % 10 < 3 THEN 'calib' WHEN c_custkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM customer)"


# manifests


@query(f"WITH {M_SQL} SELECT c_custkey, label, split FROM m WHERE split = 'test' AND label = 'live'")
def manifest_filter(spark, d):
    return manifest_rows(spark, d).where("split = 'test' AND label = 'live'").select("c_custkey", "label", "split")


@query(f"WITH {M_SQL} SELECT split, label, count(*) AS n FROM m GROUP BY ALL")
def split_label_counts(spark, d):
    return manifest_rows(spark, d).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {M_SQL} SELECT split, count(DISTINCT speaker) AS speakers FROM m GROUP BY split")
def speaker_nunique(spark, d):
    return manifest_rows(spark, d).groupBy("split").agg(F.countDistinct("speaker").alias("speakers"))


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus AS label, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o_orderdate, o_orderkey) AS k FROM a WHERE n <= 5)
SELECT o_orderkey, o_custkey, label FROM b WHERE k <= 300
""")
def clip_caps(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("label"), "o_orderdate")
    return manifest.capped(t, "o_custkey", "label", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "label")


@query("""
WITH p AS (SELECT DISTINCT o_custkey AS speaker FROM orders), q AS (SELECT speaker, row_number() OVER (ORDER BY (speaker * 7919) % 10007, speaker) - 1 AS pos, count(*) OVER () AS n FROM p)
SELECT speaker, CASE WHEN pos < greatest(1, CAST(floor(0.3 * n) AS BIGINT)) THEN 'calib' WHEN pos < greatest(1, CAST(floor(0.3 * n) AS BIGINT)) + greatest(1, CAST(floor(0.4 * n) AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM q
""")
def speaker_split(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey")
    return manifest.speaker_split(t, "o_custkey", (F.col("speaker") * 7919) % 10007)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def cache_anti_join(spark, d):
    """Customers of whom no large order is there yet."""
    work = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    done = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return manifest.outstanding(work, done, ["c_custkey"])


@query("""
SELECT n_nationkey, 'A_' || mode || '_w' || w || '_' || dir AS check_id FROM nation, (VALUES ('bit'), ('block')) m(mode), (VALUES (8), (16), (32)) v(w), (VALUES ('fwd'), ('bwd')) x(dir)
""")
def check_grid(spark, d):
    grid = F.array(*(F.struct(F.lit("A").alias("variant"), F.lit(m).alias("mode"), F.lit(w).alias("w"), F.lit(x).alias("dir")) for m in ("bit", "block") for w in (8, 16, 32) for x in ("fwd", "bwd")))
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.inline(grid)).select("n_nationkey", scalars.check_id(F.col("variant"), F.col("mode"), F.col("w"), F.col("dir")).alias("check_id"))


SPECS = ["clean", "g711a", "g711u+loss5", "amrnb_12.2", "amrnb_12.2+loss10+snr20", "amrwb_23.85+snr-5+loss2.5", "amrnb_12.2+loss1+loss3", "amrnb_4.75", "amrnb", "amrnb_9.9", "g711a_64", "clean+loss101", "clean+noise3", "mp3_128", "", "amrwb_6.60"]

#: Specifications of the parts: one of the list above, and a modifier with the part's size.
SPEC_SQL = f"""
v AS (SELECT p_partkey, ({SPECS})[p_partkey % {len(SPECS)} + 1] || CASE (p_partkey // {len(SPECS)}) % 4 WHEN 1 THEN '+loss' || p_size WHEN 2 THEN '+snr-' || p_size WHEN 3 THEN '+loss' || (p_size * 3) || '.5' ELSE '' END AS spec FROM part), p AS (
 SELECT p_partkey, spec, split_part(spec, '+', 1) AS head, string_split(spec, '+')[2:] AS mods FROM v), q AS (
 SELECT p_partkey, spec, head, mods, regexp_extract(head, '^([a-z0-9]+)', 1) AS codec, TRY_CAST(regexp_extract(head, '^[a-z0-9]+_([0-9]+(?:\\.[0-9]+)?)$', 1) AS DOUBLE) AS rate,
 list_transform(list_filter(mods, lambda m: regexp_full_match(m, 'loss[0-9]+(\\.[0-9]+)?')), lambda m: CAST(substr(m, 5) AS DOUBLE)) AS ls,
 list_transform(list_filter(mods, lambda m: regexp_full_match(m, 'snr-?[0-9]+(\\.[0-9]+)?')), lambda m: CAST(substr(m, 4) AS DOUBLE)) AS ns FROM p), r AS (
 SELECT *, coalesce(ls[-1], 0.0) AS loss, ns[-1] AS snr,
 CASE WHEN len(ls) + len(ns) <> len(mods) OR coalesce(ls[-1], 0) > 100 THEN false WHEN codec IN ('clean', 'g711a', 'g711u') THEN head = codec
 WHEN codec = 'amrnb' THEN coalesce(rate IN (4.75, 5.15, 5.9, 6.7, 7.4, 7.95, 10.2, 12.2), false)
 WHEN codec = 'amrwb' THEN coalesce(rate IN (6.6, 8.85, 12.65, 14.25, 15.85, 18.25, 19.85, 23.05, 23.85), false) ELSE false END AS valid FROM q)"""


def specified(spark, d):
    turn, size = F.floor(F.col("p_partkey") / len(SPECS)) % 4, F.col("p_size")
    more = F.when(turn == 1, F.concat(F.lit("+loss"), size)).when(turn == 2, F.concat(F.lit("+snr-"), size)).when(turn == 3, F.concat(F.lit("+loss"), size * 3, F.lit(".5"))).otherwise("")
    one = F.element_at(F.lit(SPECS), (F.col("p_partkey") % len(SPECS) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(one, more).alias("spec")).withColumn("p", channel_spec.parse(F.col("spec")))


@query(f"""
WITH {SPEC_SQL}
SELECT p_partkey, spec, valid, CASE WHEN valid THEN codec END AS codec, CASE WHEN valid THEN rate END AS bitrate_kbps, CASE WHEN valid THEN CAST(loss AS DOUBLE) END AS loss_pct, CASE WHEN valid THEN snr END AS snr_db FROM r
""")
def channel_spec_parse(spark, d):
    return specified(spark, d).select("p_partkey", "spec", "p.valid", "p.codec", "p.bitrate_kbps", "p.loss_pct", "p.snr_db")


@query("""
SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS turn, 0 AS source FROM supplier
UNION ALL SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey), 1 FROM nation
""")
def interleave_sources(spark, d):
    a = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    b = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    return manifest.interleaved(a, b, ["id"], ["id"]).select("id", F.col("turn").cast("long").alias("turn"), "source")


# frames and segments


@query(f"WITH {E_SQL} SELECT clip, i // 10 AS frame, round(avg(x * x), 6) AS power, count(*) AS n FROM e GROUP BY ALL")
def frame_power(spark, d):
    return S.frame_power(events(spark, d), "x", 10).select("clip", "frame", r6("power").alias("power"), "n")


@query(f"""
WITH {E_SQL}, p AS (SELECT clip, i // 10 AS frame, sum(x * x) AS en, count(*) AS n FROM e GROUP BY ALL),
q AS (SELECT *, CASE WHEN n = 10 THEN en / n END AS lv, max(CASE WHEN n = 10 THEN en / n END) OVER (PARTITION BY clip) AS top FROM p)
SELECT clip, round(coalesce(sum(en) FILTER (lv >= top * 0.001 AND top > 0) / sum(n) FILTER (lv >= top * 0.001 AND top > 0), sum(en) / sum(n)), 6) AS power FROM q GROUP BY clip
""")
def active_speech_power(spark, d):
    return S.active_power(events(spark, d), "x", 10).select("clip", r6("power").alias("power"))


@query(f"""
WITH {E_SQL}, f AS (SELECT clip, i, x, (row_number() OVER (PARTITION BY clip ORDER BY i) - 1) // 20 AS seg FROM e WHERE speech),
g AS (SELECT *, count(*) OVER (PARTITION BY clip, seg) AS n FROM f)
SELECT clip, seg, count(*) AS n, min(i) AS first_i, max(i) AS last_i, round(avg(x), 6) AS mean FROM g WHERE n >= 10 GROUP BY ALL
""")
def vad_segments(spark, d):
    seg = S.segments(events(spark, d).where("speech").select("clip", "i", "x"), quota=20)
    return seg.groupBy("clip", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), r6(F.avg("x")).alias("mean"))


@query(f"WITH {E_SQL} SELECT clip, i, round(x / max(abs(x)) OVER (PARTITION BY clip) * 0.9, 6) AS scaled FROM e")
def peak_normalise(spark, d):
    return S.normalised(events(spark, d), "x").select("clip", "i", r6("scaled").alias("scaled"))


# bits


@query(f"WITH {B_SQL} SELECT clip, i, bit FROM b")
def bits_binarize(spark, d):
    return bits(spark, d)


@query(f"WITH {B_SQL} SELECT clip, round(avg(bit), 6) AS ones FROM b GROUP BY clip")
def ones_ratio(spark, d):
    return bits(spark, d).groupBy("clip").agg(r6(F.avg("bit")).alias("ones"))


@query(f"""
WITH {B_SQL} SELECT clip, i - 4 AS i, lag(bit, 1) OVER w + 2 * lag(bit, 2) OVER w + 4 * lag(bit, 3) OVER w + 8 * lag(bit, 4) OVER w AS ctx, bit AS y FROM b WINDOW w AS (PARTITION BY clip ORDER BY i) QUALIFY i >= 4
""")
def sliding_windows(spark, d):
    return S.windows(bits(spark, d), "bit", 4).select("clip", "i", "ctx", "y")


BLOCKS_SQL = "k AS (SELECT clip, i // 8 AS b, CAST(sum(bit << CAST(7 - i % 8 AS INTEGER)) AS BIGINT) AS code FROM b GROUP BY ALL HAVING count(*) = 8)"


@query(f"WITH {B_SQL}, {BLOCKS_SQL} SELECT clip, b, code, lead(code) OVER w AS next FROM k WINDOW w AS (PARTITION BY clip ORDER BY b) QUALIFY next IS NOT NULL")
def block_pairs(spark, d):
    return S.block_pairs(bits(spark, d), "bit", 8).select("clip", "b", "code", "next")


@query(f"""
WITH {B_SQL}, w AS (SELECT clip, i - 8 AS i FROM b WHERE i >= 8), q AS (SELECT clip, i, count(*) OVER (PARTITION BY clip) AS n FROM w), t AS (SELECT clip, i, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part, floor(n * 0.8) AS cut FROM q)
SELECT clip, part, count(*) AS n, min(i) AS first_i, max(i) AS last_i FROM t WHERE part = 'test' OR i >= cut - 300 GROUP BY ALL
""")
def train_test_split(spark, d):
    t = S.split(S.windows(bits(spark, d), "bit", 8), most=300)
    return t.groupBy("clip", "part").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query(f"WITH {E_SQL} SELECT clip, max(i) OVER (PARTITION BY clip) - i AS i, x FROM e")
def reverse_sequence(spark, d):
    return S.turned(events(spark, d)).select("clip", "i", "x")


def counts_sql(order: int) -> str:
    ctx = " + ".join(f"{1 << (k - 1)} * lag(bit, {k}) OVER w" for k in range(1, order + 1))
    return f"{B_SQL}, c AS (SELECT clip, i, {ctx} AS ctx, bit FROM b WINDOW w AS (PARTITION BY clip ORDER BY i)), g AS (SELECT clip, ctx, bit AS b, count(*) AS c FROM c WHERE i >= {order} GROUP BY ALL), z AS (SELECT DISTINCT clip FROM b), o AS (SELECT z.clip, x.ctx, y.b, coalesce(g.c, 0) + 1 AS o FROM z CROSS JOIN (SELECT unnest(range({1 << order})) AS ctx) x CROSS JOIN (SELECT unnest([0, 1]) AS b) y LEFT JOIN g ON g.clip = z.clip AND g.ctx = x.ctx AND g.b = y.b)"


@query(f"WITH {counts_sql(2)} SELECT clip, ctx, CAST(b AS INTEGER) AS b, o FROM o")
def markov_counts(spark, d):
    return randomness.markov_counts(bits(spark, d), "bit", 2)


def chi2_query(order: int):
    rest = " + ".join("1.0" if k == 0 else f"power(chi2 / 2, {k}) / {math.factorial(k)}" for k in range(1 << (order - 1)))
    sql = f"WITH {counts_sql(order)}, n AS (SELECT *, sum(o) OVER (PARTITION BY clip, ctx) * 0.5 AS ex FROM o), x AS (SELECT clip, CAST(sum((o - ex) * (o - ex) / ex) AS DOUBLE) AS chi2 FROM n GROUP BY clip) SELECT clip, round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * ({rest}), 6) AS p FROM x"

    def run(spark, d):
        chi = randomness.markov_chi2(randomness.markov_counts(bits(spark, d), "bit", order))
        return chi.withColumn("p", scalars.chi2_tail(F.col("chi2"), 1 << order)).select("clip", r6("chi2").alias("chi2"), r6("p").alias("p"))

    run.__name__ = f"markov_chi2_o{order}"
    query(sql)(run)


for _order in (2, 4, 6):
    chi2_query(_order)


@query(f"WITH {counts_sql(2)}, t AS (SELECT ctx, b, sum(o - 1) + 1 AS o FROM o GROUP BY ALL) SELECT ctx, CAST(b AS INTEGER) AS b, round(o / sum(o) OVER (PARTITION BY ctx), 6) AS p FROM t")
def pi0_profile(spark, d):
    return randomness.transition_profile(randomness.markov_counts(bits(spark, d), "bit", 2)).select("ctx", "b", r6("p").alias("p"))


@query(f"""
WITH {B_SQL}, c AS (SELECT clip, i, lag(bit, 1) OVER w + 2 * lag(bit, 2) OVER w + 4 * lag(bit, 3) OVER w + 8 * lag(bit, 4) OVER w AS ctx FROM b WINDOW w AS (PARTITION BY clip ORDER BY i)),
n AS (SELECT clip, i, ctx, lead(ctx, 4) OVER (PARTITION BY clip ORDER BY i) AS next FROM c)
SELECT clip, ctx, next, count(*) AS c FROM n WHERE i >= 4 AND next IS NOT NULL GROUP BY ALL
""")
def block_transitions(spark, d):
    return randomness.block_transitions(bits(spark, d), "bit", 4)


@query(f"""
WITH {B_SQL}, w AS (SELECT clip, i - 4 AS i, lag(bit, 1) OVER z + 2 * lag(bit, 2) OVER z + 4 * lag(bit, 3) OVER z + 8 * lag(bit, 4) OVER z AS ctx, bit AS y, i AS j FROM b WINDOW z AS (PARTITION BY clip ORDER BY i)),
h AS (SELECT clip, i, ctx, y, floor((count(*) OVER (PARTITION BY clip) + 4) / 2.0) AS half FROM w WHERE j >= 4),
t AS (SELECT clip, ctx, CASE WHEN sum(y) > 0 THEN power(sum(y) - count(*) / 2.0, 2) / (count(*) / 2.0) ELSE 0 END + CASE WHEN sum(1 - y) > 0 THEN power(sum(1 - y) - count(*) / 2.0, 2) / (count(*) / 2.0) ELSE 0 END AS chi2 FROM h WHERE i < half GROUP BY ALL)
SELECT h.clip, count(*) AS n, round(avg(chi2), 6) AS chi2 FROM h JOIN t USING (clip, ctx) WHERE i >= half GROUP BY h.clip
""")
def legacy_stat_prediction(spark, d):
    return randomness.legacy_statistics(bits(spark, d), "bit", 4).select("clip", "n", r6("chi2").alias("chi2"))


@query("""
WITH g AS (SELECT l_suppkey AS clip, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem GROUP BY 1),
h AS (SELECT clip, CAST(a + 1 AS DOUBLE) AS a, CAST(b + 1 AS DOUBLE) AS b, CAST(c + 1 AS DOUBLE) AS c, CAST(d + 1 AS DOUBLE) AS d FROM g)
SELECT clip, round((a + b + c + d) * power(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS chi2 FROM h
""")
def block_contingency_chi2(spark, d):
    r, s = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("clip")).agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("a", r & s), ("b", r & ~s), ("c", ~r & s), ("d", ~r & ~s))))
    return t.select("clip", r6(randomness.contingency_chi2(*map(F.col, "abcd"))).alias("chi2"))


DELTA_SQL = """
w AS (SELECT clip, i - 4 AS i, lag(bit, 1) OVER z + 2 * lag(bit, 2) OVER z + 4 * lag(bit, 3) OVER z + 8 * lag(bit, 4) OVER z AS ctx, bit AS y, i AS j FROM b WINDOW z AS (PARTITION BY clip ORDER BY i)),
h AS (SELECT clip, i, ctx, y, floor(0.8 * count(*) OVER (PARTITION BY clip)) AS cut FROM w WHERE j >= 4),
t AS (SELECT clip, ctx, CAST(2 * sum(y) > count(*) AS INTEGER) AS guess FROM h WHERE i < cut GROUP BY ALL),
dl AS (SELECT h.clip, count(*) AS n_test, avg(CAST(coalesce(guess, 0) = y AS INTEGER)) - 0.5 AS delta FROM h LEFT JOIN t USING (clip, ctx) WHERE i >= cut GROUP BY h.clip)
"""


@query(f"WITH {B_SQL}, {DELTA_SQL} SELECT clip, n_test, round(delta, 6) AS delta FROM dl")
def majority_predictor_delta(spark, d):
    return randomness.counted_predictor(bits(spark, d), "bit", 4).select("clip", "n_test", r6("delta").alias("delta"))


@query(f"""
WITH {B_SQL}, {DELTA_SQL}, q AS (SELECT clip % 4 AS channel, delta, n_test FROM dl), m AS (SELECT channel, median(delta) AS median0 FROM q GROUP BY 1)
SELECT q.channel, round(avg(delta), 6) AS mu0, round(stddev_samp(delta), 6) AS sigma0, round(any_value(median0), 6) AS median0, round(median(abs(delta - median0)) * 1.4826, 6) AS mad0, round(1 / (2 * sqrt(avg(n_test))), 6) AS sigma_samp,
count(*) AS n, round(sqrt(greatest(0, var_samp(delta) - 1 / (4 * avg(n_test)))), 6) AS sigma_spk FROM q JOIN m USING (channel) GROUP BY q.channel
""")
def profile_stats(spark, d):
    t = randomness.counted_predictor(bits(spark, d), "bit", 4).withColumn("channel", F.col("clip") % 4)
    out = randomness.profile(t, ["channel"], "rich")
    return out.select(*(r6(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query(f"""
WITH {B_SQL}, {DELTA_SQL}, q AS (SELECT clip, clip % 4 AS channel, delta FROM dl), r AS (SELECT channel, avg(delta) AS mu0, greatest(stddev_pop(delta), 1e-6) AS s0 FROM q WHERE clip % 2 = 0 GROUP BY 1)
SELECT q.clip, round(abs((delta - coalesce(mu0, 0)) / greatest(coalesce(s0, 1), 1e-9)), 5) AS s2 FROM q LEFT JOIN r USING (channel)
""")
def zscore_s2(spark, d):
    t = randomness.counted_predictor(bits(spark, d), "bit", 4).withColumn("channel", F.col("clip") % 4)
    ref = randomness.profile(t.where("clip % 2 = 0"), ["channel"], "simple")
    return randomness.strongest(randomness.z_scores(t, ref, ["channel"], "simple"), "clip").select("clip", F.round("s2", 5).alias("s2"))


# pitch periods


@query(f"WITH {E_SQL}, j AS (SELECT clip, i, (lead(x) OVER (PARTITION BY clip ORDER BY i) - x) / avg(x) OVER (PARTITION BY clip) AS d FROM e) SELECT clip, i, round(d, 6) AS d, CAST(d > 0 AS INTEGER) AS bit FROM j WHERE d IS NOT NULL")
def jitter(spark, d):
    return signal.jitter(events(spark, d), "x").select("clip", "i", r6("d").alias("d"), "bit")


@query(f"WITH {E_SQL}, j AS (SELECT clip, lead(x) OVER (PARTITION BY clip ORDER BY i) - x AS d FROM e) SELECT clip, count(*) AS n, sum(CAST(d > 0 AS INTEGER)) AS ones FROM j WHERE d IS NOT NULL GROUP BY clip")
def symbols_b(spark, d):
    return signal.jitter(events(spark, d), "x").groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"))


@query(f"WITH {E_SQL} SELECT clip, i, round(x / 25000, 9) AS dt FROM e WHERE x / 25000 BETWEEN 0.8 / 600 AND 1.2 / 75")
def period_filter(spark, d):
    return signal.valid_periods(events(spark, d).withColumn("dt", F.col("x") / 25000), "dt").select("clip", "i", F.round("dt", 9).alias("dt"))


# companding and loss

PCM_SQL = "p AS (SELECT DISTINCT CAST(round(l_extendedprice * 100) AS BIGINT) % 65536 - 32768 AS pcm FROM lineitem)"


def _pcm(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select((F.round(F.col("l_extendedprice") * 100).cast("long") % 65536 - 32768).alias("pcm")).distinct()


@query(f"""
WITH {PCM_SQL}, a AS (SELECT pcm, least(abs(pcm), 32767) >> 3 AS a FROM p), s AS (SELECT *, CASE WHEN a >= 2048 THEN 7 WHEN a >= 1024 THEN 6 WHEN a >= 512 THEN 5 WHEN a >= 256 THEN 4 WHEN a >= 128 THEN 3 WHEN a >= 64 THEN 2 WHEN a >= 32 THEN 1 ELSE 0 END AS s FROM a),
m AS (SELECT pcm, s, (CASE WHEN s = 0 THEN a >> 1 ELSE a >> s END) & 15 AS m FROM s), v AS (SELECT *, CASE WHEN s = 0 THEN m * 16 + 8 ELSE (m * 16 + 264) << (s - 1) END AS v FROM m)
SELECT pcm, CAST(xor((CASE WHEN pcm >= 0 THEN 128 ELSE 0 END) + s * 16 + m, 85) AS INTEGER) AS code, CAST(CASE WHEN pcm >= 0 THEN v ELSE -v END AS INTEGER) AS decoded FROM v
""")
def g711_alaw(spark, d):
    return _pcm(spark, d).withColumn("code", g711.alaw_encode(F.col("pcm"))).withColumn("decoded", g711.alaw_decode(F.col("code")))


@query(f"""
WITH {PCM_SQL}, a AS (SELECT pcm, least(abs(pcm) + 132, 32767) AS a FROM p), s AS (SELECT *, CASE WHEN a >= 16384 THEN 7 WHEN a >= 8192 THEN 6 WHEN a >= 4096 THEN 5 WHEN a >= 2048 THEN 4 WHEN a >= 1024 THEN 3 WHEN a >= 512 THEN 2 WHEN a >= 256 THEN 1 ELSE 0 END AS s FROM a),
m AS (SELECT pcm, s, (a >> (s + 3)) & 15 AS m FROM s), v AS (SELECT *, ((m * 8 + 132) << s) - 132 AS v FROM m)
SELECT pcm, CAST(255 - ((CASE WHEN pcm < 0 THEN 128 ELSE 0 END) + s * 16 + m) AS INTEGER) AS code, CAST(CASE WHEN pcm < 0 THEN -v ELSE v END AS INTEGER) AS decoded FROM v
""")
def g711_ulaw(spark, d):
    return _pcm(spark, d).withColumn("code", g711.ulaw_encode(F.col("pcm"))).withColumn("decoded", g711.ulaw_decode(F.col("code")))


LOSS_SQL = I_SQL + ", f AS (SELECT clip, i, x, i // 16 AS frame, i % 16 AS j, CAST((clip * 31 + (i // 16) * 17) % 10 < 4 AS INTEGER) AS lost FROM s), fr AS (SELECT DISTINCT clip, frame, lost FROM f)"


def _lossy(spark, d):
    t = S.framed(items(spark, d), 16)
    return t.withColumn("lost", ((F.col("clip") * 31 + F.col("frame") * 17) % 10 < 4).cast("int"))


@query(f"""
WITH {LOSS_SQL}, g AS (SELECT *, sum(1 - lost) OVER w AS island, max(CASE WHEN lost = 0 THEN frame END) OVER w AS source FROM fr WINDOW w AS (PARTITION BY clip ORDER BY frame)),
k AS (SELECT *, CASE WHEN lost = 1 THEN row_number() OVER (PARTITION BY clip, island, lost ORDER BY frame) END AS k FROM g),
y AS (SELECT f.*, k.k, coalesce(h.x, 0) * power(10, -6.0 * k.k / 20) AS y, coalesce(t.x, 0) AS tail FROM f JOIN k ON f.clip = k.clip AND f.frame = k.frame LEFT JOIN f h ON h.clip = f.clip AND h.frame = k.source AND h.j = f.j LEFT JOIN f t ON t.clip = f.clip AND t.frame = f.frame - 1 AND t.j = f.j + 12)
SELECT clip, i, lost, round(CASE WHEN lost = 0 THEN x WHEN k = 1 AND frame > 0 AND j < 4 THEN (1 - j / 3.0) * tail + j / 3.0 * y ELSE y END, 5) AS y FROM y
""")
def loss_islands_plc(spark, d):
    return channel.concealed(_lossy(spark, d), "x", 16).select("clip", "i", "lost", F.round("y", 5).alias("y"))


@query(f"WITH {LOSS_SQL} SELECT clip, round(100 * avg(lost), 6) AS loss_pct FROM fr GROUP BY clip")
def actual_loss(spark, d):
    frames = _lossy(spark, d).select("clip", "frame", "lost").distinct()
    return channel.actual_loss(frames).select("clip", r6("loss_pct").alias("loss_pct"))


# linear prediction

R_SQL = E_SQL + ", v AS (SELECT clip, i, i // 10 AS frame, (x - 250) / 250 AS x FROM e), l AS (SELECT clip, frame, x, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM v WINDOW w AS (PARTITION BY clip, frame ORDER BY i)), r AS (SELECT clip, frame, sum(x * x) AS r0, coalesce(sum(x * x1), 0) AS r1, coalesce(sum(x * x2), 0) AS r2 FROM l GROUP BY ALL)"
A_SQL = ", a AS (SELECT clip, frame, CASE WHEN r0 > 0 AND r0 * (1 + 1e-9) * (r0 * (1 + 1e-9)) - r1 * r1 > 0 THEN r1 * (r0 * (1 + 1e-9) - r2) / (r0 * (1 + 1e-9) * (r0 * (1 + 1e-9)) - r1 * r1) ELSE 0 END AS a1, CASE WHEN r0 > 0 AND r0 * (1 + 1e-9) * (r0 * (1 + 1e-9)) - r1 * r1 > 0 THEN (r0 * (1 + 1e-9) * r2 - r1 * r1) / (r0 * (1 + 1e-9) * (r0 * (1 + 1e-9)) - r1 * r1) ELSE 0 END AS a2 FROM r)"


def _centred(spark, d):
    return events(spark, d).withColumn("x", (F.col("x") - 250) / 250)


@query(f"WITH {R_SQL} SELECT clip, frame, round(r0, 6) AS r0, round(r1, 6) AS r1, round(r2, 6) AS r2 FROM r")
def autocorr(spark, d):
    return signal.autocorrelation(_centred(spark, d), "x", 10, 2).select("clip", "frame", *(r6(c).alias(c) for c in ("r0", "r1", "r2")))


@query(f"WITH {R_SQL}{A_SQL} SELECT clip, frame, round(a1, 5) AS a1, round(a2, 5) AS a2 FROM a")
def lpc_order2(spark, d):
    t = signal.lpc2(signal.rounded(signal.autocorrelation(_centred(spark, d), "x", 10, 2), 9))
    return t.select("clip", "frame", F.round("a1", 5).alias("a1"), F.round("a2", 5).alias("a2"))


@query(f"""
WITH {R_SQL}{A_SQL}, h AS (SELECT clip, i, frame, x, coalesce(lag(x, 1) OVER w, 0) AS h1, coalesce(lag(x, 2) OVER w, 0) AS h2 FROM v WINDOW w AS (PARTITION BY clip ORDER BY i))
SELECT h.clip, i, round(x - a1 * h1 - a2 * h2, 5) AS e FROM h JOIN a USING (clip, frame)
""")
def lpc_residual(spark, d):
    return signal.residual2(_centred(spark, d), "x", 10).select("clip", "i", F.round("e", 5).alias("e"))


@query(f"""
WITH {E_SQL}, l AS (SELECT unnest(range(6)) AS lag), c AS (SELECT a.clip, lag, sum(a.x * b.x * (1 + b.i % 3)) AS corr FROM e a CROSS JOIN l JOIN e b ON b.clip = a.clip AND b.i = a.i + lag GROUP BY ALL)
SELECT clip, CAST(arg_max(lag, struct_pack(c := corr, l := -lag)) AS INTEGER) AS lag FROM c GROUP BY clip
""")
def xcorr_lag(spark, d):
    t = events(spark, d)
    return channel.best_lag(t, t.withColumn("x", F.col("x") * (1 + F.col("i") % 3)), 5)


# verdicts

UPPER, LOWER = scalars.barriers(0.01, 0.05)
SPRT_SQL = f"""
o AS (SELECT o_custkey AS clip, o_orderkey, (o_totalprice - 250000) / 144000 AS llr, row_number() OVER w AS k, sum((o_totalprice - 250000) / 144000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
st AS (SELECT *, min(CASE WHEN c >= {UPPER!r} OR c <= {LOWER!r} OR k >= 8 THEN k END) OVER (PARTITION BY clip ORDER BY k) AS stop FROM o),
v AS (SELECT a.clip, a.k, a.stop, coalesce(b.c, a.c) AS "lambda" FROM st a LEFT JOIN o b ON b.clip = a.clip AND b.k = a.stop),
sp AS (SELECT clip, k, "lambda", CASE WHEN stop IS NULL THEN 'pending' WHEN "lambda" >= {UPPER!r} THEN 'suspicious' WHEN "lambda" <= {LOWER!r} THEN 'normal' ELSE 'undecided' END AS verdict FROM v)
"""


def calls(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return S.indexed(t, "o_custkey", ["o_orderdate", "o_orderkey"]).select("clip", "i", ((F.col("o_totalprice") - 250000) / 144000).alias("llr"))


@query(f'WITH {SPRT_SQL} SELECT clip, CAST(k AS BIGINT) AS k, round("lambda", 9) AS "lambda", verdict FROM sp')
def sprt_verdicts(spark, d):
    return decisions.sprt(calls(spark, d), "llr").select("clip", F.col("k").cast("long").alias("k"), F.round("lambda", 9).alias("lambda"), "verdict")


@query(f"WITH {SPRT_SQL} SELECT clip, coalesce(arg_max(verdict, k) FILTER (verdict <> 'pending'), 'undecided') AS verdict FROM sp GROUP BY clip")
def final_verdict(spark, d):
    return decisions.final_verdicts(decisions.sprt(calls(spark, d), "llr"))


@query(f"WITH {E_SQL} SELECT clip, i, last_value(CASE WHEN event_type = 'purchase' THEN x END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s2 FROM e")
def late_d2_asof(spark, d):
    t = events(spark, d).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("x")))
    return t.select("clip", "i", decisions.latest_before("v").alias("s2"))


SCORED_SQL = "q AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS s, source FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)"


def scored(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", "source")
    return spark.read.parquet(f"{d}/labels.parquet").join(t, "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s"), "source").dropna(subset=["y", "s"])


@query(f"WITH {SCORED_SQL}, g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM q GROUP BY s), h AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM h")
def auc(spark, d):
    return decisions.auc(scored(spark, d), "s", "y").select(r6("auc").alias("auc"))


@query(f"""
WITH {SCORED_SQL}, g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM q GROUP BY s), c AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g WINDOW w AS (ORDER BY s DESC)),
r AS (SELECT s, fp / nn AS fpr, 1 - tp / np AS fnr FROM c) SELECT round((fpr + fnr) / 2, 6) AS eer FROM r ORDER BY round(abs(fpr - fnr), 12), s DESC LIMIT 1
""")
def eer(spark, d):
    return decisions.eer(scored(spark, d), "s", "y").select(r6("eer").alias("eer"))


@query(f"WITH {SCORED_SQL} SELECT y, round(avg(s), 6) AS mean, count(*) AS n FROM q GROUP BY y")
def class_means(spark, d):
    return scored(spark, d).groupBy("y").agg(r6(F.avg("s")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED_SQL} SELECT round(avg(CAST((y = 1) = (s > 1000) AS INTEGER)), 6) AS accuracy, round(avg(CAST(s > 1000 AS INTEGER)) FILTER (y = 0), 6) AS false_alarm_rate, round(avg(CAST(s > 1000 AS INTEGER)) FILTER (y = 1), 6) AS detection_rate FROM q")
def confusion(spark, d):
    t = decisions.confusion(scored(spark, d), F.col("y") == 1, F.col("s") > 1000)
    return t.select(*(r6(c).alias(c) for c in t.columns))


@query(f"WITH {SPRT_SQL}, x AS (SELECT sp.*, o.llr FROM sp JOIN o USING (clip, k)) SELECT clip, round(avg(llr), 6) AS mean_llr, count(*) AS n, arg_max(verdict, k) AS verdict FROM x GROUP BY clip")
def clip_summary(spark, d):
    t = decisions.sprt(calls(spark, d), "llr")
    return t.groupBy("clip").agg(r6(F.avg("llr")).alias("mean_llr"), F.count(F.lit(1)).alias("n"), F.max_by("verdict", "k").alias("verdict"))


@query(f"WITH {SCORED_SQL}, g AS (SELECT source, avg(CAST((y = 1) = (s > 1000) AS INTEGER)) AS a FROM q GROUP BY 1) SELECT bool_or(a >= 0.65) AS passed, count(*) AS n FROM g")
def gate_any(spark, d):
    t = scored(spark, d).groupBy("source").agg(F.avg(((F.col("y") == 1) == (F.col("s") > 1000)).cast("double")).alias("a"))
    return t.agg(F.bool_or(F.col("a") >= 0.65).alias("passed"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_regionkey AS label, c_mktsegment AS split, count(*) AS clips, count(DISTINCT c_nationkey) AS speakers, round(sum(c_acctbal), 2) AS hours FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)
""")
def stats_cube(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.rollup(F.col("n_regionkey").alias("label"), F.col("c_mktsegment").alias("split")).agg(F.count(F.lit(1)).alias("clips"), F.countDistinct("c_nationkey").alias("speakers"), F.round(F.sum("c_acctbal"), 2).alias("hours"))


@query(f"WITH {SPRT_SQL} SELECT verdict, count(*) AS calls, round(avg(k), 6) AS mean_k FROM (SELECT clip, min(k) AS k, arg_min(verdict, k) AS verdict FROM sp WHERE verdict <> 'pending' GROUP BY clip) GROUP BY verdict")
def time_to_verdict(spark, d):
    t = decisions.sprt(calls(spark, d), "llr").where("verdict <> 'pending'").groupBy("clip").agg(F.min("k").alias("k"), F.min_by("verdict", "k").alias("verdict"))
    return t.groupBy("verdict").agg(F.count(F.lit(1)).alias("calls"), r6(F.avg("k")).alias("mean_k"))


# kernels beyond SQL


def _frames_of_embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("clip"), F.col("embedding").alias("samples"), "label")


@query()
def lfcc_stats(spark, d):
    return signal.lfcc_features(_frames_of_embeddings(spark, d), 16, 8000).select("clip", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query()
def lpc_residual_order10(spark, d):
    return signal.residual(_frames_of_embeddings(spark, d), 32, 10).select("clip", F.transform("residual", lambda x: F.round(x, 6)).alias("residual"))


@query()
def next_bit_checks(spark, d):
    from ..operators import predictors

    # clips of five suppliers: long enough for 200 test symbols in every check
    order = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.floor(F.col("l_suppkey") / 5).alias("g"), *order)
    long = S.indexed(t, "g", order).select("clip", "i", F.col("l_extendedprice").alias("x"))
    return predictors.checks(S.binarised(long, "x", 160), "bit", seed=42)


@query()
def jitter_rho(spark, d):
    from ..operators import predictors
    import numpy as np
    import pandas as pd

    t = signal.jitter(events(spark, d), "x").groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda r: r["d"]).alias("d"))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                yield pd.DataFrame({"clip": part["clip"], "rho": predictors.rhos([np.asarray(x, np.float64) for x in part["d"]], 4, 42)}).astype({"rho": float})

    return predictors.dealt(t, "clip").mapInPandas(run, "clip long, rho double")


@query()
def calibrator_llr(spark, d):
    t = scored(spark, d).select("y", (F.log1p("s") / 10).alias("s1"), (F.length("source") / 5).alias("s2"))
    return decisions.calibrated(t, ["s1", "s2"], decisions.fit_calibrator(t, ["s1", "s2"], "y")).select("y", "s1", "s2", r6("llr").alias("llr"))


@query(f"""
WITH {SCORED_SQL}, r AS (SELECT round(avg(CAST((y = 1) = (s > 1000) AS INTEGER)), 4) AS accuracy, round(avg(CAST(s > 1000 AS INTEGER)) FILTER (y = 0), 4) AS false_alarm_rate, round(avg(CAST(s > 1000 AS INTEGER)) FILTER (y = 1), 4) AS detection_rate FROM q)
SELECT '{{"accuracy":' || accuracy || ',"false_alarm_rate":' || false_alarm_rate || ',"detection_rate":' || detection_rate || '}}' AS passport FROM r
""")
def passport_json(spark, d):
    return decisions.passport(decisions.confusion(scored(spark, d), F.col("y") == 1, F.col("s") > 1000))
