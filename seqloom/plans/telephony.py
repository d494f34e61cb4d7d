"""Queries of what a call goes through: trimming, long windows, priors, the bound of the checks that ran, call logs, and
measures by channel. Samples are values of `events`, bits are of `lineitem`, calls are of `orders`."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import decisions, evaluation, randomness
from .catalogue import B_SQL, E_SQL, LOWER, M_SQL, SPRT_SQL, UPPER, bits, calls, events, manifest_rows, query, r6
from .extended import DELTAS_SQL, _scores, deltas, deltas_sql
from .significance import SC_SQL

PRIOR = math.log(0.2 / 0.8)
BOUNDS = [NormalDist().inv_cdf(1 - 0.01 / (2 * m)) for m in range(1, 9)]


@query(f"""
WITH {E_SQL}, v AS (SELECT clip, i, (x - 250) / 250 AS x FROM e),
g AS (SELECT clip, min(i) FILTER (abs(x) >= pow(10, -0.3)) AS a, max(i) FILTER (abs(x) >= pow(10, -0.3)) AS z, max(abs(x)) AS top FROM v GROUP BY clip)
SELECT clip, i - a AS i, round(x / top * pow(10, -0.05), 6) AS x FROM v JOIN g USING (clip) WHERE i BETWEEN a AND z AND z - a + 1 >= 20
""")
def trimmed_calls(spark, d):
    """Edges below -6 dB cut off, calls below two seconds (of ten samples) dropped, peaks at -1 dB."""
    t = events(spark, d).select("clip", "i", ((F.col("x") - 250) / 250).alias("x"))
    return C.trimmed(t, "x", 10, gate_db=-6.0).select("clip", "i", r6("x").alias("x"))


@query(f"""
WITH {B_SQL.replace(", b AS", ", b0 AS")}, b AS (SELECT {{'clip': clip, 'win': i // 400}} AS clip, i % 400 AS i, bit FROM b0), {deltas_sql(4)}
SELECT clip.clip AS clip, clip.win AS win, n_test, round(delta, 6) AS delta FROM dl4
""")
def long_window_deltas(spark, d):
    """The counting predictor in windows of five seconds (of 80 bits)."""
    t = C.long_windows(bits(spark, d).withColumn("second", F.floor(F.col("i") / 80)), 5)
    return randomness.counted_predictors(t, "bit", (4,)).select("clip.clip", "clip.win", "n_test", r6("delta").alias("delta"))


@query(f"""
WITH {SC_SQL}, m AS (SELECT channel, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM sc GROUP BY channel)
SELECT clip, seg, round(1.5 * s1 - 0.5 * s2 + 0.1 - ln(p / n), 6) AS llr FROM sc JOIN m USING (channel)
""")
def prior_free_ratios(spark, d):
    """Log odds less those of the channel's own classes."""
    t = _scores(spark, d)
    per = t.groupBy("channel").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    return t.join(per, "channel").select("clip", "seg", r6(C.without_prior(1.5 * F.col("s1") - 0.5 * F.col("s2") + 0.1, F.col("p"), F.col("n"))).alias("llr"))


PRIOR_SQL = SPRT_SQL.replace("ROWS UNBOUNDED PRECEDING) AS c", f"ROWS UNBOUNDED PRECEDING) + {PRIOR!r} AS c")


@query(f'WITH {PRIOR_SQL} SELECT clip, CAST(k AS BIGINT) AS k, round("lambda", 9) AS "lambda", verdict FROM sp')
def prior_verdicts(spark, d):
    """The sequential test from the prior log odds of one spoof in five."""
    t = decisions.sprt(decisions.with_prior(calls(spark, d), "llr", PRIOR), "llr")
    return t.select("clip", F.col("k").cast("long").alias("k"), F.round("lambda", 9).alias("lambda"), "verdict")


@query(f"""
WITH {M_SQL}, n AS (SELECT speaker AS clip, label, row_number() OVER (PARTITION BY speaker, label ORDER BY c_custkey) AS k FROM m),
s AS (SELECT clip, label, count(*) AS n FROM n GROUP BY ALL)
SELECT clip, label, CASE WHEN n >= {math.ceil(UPPER / 2)} AND label = 'spoof' THEN 'suspicious' WHEN n >= {math.ceil(-LOWER / 2)} AND label <> 'spoof' THEN 'normal' ELSE 'undecided' END AS verdict FROM s
""")
def stub_verdicts(spark, d):
    """Verdicts that the stub detector leads to, with one call a speaker and label."""
    rows = manifest_rows(spark, d).select(F.struct("speaker", "label").alias("clip"), F.col("c_custkey").alias("i"), C.stub_llr(F.col("label")).alias("llr"))
    return decisions.final_verdicts(decisions.sprt(rows, "llr")).select(F.col("clip.speaker").alias("clip"), F.col("clip.label").alias("label"), "verdict")


@query(f"""
WITH {B_SQL}, {DELTAS_SQL}, r AS (SELECT clip, n_test, CASE WHEN (clip + w) % 5 > 0 THEN delta END AS delta FROM dl),
g AS (SELECT clip, count(delta) AS n_checks, CASE WHEN count(delta) > 0 THEN ({BOUNDS})[count(delta)]::DOUBLE END AS z FROM r GROUP BY clip),
f AS (SELECT clip, n_checks, z, count(*) FILTER (abs(delta) * 2 * sqrt(n_test) >= z) AS n_strong FROM r JOIN g USING (clip) GROUP BY ALL)
SELECT clip, n_checks, round(z, 6) AS z, CAST(n_strong AS INTEGER) AS n_strong, n_strong > 0 AS suspicious FROM f
""")
def executed_checks(spark, d):
    """The bound by the number of checks that ran; some did not."""
    t = deltas(spark, d).withColumn("delta", F.when(F.pmod(F.col("clip") + F.col("w"), F.lit(5)) > 0, F.col("delta")))
    return C.executed_threshold(t, ["clip"], most=8).withColumn("z", r6("z"))


@query(f"""
WITH {SPRT_SQL}, f AS (SELECT clip, coalesce(min(k) FILTER (verdict <> 'pending'), max(k)) AS k FROM sp GROUP BY clip)
SELECT clip, CASE WHEN verdict = 'pending' THEN 'undecided' ELSE verdict END AS verdict, CAST(k AS BIGINT) AS seconds, round("lambda", 9) AS "lambda" FROM sp JOIN f USING (clip, k)
""")
def call_log(spark, d):
    """One row a call: its verdict, the seconds of speech it took, and the sum it ended at."""
    return decisions.call_log(decisions.sprt(calls(spark, d), "llr")).withColumn("lambda", F.round("lambda", 9))


@query(f"""
WITH {SC_SQL}, q AS (SELECT channel, 's1' AS score, s1 AS v, y FROM sc UNION ALL SELECT channel, 's2', s2, y FROM sc UNION ALL SELECT channel, 'level', floor(2 * s2), y FROM sc),
g AS (SELECT channel, score, v, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM q GROUP BY ALL),
h AS (SELECT *, sum(p) OVER k AS np, sum(n) OVER k AS nn, coalesce(sum(p) OVER z, 0) AS fn, coalesce(sum(n) OVER z, 0) AS tn FROM g
  WINDOW k AS (PARTITION BY channel, score), z AS (PARTITION BY channel, score ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (nn - tn) / nn AS fpr, fn / np AS fnr FROM h),
rt AS (SELECT channel, score, CAST(sum(p + n) AS BIGINT) AS n, sum(p * (tn + n / 2)) / any_value(np * nn) AS auc, first((fpr + fnr) / 2 ORDER BY abs(fpr - fnr), v DESC) AS eer FROM r GROUP BY ALL)
SELECT channel, any_value(n) AS n_test, {", ".join(f"round(any_value({m}) FILTER (score = '{s}'), 6) AS {m}_{s}" for s in ("s1", "s2", "level") for m in ("auc", "eer"))} FROM rt GROUP BY channel
""")
def channel_metrics(spark, d):
    """Area under the curve and equal error rate of three scores, one with many ties, in each channel."""
    out = evaluation.channel_metrics(_scores(spark, d).withColumn("level", F.floor(2 * F.col("s2"))), ["s1", "s2", "level"])
    return out.select(*(r6(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))
