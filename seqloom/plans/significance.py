"""Queries of the evaluation's statistics and of simulated calls. Segments are orders of customers, a class and two scores
of each; a speaker is a group of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import barriers
from ..operators import simulation, statistics
from .catalogue import query, r6
from .extended import _scores, erfc_sql

SC_SQL = """
o AS (SELECT o_custkey AS clip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seg, (o_totalprice - 250000) / 144000 AS llr FROM orders),
sc AS (SELECT clip, seg, y, llr + 0.8 * y AS s1, abs(llr) + 0.3 * y AS s2, 'c' || (clip % 2) AS channel, clip % 25 AS speaker, llr FROM (SELECT *, CAST((clip * 7919) % 101 < 50 AS INTEGER) AS y FROM o))"""
TESTS_SQL = f"""{SC_SQL},
v AS (SELECT channel, 's1' AS "check", s1 AS v, y FROM sc UNION ALL SELECT channel, 's2', s2, y FROM sc UNION ALL SELECT channel, 'product', s1 * s2, y FROM sc UNION ALL SELECT channel, 'level', floor(2 * s2), y FROM sc),
g AS (SELECT channel, "check", v, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM v GROUP BY ALL),
h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY channel, "check" ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
u AS (SELECT channel, "check", CAST(sum(p) AS BIGINT) AS n1, CAST(sum(n) AS BIGINT) AS n0, sum(p * (below + n / 2)) AS u, sum(pow(p + n, 3) - (p + n)) AS ties FROM h GROUP BY ALL),
z AS (SELECT *, (u - n1 * n0 / 2 - sign(u - n1 * n0 / 2) * 0.5) / sqrt(CAST(n1 AS DOUBLE) * n0 / 12 * (n1 + n0 + 1 - ties / (CAST(n1 + n0 AS DOUBLE) * (n1 + n0 - 1)))) AS z FROM u),
t AS (SELECT *, CASE WHEN z * z > 49 THEN 0 ELSE {erfc_sql("z * z")} END AS p FROM z),
hm AS (SELECT *, least(1, p * (count(*) OVER (PARTITION BY channel) - row_number() OVER (PARTITION BY channel ORDER BY p) + 1)) AS s FROM t)"""


def segments(spark, d):
    return _scores(spark, d).withColumn("speaker", F.col("clip") % 25)


def checked(spark, d):
    """channel, check, v, y: four checks of each segment, one of them with many ties."""
    return segments(spark, d).select("channel", "y", F.expr("stack(4, 's1', s1, 's2', s2, 'product', s1 * s2, 'level', CAST(floor(2 * s2) AS DOUBLE)) AS (check, v)"))


def tests_of(spark, d):
    return statistics.holm(statistics.rank_tests(checked(spark, d), ["channel", "check"], "v", "y"), ["channel"])


@query(f"""
WITH {TESTS_SQL} SELECT channel, "check", n1, n0, u, round(z, 6) AS z, round(p, 6) AS p, round(max(s) OVER (PARTITION BY channel ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM hm
""")
def rank_tests(spark, d):
    return tests_of(spark, d).select("channel", "check", "n1", "n0", "u", *(r6(c).alias(c) for c in ("z", "p", "p_holm")))


@query()
def auc_intervals(spark, d):
    """The area under the curve of both scores, with an interval over speakers."""
    t, out = segments(spark, d), None
    for name in ("s1", "s2"):
        one = statistics.auc_interval(t, name, "y", "speaker").withColumn("score", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("score", *(r6(c).alias(c) for c in ("auc", "low", "high")), "replicates")


PLACED_SQL = f"""{SC_SQL}, q AS (SELECT s1 AS a, s1 + 0.3 * s2 AS b, y FROM sc), c AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM q),
w AS (SELECT a, b, y, {', '.join(f'''CASE WHEN y = 1
  THEN (coalesce(sum(1 - y) OVER (ORDER BY {s} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - coalesce(sum(1 - y) OVER (PARTITION BY {s}), 0) / 2) / n0
  ELSE (coalesce(sum(y) OVER (ORDER BY {s} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - coalesce(sum(y) OVER (PARTITION BY {s}), 0) / 2) / n1 END AS p{s}''' for s in "ab")} FROM q, c),
s AS (SELECT y, count(*) AS n, avg(pa) AS ma, avg(pb) AS mb, (var_samp(pa) + var_samp(pb) - 2 * covar_samp(pa, pb)) / count(*) AS s FROM w GROUP BY y),
dl AS (SELECT max(ma) FILTER (y = 1) AS auc_a, max(mb) FILTER (y = 1) AS auc_b, sum(s) AS variance FROM s)"""


def fused(spark, d):
    return segments(spark, d).select("y", F.col("s1").alias("a"), (F.col("s1") + 0.3 * F.col("s2")).alias("b"))


@query(f"""
WITH {PLACED_SQL} SELECT round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_b - auc_a, 6) AS difference, round(variance, 9) AS variance, round((auc_b - auc_a) / sqrt(variance), 5) AS z,
 round(CASE WHEN pow(auc_b - auc_a, 2) / variance > 49 THEN 0 ELSE {erfc_sql("(pow(auc_b - auc_a, 2) / variance)")} END, 5) AS p FROM dl
""")
def delong_comparison(spark, d):
    out = statistics.delong(fused(spark, d), "a", "b", "y")
    return out.select(*(r6(c).alias(c) for c in ("auc_a", "auc_b", "difference")), F.round("variance", 9).alias("variance"), F.round("z", 5).alias("z"), F.round("p", 5).alias("p"))


def _threshold_sql(s: str) -> str:
    return f"""(SELECT arg_min(v, (gap, -v)) AS t FROM (SELECT v, abs(CAST(sum(n) OVER (ORDER BY v DESC) AS DOUBLE) / sum(n) OVER () - (1 - CAST(sum(p) OVER (ORDER BY v DESC) AS DOUBLE) / sum(p) OVER ())) AS gap
 FROM (SELECT {s} AS v, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY 1)))"""


@query(f"""
WITH {SC_SQL}, a AS {_threshold_sql("s1")}, b AS {_threshold_sql("s2")}
SELECT round(a.t, 6) AS threshold_a, round(b.t, 6) AS threshold_b, round(corr(CAST((s1 >= a.t) <> (y = 1) AS INTEGER), CAST((s2 >= b.t) <> (y = 1) AS INTEGER)), 6) AS correlation FROM sc, a, b GROUP BY a.t, b.t
""")
def error_correlation(spark, d):
    out = statistics.error_correlation(segments(spark, d), "s1", "s2", "y")
    return out.select(*(r6(c).alias(c) for c in ("threshold_a", "threshold_b", "correlation")))


@query(f"""
WITH {TESTS_SQL} SELECT channel, "check", round(stddev_samp(v), 6) AS sigma0, round({scalars.z_threshold(0.01, 4)!r} * stddev_samp(v) + {statistics.NormalDist().inv_cdf(0.8)!r} * stddev_samp(v), 6) AS least_shift
FROM v WHERE y = 0 GROUP BY ALL
""")
def sensitivities(spark, d):
    """The least shift of each check's mean that its tests would find."""
    live = checked(spark, d).where("y = 0").groupBy("channel", "check").agg(F.stddev_samp("v").alias("sigma0"))
    return live.select("channel", "check", r6("sigma0").alias("sigma0"), r6(statistics.least_shift(F.col("sigma0"), 0.01, 4)).alias("least_shift"))


@query()
def experiment_gate(spark, d):
    out = statistics.gate(tests_of(spark, d), statistics.auc_interval(segments(spark, d), "s1", "y", "speaker"), statistics.delong(fused(spark, d), "a", "b", "y"))
    return out.select(*(r6(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


UPPER, LOWER = barriers(0.01, 0.05)
CALLS_SQL = f"""{SC_SQL},
cl AS (SELECT speaker, y, row_number() OVER (PARTITION BY speaker, y ORDER BY clip, seg) - 1 AS pl, 0.9 * (s1 - 0.4) AS llr FROM sc),
r AS (SELECT speaker, y, pl // 30 AS n, row_number() OVER w AS k, sum(llr) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM cl WINDOW w AS (PARTITION BY speaker, y, pl // 30 ORDER BY pl))"""


def ended_sql(upper: str, keys: str) -> str:
    """Calls' verdicts under the barriers: the first row that crosses one, else the last."""
    return f"""(SELECT {keys}speaker, y, n, coalesce(arg_min(CASE WHEN c >= {upper} THEN 'suspicious' ELSE 'normal' END, k) FILTER (c >= {upper} OR c <= {LOWER!r}), 'undecided') AS verdict,
 coalesce(min(k) FILTER (c >= {upper} OR c <= {LOWER!r}), max(k)) AS seconds, coalesce(arg_min(c, k) FILTER (c >= {upper} OR c <= {LOWER!r}), arg_max(c, k)) AS lam FROM {{source}} GROUP BY ALL)"""


def rates_sql(keys: str) -> str:
    """rt: counts by keys and class; bd: the bound, by halving, of the binomial tail."""
    tail = "list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))))"
    return f"""rt AS (SELECT {keys}y, count(*) AS calls, count(*) FILTER (verdict = CASE WHEN y = 0 THEN 'suspicious' ELSE 'normal' END) AS errors, avg(CAST(verdict = 'undecided' AS INTEGER)) AS undecided,
 avg(seconds) FILTER (verdict <> 'undecided') AS mean_seconds, quantile_cont(seconds, 0.9) FILTER (verdict <> 'undecided') AS p90_seconds FROM en GROUP BY ALL),
bi AS (SELECT DISTINCT errors AS k, calls AS n, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS it FROM rt
 UNION ALL SELECT k, n, CASE WHEN {tail} > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {tail} > 0.05 THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM bi WHERE it < 50),
bd AS (SELECT k, n, CASE WHEN k >= n THEN 1 ELSE (lo + hi) / 2 END AS bound FROM bi WHERE it = 50)"""


def simulated_calls(spark, d):
    return simulation.joined_calls(segments(spark, d).select("clip", "seg", "speaker", "y", (0.9 * (F.col("s1") - 0.4)).alias("llr")))


@query(f"""
WITH RECURSIVE {CALLS_SQL}, en AS {ended_sql(repr(UPPER), "").format(source="r")}
SELECT speaker, CAST(y AS INTEGER) AS y, n, verdict, seconds, round(lam, 6) AS "lambda" FROM en
""")
def call_outcomes(spark, d):
    out = simulation.outcomes(simulated_calls(spark, d))
    return out.select("call.speaker", "y", "call.n", "verdict", "seconds", r6("lambda").alias("lambda"))


@query(f"""
WITH RECURSIVE {CALLS_SQL}, en AS {ended_sql(repr(UPPER), "").format(source="r")}, {rates_sql("")}
SELECT y, calls, errors, round(errors / calls, 6) AS rate, round(bound, 8) AS bound, round(undecided, 6) AS undecided, round(mean_seconds, 6) AS mean_seconds, round(p90_seconds, 6) AS p90_seconds FROM rt JOIN bd ON k = errors AND n = calls
""")
def call_error_rates(spark, d):
    out = simulation.error_rates(simulation.outcomes(simulated_calls(spark, d)))
    return out.select("y", "calls", "errors", r6("rate").alias("rate"), F.round("bound", 8).alias("bound"), *(r6(c).alias(c) for c in ("undecided", "mean_seconds", "p90_seconds")))


@query(f"""
WITH RECURSIVE {CALLS_SQL}, lv AS (SELECT CAST(j AS INTEGER) AS step, {UPPER!r} + 0.25 * j AS a FROM range(41) t(j)), rl AS (SELECT step, a, speaker, y, n, k, c FROM r, lv), en AS {ended_sql("a", "step, ").format(source="rl")}, {rates_sql("step, ")},
al AS (SELECT l.step, l.errors / l.calls AS rate, bound, s.errors / s.calls AS beta_hat, l.mean_seconds, s.mean_seconds AS spoof_seconds FROM rt l JOIN rt s ON l.step = s.step AND l.y = 0 AND s.y = 1 JOIN bd ON k = l.errors AND n = l.calls),
ch AS (SELECT coalesce(min(step) FILTER (bound <= 0.05), max(step)) AS step FROM al)
SELECT step, CAST(round({UPPER!r} + 0.25 * step, 6) AS DOUBLE) AS upper, CAST(round({LOWER!r}, 6) AS DOUBLE) AS lower, bound <= 0.05 AS met, round(rate, 6) AS alpha_hat, round(bound, 8) AS alpha_up, round(beta_hat, 6) AS beta_hat, round(mean_seconds, 6) AS seconds_live, round(spoof_seconds, 6) AS seconds_spoof
FROM al JOIN ch USING (step)
""")
def tuned_barrier(spark, d):
    out = simulation.tuned(simulated_calls(spark, d), 0.05)
    return out.select("step", r6("upper").alias("upper"), r6("lower").alias("lower"), "met", r6("alpha_hat").alias("alpha_hat"), F.round("alpha_up", 8).alias("alpha_up"), *(r6(c).alias(c) for c in ("beta_hat", "seconds_live", "seconds_spoof")))
