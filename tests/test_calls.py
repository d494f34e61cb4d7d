"""Calls and measures by channel against plain loops and the measures of one channel."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from seqloom.operators import calls, decisions, evaluation


def rows(spark):
    data = [(c, i, i % 2, ((i * 37) % 23) / 4 + (i % 2), float((i * 11) % 5)) for c in ("a", "b", None) for i in range(60 if c != "b" else 41)]
    data += [("one", i, 1, float(i), 1.0) for i in range(5)] + [("a", 99, None, 1.0, 1.0), ("a", 98, 1, None, None)]
    return spark.createDataFrame(data, "channel string, seg int, y int, s1 double, s2 double")


def loop(pairs):
    """auc, eer of (score, y)."""
    p, n = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    if not p or not n:
        return 0.5, 0.5
    auc = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    best = min((abs(sum(b >= t for b in n) / len(n) - sum(a < t for a in p) / len(p)), -t, sum(b >= t for b in n) / len(n), sum(a < t for a in p) / len(p)) for t, _ in pairs)
    return auc, (best[2] + best[3]) / 2


def test_rates_of_each_key_equal_those_of_a_loop(spark):
    t = rows(spark)
    for buckets in (2, 256):
        got = {r["channel"]: r for r in decisions.rates_by_key(t, ["channel"], "s1", "y", buckets).collect()}
        assert set(got) == {"a", "b", None, "one"}
        for c, r in got.items():
            pairs = [(x["s1"], x["y"]) for x in t.where(F.col("channel").eqNullSafe(F.lit(c))).collect() if x["s1"] is not None and x["y"] is not None]
            auc, eer = loop(pairs)
            assert r["n"] == len(pairs) and r["auc"] == pytest.approx(auc) and r["eer"] == pytest.approx(eer)
    assert decisions.rates_by_key(t.limit(0), ["channel"], "s1", "y").count() == 0


def test_stage0_equals_the_measures_channel_by_channel(spark):
    t = rows(spark).where("channel IS NOT NULL AND y IS NOT NULL AND s1 IS NOT NULL")
    got = {r["channel"]: r for r in evaluation.stage0(t, t, ["a", "b", "one", "none"]).collect()}
    for c in ("a", "b"):
        own = t.where(F.col("channel") == c)
        assert tuple(evaluation.metrics(own, "s1").first()) == pytest.approx((got[c]["d1_auc"], got[c]["d1_eer"]))
        assert tuple(evaluation.fusion_metrics(own, own).first()) == pytest.approx((got[c]["fusion_auc"], got[c]["fusion_eer"]))
    assert got["one"]["fusion_auc"] == got["one"]["d1_auc"] == got["none"]["d2_eer"] == 0.5 and got["none"]["n_test"] == 0 and got["one"]["n_test"] == 5


def test_trimming(spark):
    data = {1: [0.0, 0.001, 0.5, 0.001, -0.2, 0.0], 2: [0.001] * 9, 3: [0.0, 0.9, 0.0], 4: [0.02, 0.0, 0.0, 0.02], 5: []}
    t = spark.createDataFrame([(c, i, x) for c, v in data.items() for i, x in enumerate(v)], "clip int, i int, x double")
    got = {}
    for r in calls.trimmed(t, "x", rate=1, least_s=3.0).orderBy("clip", "i").collect():
        got.setdefault(r["clip"], []).append((r["i"], r["x"]))
    top = 10 ** (-1 / 20)
    assert set(got) == {1, 4}
    assert [i for i, _ in got[1]] == [0, 1, 2] and [x for _, x in got[1]] == pytest.approx([top, 0.002 * top, -0.4 * top])
    assert [x for _, x in got[4]] == pytest.approx([top, 0, 0, top])


def test_long_windows_keep_all_rows_and_count_from_zero(spark):
    t = spark.range(23).select(F.lit(7).alias("clip"), "id", F.floor(F.col("id") / 2).alias("second")).withColumnRenamed("id", "i").withColumn("bit", F.col("i") % 2)
    got = sorted((r["clip"]["win"], r["i"], r["bit"]) for r in calls.long_windows(t, 5).collect())
    assert got == [(i // 10, i % 10, i % 2) for i in range(23)]


def test_bound_of_the_checks_that_ran(spark):
    t = spark.createDataFrame([("x", 0.2, 100), ("x", None, 100), ("x", 0.01, 400), ("y", None, 50), ("z", 0.13, 100)], "k string, delta double, n_test long")
    got = {r["k"]: r for r in calls.executed_threshold(t, ["k"], alpha=0.01).collect()}
    z = [NormalDist().inv_cdf(1 - 0.01 / (2 * m)) for m in (1, 2)]
    assert got["x"]["z"] == pytest.approx(z[1]) and got["x"]["n_strong"] == 1 and got["x"]["suspicious"]
    assert got["y"]["z"] is None and got["y"]["n_checks"] == 0 and not got["y"]["suspicious"]
    assert got["z"]["z"] == pytest.approx(z[0]) and got["z"]["suspicious"] == (0.13 * 20 >= z[0])
    with pytest.raises(Exception, match="more checks"):
        calls.executed_threshold(t, ["k"], most=1).collect()


def test_priors_and_logs(spark):
    t = spark.createDataFrame([("a", i, 2.0) for i in range(4)] + [("b", 0, -0.5)], "clip string, i int, llr double")
    got = {r["clip"]: r for r in decisions.call_log(decisions.sprt(decisions.with_prior(t, "llr", -1.0), "llr")).collect()}
    upper = math.log(0.95 / 0.01)
    k = next(k for k in range(1, 9) if 2 * k - 1 >= upper)
    assert (got["a"]["verdict"], got["a"]["seconds"], got["a"]["lambda"]) == ("suspicious", k, 2 * k - 1)
    assert (got["b"]["verdict"], got["b"]["seconds"], got["b"]["lambda"]) == ("undecided", 1, -1.5)
    assert spark.range(1).select(calls.without_prior(F.lit(1.0), F.lit(30), F.lit(10))).first()[0] == pytest.approx(1 - math.log(3))
