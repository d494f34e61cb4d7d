"""The evaluation's statistics and simulated calls, against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars
from seqloom.operators import simulation, statistics
from seqloom.plans import significance


def won(pos, neg):
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg)


def normal_p(z):
    return math.erfc(abs(z) / math.sqrt(2))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(k % 3, rng.randrange(2), float(rng.randrange(6)) if k % 2 else rng.gauss(0, 1), rng.gauss(0, 1), f"p{rng.randrange(9)}") for k in range(600)]
    rows += [(0, 1, None, 1.0, "p1"), (1, None, 1.0, None, "p2"), (7, 1, 1.0, 1.0, None), (8, 0, 2.0, 2.0, None), (8, 1, 2.0, 2.0, None)]
    return rows, spark.createDataFrame(rows, "g int, y int, v double, w double, speaker string").repartition(5)


def test_rank_tests_and_holm(scored):
    rows, df = scored
    got = {r["g"]: r for r in statistics.holm(statistics.rank_tests(df.withColumn("f", F.lit(1)), ["f", "g"], "v", "y"), ["f"]).collect()}
    tests = {}
    for g in (0, 1, 2):
        pos, neg = [r[2] for r in rows if r[0] == g and r[1] == 1 and r[2] is not None], [r[2] for r in rows if r[0] == g and r[1] == 0 and r[2] is not None]
        u, n = won(pos, neg), len(pos) + len(neg)
        same = defaultdict(int)
        for v in pos + neg:
            same[v] += 1
        spread = math.sqrt(len(pos) * len(neg) / 12 * (n + 1 - sum(t**3 - t for t in same.values()) / (n * (n - 1))))
        off = u - len(pos) * len(neg) / 2
        z = (off - math.copysign(min(0.5, abs(off)), off)) / spread
        assert got[g]["u"] == u and got[g]["z"] == pytest.approx(z) and got[g]["p"] == pytest.approx(normal_p(z))
        tests[g] = normal_p(z)
    top = 0.0
    for k, g in enumerate(sorted(tests, key=tests.get)):
        top = max(top, min(1.0, tests[g] * (3 - k)))
        assert got[g]["p_holm"] == pytest.approx(top)
    assert got[7]["p"] is None and got[8]["p"] is None and got[8]["p_holm"] is None  # one class; all values equal


@pytest.mark.parametrize("per_task", [10_000, 40])
def test_replicates_equal_a_loop(spark, scored, per_task):
    """Ranges cut through a score that a third of the rows share."""
    rows = [(y, float(v if k % 3 else 1), s) for k, (_, y, v, _, s) in enumerate(scored[0]) if y is not None and v is not None]
    df = spark.createDataFrame(rows, "y int, v double, speaker string").repartition(7)
    got = {r["r"]: r["auc"] for r in statistics.replicate_aucs(df, "v", "y", "speaker", 20, 5, per_task).collect()}
    hashes = {r["speaker"]: r["h"] for r in df.select("speaker", F.xxhash64("speaker").alias("h")).distinct().collect()}
    weight = {s: statistics.poisson_weights(np.array([h]), 20, 5)[0] for s, h in hashes.items()}
    for k in range(20):
        pos, neg = [(v, weight[s][k]) for y, v, s in rows if y == 1], [(v, weight[s][k]) for y, v, s in rows if y == 0]
        both = sum(w for _, w in pos) * sum(w for _, w in neg)
        assert got[k] == pytest.approx(sum(a * b * ((p > n) + (p == n) / 2) for p, a in pos for n, b in neg) / both)


def test_weights_are_poisson():
    w = statistics.poisson_weights(np.arange(400), 500, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


def test_intervals_and_delong_on_the_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["y"], r["s1"], r["s1"] + 0.3 * r["s2"]) for r in significance.segments(spark, d).collect()]
    pos, neg = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
    areas, places = [], []
    for k in (1, 2):
        v10 = [sum((p[k] > n[k]) + (p[k] == n[k]) / 2 for n in neg) / len(neg) for p in pos]
        v01 = [sum((p[k] > n[k]) + (p[k] == n[k]) / 2 for p in pos) / len(pos) for n in neg]
        areas.append(sum(v10) / len(pos))
        places.append((v10, v01))
    variance = sum(np.var(np.subtract(a, b), ddof=1) / len(a) for a, b in zip(*places, strict=True))
    got = statistics.delong(significance.fused(spark, d), "a", "b", "y").first()
    assert got["auc_a"] == pytest.approx(areas[0]) and got["auc_b"] == pytest.approx(areas[1]) and got["variance"] == pytest.approx(variance)
    assert got["p"] == pytest.approx(normal_p((areas[1] - areas[0]) / math.sqrt(variance)))
    interval = statistics.auc_interval(significance.segments(spark, d), "s1", "y", "speaker", 200).first()
    assert interval["low"] < interval["auc"] < interval["high"] and interval["auc"] == pytest.approx(areas[0])


def test_no_replicate_is_a_shuffle_of_its_own(spark, scored):
    plans = [statistics.replicate_aucs(scored[1], "v", "y", "speaker", n)._jdf.queryExecution().toString().count("Exchange") for n in (2, 200)]
    assert plans[0] == plans[1]


def binomial_tail(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_bounds_of_rates(spark):
    cases = [(0, 1), (0, 30), (1, 30), (15, 30), (29, 30), (30, 30), (0, 3000), (7, 200), (3, 10000), (0, 0)]
    got = [r["b"] for r in spark.createDataFrame(cases, "k int, n int").coalesce(1).select(scalars.rate_bound(F.col("k"), F.col("n")).alias("b")).collect()]
    for (k, n), b in zip(cases, got, strict=True):
        lo, hi = 0.0, 1.0
        for _ in range(100 if k < n else 0):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if binomial_tail(k, n, mid) > 0.05 else (lo, mid)
        assert abs(b - (lo + hi) / 2) < 1e-8 if k < n else b == 1
    assert abs(got[6] - 0.001) < 2e-5  # the rule of three


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(9)
    rows = [(f"s{s}", y, f"c{c:02d}", seg, rng.gauss(0.7 if y else -0.5, 1.5)) for s in range(4) for y in (0, 1) for c in range(12) for seg in range(rng.randrange(1, 20))]
    return rows, simulation.joined_calls(spark.createDataFrame(rows, "speaker string, y int, clip string, seg int, llr double").repartition(4))


def test_calls_join_clips_of_a_speaker_and_class(calls):
    rows, df = calls
    want = defaultdict(list)
    for s, y, _, _, v in sorted(rows):
        want[s, y].append(v)
    want = {(*k, n): v[30 * n : 30 * n + 30] for k, v in want.items() for n in range(-(-len(v) // 30))}
    got = defaultdict(dict)
    for r in df.collect():
        got[tuple(r["call"])][r["i"]] = r["llr"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want


def ended(values, upper, lower, most):
    total = 0.0
    for k, v in enumerate(values[:most], 1):
        total += v
        if total >= upper:
            return "suspicious", k
        if total <= lower:
            return "normal", k
    return "undecided", min(len(values), most)


def test_one_pass_equals_a_run_a_barrier(calls):
    own = defaultdict(dict)
    for r in calls[1].collect():
        own[tuple(r["call"])][r["i"]] = r["llr"]
    own = {k: [v[i] for i in range(len(v))] for k, v in own.items()}
    upper, lower = scalars.barriers(0.2, 0.1)
    levels = [upper + 0.25 * k for k in range(41)]
    for most in (30, 7):
        got = {(tuple(r["call"]), r["step"]): (r["verdict"], r["seconds"]) for r in simulation.first_passages(calls[1], levels, lower, most).collect()}
        assert got == {(c, k): ended(v, a, lower, most) for c, v in own.items() for k, a in enumerate(levels)}
    chosen = simulation.tuned(calls[1], 0.35, 0.2, 0.1).first()
    live = [v for k, v in own.items() if k[1] == 0]
    for k, a in enumerate(levels):
        wrong = sum(ended(v, a, lower, 30)[0] == "suspicious" for v in live)
        bound = next((p for p in (i / 10000 for i in range(10001)) if binomial_tail(wrong, len(live), p) <= 0.05), 1.0)
        if bound <= 0.35:
            break
    assert chosen["step"] == k and chosen["met"] == (bound <= 0.35) and chosen["alpha_hat"] == pytest.approx(wrong / len(live))
    for k, r in {tuple(r["call"]): r for r in simulation.outcomes(calls[1], 0.2, 0.1).collect()}.items():
        assert (r["verdict"], r["seconds"]) == ended(own[k], upper, lower, 30)


def test_gate_needs_all_three(spark):
    row = lambda **k: spark.createDataFrame([tuple(k.values())], ", ".join(f"{n} double" for n in k))
    for p, a, z, want in ((0.001, 0.8, 0.01, True), (0.02, 0.8, 0.01, False), (0.001, 0.7, 0.01, False), (0.001, 0.8, 0.2, False)):
        assert statistics.gate(row(p_holm=p), row(auc=a, low=0.6), row(difference=0.1, p=z)).first()["passed"] is want
