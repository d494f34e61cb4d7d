"""What lets queries grow: networks trained side by side, sequences in rows of their own, sums a speaker."""

import numpy as np
import pytest

from seqloom.operators import predictors


@pytest.mark.parametrize("hidden, classify, told", [(8, True, 1), (4, False, 1), (6, False, 6), ((16, 8), False, 1)])
def test_networks_side_by_side_are_those_one_by_one(hidden, classify, told):
    rng = np.random.default_rng(5)
    data = []
    for n in (11, 200, 450, 37, 451, 50):
        x = rng.integers(0, 2, (n, 8))
        y = rng.integers(0, 2, (n, told)) if told > 1 else ((x[:, 0] ^ (rng.random(n) < 0.2)) if n != 37 else x[:, 1])
        data.append((x, y))
    together = predictors.fit_all(data, hidden, classify, 42, epochs=60)
    for (x, y), net in zip(data, together, strict=True):
        alone = predictors.Network(hidden, classify, 42, epochs=60).fit(x.astype(float), y)
        assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(alone.weights, net.weights, strict=True))
    assert predictors.fit_all([], hidden, classify, 42) == []


@pytest.mark.parametrize("query", ["middle_statistics", "block_statistics"])
def test_windows_of_a_sequence_are_not_rows(spark, query):
    """Neither sorted nor shuffled nor stored one by one: a plan that explodes them grows with every width and direction."""
    from seqloom.plans.registry import QUERIES

    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.split("MapInPandas")[0] and "MapInPandas" in plan


def test_edges_below(spark):
    from pyspark.sql import functions as F

    from seqloom.operators import decisions

    for edges in ([], [0.5], [float(k) for k in range(0, 510, 2)], [float(k) for k in range(16)]):
        one = lambda some: F.array(*map(F.lit, some)).cast("array<double>")
        got = spark.range(-2, 520).select(F.col("id").cast("double").alias("x")).select("x", decisions.edges_below(one(edges), one(edges[15::16]), F.col("x")).alias("n")).collect()
        assert all(r["n"] == sum(e < r["x"] for e in edges) for r in got)


def test_a_keys_scores_are_not_dealt_by_key(spark):
    from seqloom.operators import decisions

    rows = spark.createDataFrame([(f"c{i % 2}", float(i % 37), i % 2) for i in range(200)], "channel string, s double, y int")
    plan = decisions.rates_by_key(rows, ["channel"], "s", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_networks_of_many_sequences_are_each_ones_own():
    from seqloom.operators import reports

    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 2, n) for n in (9, 120, 400, 300)] + [np.zeros(200, np.int64)]
    for d in ("fwd", "bwd"):
        assert reports.middle_accuracies(sequences, 8, d, 42) == [reports.middle_accuracies([x], 8, d, 42)[0] for x in sequences]
    alone = [reports.block_models([x], 8, 42)[0] for x in sequences]
    for a, b in zip(alone, reports.block_models(sequences, 8, 42), strict=True):
        assert all(np.allclose(x, y, rtol=0, atol=1e-9) for x, y in zip(a[0].weights, b[0].weights, strict=True))
    series = [rng.normal(size=n) for n in (5, 30, 90)]
    assert predictors.rhos(series, 4, 42) == pytest.approx([predictors.rho(x, 4, 42) for x in series])


@pytest.mark.parametrize("burst", [None, 0.4])
def test_a_clip_stays_a_row_in_the_channel(spark, burst):
    """The samples, frame by frame, are those of the operators over long tables, and none of them is shuffled."""
    from pyspark.sql import functions as F

    from seqloom.functions import g711
    from seqloom.operators import channel
    from seqloom.operators import sequences as S

    rng = np.random.default_rng(4)
    clips = spark.createDataFrame([(c, 16000, rng.normal(0, 0.2, n).tolist()) for c, n in ((1, 5000), (2, 330), (3, 12345), (4, 0))], "clip long, sr int, samples array<double>")
    out, rate = channel.simulated(clips, "g711a", 16000, loss_pct=40.0, snr_db=15.0, burst=burst)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    long = channel.noisy(channel.prepared(clips, 8000, 42), "x", "noise", 15.0, 160).select("clip", "i", g711.round_trip(F.col("y"), "alaw").alias("x"))
    long = S.framed(long, 160)
    frames = long.select("clip", "frame").distinct()
    lost = channel.bernoulli_loss(frames, 40.0, 42) if burst is None else channel.bursty_loss(frames, 40.0, burst, 42)
    want = {(r["clip"], r["i"]): (r["lost"], r["y"]) for r in channel.concealed(long.join(lost, ["clip", "frame"]), "x", 160).collect()}
    got = {(r["clip"], r["i"]): (r["lost"], r["y"]) for r in out.collect()}
    assert got.keys() == want.keys() and {v[0] for v in got.values()} == {0, 1}
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(max(-1, min(1, want[k][1])), abs=1e-9) for k in got)


def test_a_report_reads_its_sequences_once(spark):
    """All its parts are those of the single operators, of short sequences too, and the sequences are scanned and sorted once."""
    from pyspark.sql import functions as F

    from seqloom.operators import reports
    from seqloom.plans.registry import QUERIES

    plan = QUERIES["legacy_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("MapInPandas") == 1 and "Join" not in plan
    rng = np.random.default_rng(8)
    sizes = {1: 1, 2: 9, 3: 17, 4: 40, 5: 64, 6: 65, 7: 90, 8: 700}
    seq = spark.createDataFrame([(c, i, int(b)) for c, n in sizes.items() for i, b in enumerate(rng.integers(0, 2, n))], "clip long, i long, bit int").localCheckpoint()
    got = {r["clip"]: r for r in reports.full_report(seq, "bit", windows=(8, 16)).collect()}
    assert {c: r["n"] for c, r in got.items()} == sizes
    places = reports.drawn_places(seq)
    nets = reports.network_details(seq, "bit", places.select("clip", "place"), (8, 16)).localCheckpoint()
    blocks = reports.block_statistics(seq, "bit", places, (8, 16)).withColumn("one", F.lit(1))
    want = {
        ("bitwise", "network"): (reports.weighted(nets.where("kind = 'bit'"), "n", "accuracy"), ("accuracy", "total")),
        ("bitwise", "counts"): (reports.weighted(reports.middle_statistics(seq, "bit", (8, 16)), "tests", "chi2", "p"), ("chi2", "p", "total")),
        ("block", "network"): (reports.weighted(nets.where("kind = 'block'"), "n", "accuracy"), ("accuracy", "total")),
        ("block", "counts"): (reports.weighted(blocks, "one", "chi2", "p"), ("chi2", "p", "total")),
    }
    for (kind, part), (rows, fields) in want.items():
        found = {r["clip"]: [r[f] for f in fields] for r in rows.collect()}
        own = {c: r["report"][kind][part] for c, r in got.items() if r["report"][kind][part] is not None}
        assert own.keys() == found.keys() and 0 < len(own) < len(sizes)
        for c, r in own.items():
            assert [r[f] for f in fields] == pytest.approx(found[c], abs=1e-12)
            assert r["strong"] == (r["accuracy"] <= 0.55 if part == "network" else r["p"] > 0.05)


def test_sessions_of_a_shard_share_a_state(spark, tmp_path):
    """Rows of odd sessions over several batches are those of a loop, and there are no more states than shards."""
    import math

    from seqloom.streaming.verdicts import streaming_sprt

    rng = np.random.default_rng(6)
    far = 2**53 + 1
    rows = [(c, i, float(rng.normal(0.3, 1.5))) for c in [*range(60), None, far, far + 1] for i in range(int(rng.integers(1, 25)))]
    rows += [(0, 2**60 + 1, 0.5), (1, None, 0.5), (2, 30, None), (2, 31, 9.0)]
    batches = [[r for r in rows if (30 if r[1] is None else r[1]) // 7 % 4 == k] for k in range(4)]
    batches = sorted(batches, key=lambda b: min(30 if r[1] is None else r[1] for r in b))
    want, state = [], {}
    for batch in batches:
        for c, i, llr in sorted(batch, key=lambda r: math.inf if r[1] is None else r[1]):
            k, total, verdict = state.get(c, (0, 0.0, "pending"))
            k += 1
            if verdict == "pending":
                total += math.nan if llr is None else llr
                verdict = "suspicious" if total >= math.log(95) else "normal" if total <= math.log(0.05 / 0.99) else "undecided" if k >= 8 else "pending"
            state[c] = k, total, verdict
            want.append((c, i, k, None if math.isnan(total) else total, verdict))
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "clip long, i long, llr double"
    q = streaming_sprt(spark.readStream.schema(schema).parquet(str(folder)), idle_ms=None, shards=5).writeStream.format("memory").queryName("shards").start()
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
    states = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(spark.table("shards").collect()) == key(want) and states <= 5 < len(state)


def test_an_idle_session_of_a_shard_is_forgotten(spark, tmp_path):
    import time

    from seqloom.streaming.verdicts import streaming_sprt

    folder = tmp_path / "in"
    folder.mkdir()
    schema = "clip long, i long, llr double"
    q = streaming_sprt(spark.readStream.schema(schema).parquet(str(folder)), idle_ms=6000, shards=1).writeStream.format("memory").queryName("idle").start()

    def sent(rows, many):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        end = time.time() + 60
        while spark.table("idle").count() < many and time.time() < end:
            time.sleep(0.2)

    sent([(1, 0, 0.1), (2, 0, 0.1)], 2)
    for k in range(1, 5):  # 1 is busy, 2 is not
        time.sleep(2)
        sent([(1, k, 0.1)], 2 + k)
    sent([(1, 5, 0.1), (2, 5, 0.1)], 8)
    q.stop()
    got = {(r["clip"], r["i"]): r["k"] for r in spark.table("idle").collect()}
    assert got == {**{(1, k): k + 1 for k in range(6)}, (2, 0): 1, (2, 5): 1}


def test_cepstral_features_take_one_pass(spark):
    """The long table is scanned once and joined with nothing; clips of few frames and of many batches give what a loop gives."""
    from seqloom.operators import cepstra
    from seqloom.plans.registry import QUERIES

    plan = QUERIES["clip_cepstra"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and plan.count("Window") == 1
    rng = np.random.default_rng(2)
    clips = {str(n): rng.normal(size=(n, 3)) for n in (1, 2, 3, 4, 5, 9, 40, 12_345)}
    clips["12345"][:, 2] = 0.1
    rows = spark.createDataFrame([(c, f, v) for c, x in clips.items() for f, v in enumerate(x.tolist())], "clip string, frame long, c array<double>").repartition(3)
    got = {}
    for r in cepstra.features(rows, kept=3).collect():
        got.setdefault(r["clip"], {})[r["frame"]] = r["features"]
    assert got.keys() == clips.keys()
    for c, x in clips.items():
        at = lambda v, k: v[np.clip(np.arange(len(v)) + k, 0, len(v) - 1)]
        slope = lambda v: sum(k * (at(v, k) - at(v, -k)) for k in (1, 2)) / 10  # noqa: E731, B023
        f = np.concatenate((x, slope(x), slope(slope(x))), axis=1)
        deviation = f.std(axis=0)
        want = np.where(deviation > 1e-12, (f - f.mean(axis=0)) / np.where(deviation > 1e-12, deviation, 1), 0)
        assert len(got[c]) == len(x) and np.allclose([got[c][k] for k in range(len(x))], want, atol=1e-9)


def test_rows_of_a_chunk_may_come_in_several_batches(spark):
    from seqloom.operators import chunks

    seq = spark.createDataFrame([(c, i, float(i + c)) for c, n in ((1, 25_000), (2, 7), (3, 10_001)) for i in range(n)], "clip long, i long, x double").repartition(5)
    kernel = lambda samples, start, n, end: {"start": [start], "n": [n], "end": [end], "sum": np.array([samples.sum()]), "size": [len(samples)]}
    got = {(r["clip"], r["start"]): tuple(r)[2:] for r in chunks.chunked(seq, "x", 10_000, 3, 5, kernel, "start long, n long, end long, sum double, size int").collect()}
    want = {}
    for c, n in ((1, 25_000), (2, 7), (3, 10_001)):
        for start in range(0, n, 10_000):
            own = min(10_000, n - start)
            end = min(n, start + own + 5)
            want[c, start] = own, end, float(sum(i + c for i in range(max(0, start - 3), end))), own + 8
    assert got == want


class Counted:
    """A generator that counts the orders drawn from all of its kind."""

    orders = 0

    def __init__(self, rng):
        self.rng = rng

    def uniform(self, *args):
        return self.rng.uniform(*args)

    def permutation(self, n):
        Counted.orders += 1
        return self.rng.permutation(n)


@pytest.mark.parametrize("hidden, classify", [(8, True), (4, False), ((16, 8), True), ((16, 8), False)])
def test_networks_of_equally_many_rows_draw_their_orders_once(monkeypatch, hidden, classify):
    rng = np.random.default_rng(6)
    data = []
    for n in (300, 230, 300, 230, 300, 41):
        x = rng.integers(0, 2, (n, 8)).astype(np.int8)
        data.append((x, (x[:, 0] ^ (rng.random(n) < 0.1 * len(data))).astype(np.int8)))
    data += [(x[:, ::-1], y) for x, y in data]
    alone = [predictors.Network(hidden, classify, 42, epochs=40, rate=0.02).fit(x.astype(float), y) for x, y in data]
    made = np.random.default_rng
    monkeypatch.setattr(predictors.np.random, "default_rng", lambda seed: Counted(made(seed)))
    monkeypatch.setattr(Counted, "orders", 0)
    together = predictors.fit_all(data, hidden, classify, 42, epochs=40, rate=0.02)
    assert Counted.orders <= 3 * 40
    for one, net in zip(alone, together, strict=True):
        assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(one.weights, net.weights, strict=True))


def test_networks_of_checks_are_in_single_precision_as_the_references():
    rng = np.random.default_rng(7)
    data = [((x := rng.integers(0, 2, (n, 16)).astype(np.int8)), x[:, 3] ^ x[:, 5]) for n in (250, 410, 250)]
    for classify in (True, False):
        double, single = (predictors.fit_all(data, 16, classify, 42, dtype=t, epochs=20) for t in (np.float64, np.float32))
        for a, b in zip(double, single, strict=True):
            assert all(q.dtype == np.float32 and np.allclose(p, q, rtol=0, atol=1e-3) for p, q in zip(a.weights, b.weights, strict=True))


def test_bits_to_train_on_are_kept_as_bytes():
    import tracemalloc

    bits = np.random.default_rng(8).integers(0, 2, 60_032)
    _, (x, y), _ = predictors._bit_task(bits, 32, 42)
    tracemalloc.start()
    predictors.fit_all([(x, y)] * 2, 32, True, 42, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 2 * x.shape[0] * x.shape[1]  # bytes a bit; as doubles they alone are eight
