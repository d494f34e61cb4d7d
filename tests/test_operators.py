import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.operators import channel, decisions, predictors, randomness, signal
from seqloom.operators import sequences as S
from seqloom.sources import manifest, signals


def sequence(spark, values, name="x", clip=1):
    return spark.createDataFrame([(clip, i, v) for i, v in enumerate(values)], f"clip long, i long, {name} {'int' if name == 'bit' else 'double'}")


def test_concealment_follows_the_loop(spark):
    rng, n, frame = np.random.default_rng(3), 403, 16
    x, lost = rng.normal(size=n), rng.random(26) < 0.4
    lost[0] = True
    expected, last, k = x.copy(), None, 0
    for f in range(26):
        own = slice(f * frame, min(n, (f + 1) * frame))
        m = own.stop - own.start
        if not lost[f]:
            last, k = x[own], 0
            continue
        k += 1
        y = np.zeros(m) if last is None else np.pad(last, (0, frame - len(last)))[:m] * 10 ** (-6 * k / 20)
        if k == 1 and f:
            fade = min(16, frame // 4)
            for j in range(min(fade, m)):
                y[j] = (1 - j / (fade - 1)) * x[own.start - fade + j] + j / (fade - 1) * y[j]
        expected[own] = y
    t = S.framed(sequence(spark, x.tolist()), frame)
    t = t.join(spark.createDataFrame([(f, int(v)) for f, v in enumerate(lost)], "frame long, lost int"), "frame")
    got = channel.concealed(t, "x", frame).orderBy("i").toPandas()["y"].to_numpy()
    assert np.abs(got - expected).max() < 1e-12


def test_loss_rates(spark):
    frames = spark.range(5000).select((F.col("id") % 5).alias("clip"), F.floor(F.col("id") / 5).alias("frame"))
    for t in (channel.bernoulli_loss(frames, 10, 1), channel.bursty_loss(frames, 10, 0.3, 1)):
        share = t.agg(F.avg("lost")).first()[0]
        assert 0.05 < share < 0.2
    assert channel.bursty_loss(frames, 0, 0.3, 1).agg(F.sum("lost")).first()[0] == 0


def test_prediction(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(size=(50, 200))
    auto = np.stack([(r[:, : 200 - k] * r[:, k:]).sum(axis=1) for k in range(11)], axis=1)
    a = signal.durbin(auto)
    for i in range(50):
        matrix = auto[i][np.abs(np.subtract.outer(np.arange(10), np.arange(10)))]
        matrix[np.diag_indices(10)] *= 1 + 1e-9
        assert np.abs(a[i] - np.linalg.solve(matrix, auto[i, 1:])).max() < 1e-6
    x = np.zeros(8000)
    noise = rng.normal(size=8000)
    for i in range(2, 8000):
        x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + noise[i]
    clips = spark.createDataFrame([("a", x.tolist()), ("b", []), ("c", None)], "clip string, samples array<double>")
    e = {r["clip"]: np.array(r["residual"]) for r in signal.residual(clips, 160, 10).collect()}
    assert len(e["a"]) == 8000 and abs(np.corrcoef(e["a"][1:], e["a"][:-1])[0, 1]) < 0.06 and len(e["b"]) == len(e["c"]) == 0


def test_cepstra(spark):
    clips = spark.createDataFrame([("a", np.random.default_rng(0).normal(size=1600).tolist()), ("b", [])], "clip string, samples array<double>")
    got = {r["clip"]: r["features"] for r in signal.lfcc_features(clips, 160, 8000).collect()}
    assert len(got["a"]) == 40 and got["b"] == [0.0] * 40


def test_predictors(spark):
    rng = np.random.default_rng(0)
    bits = [0]
    for _ in range(2999):
        bits.append(bits[-1] if rng.random() < 0.8 else 1 - bits[-1])
    out = {(r["mode"], r["dir"]): r["delta"] for r in predictors.checks(sequence(spark, bits, "bit"), "bit", windows=(8,)).collect()}
    assert out["bit", "fwd"] > 0.2 and out["bit", "bwd"] > 0.2 and out["block", "fwd"] > 0.02
    fair = rng.integers(0, 2, 4000)
    assert abs(predictors.bit_delta(fair, 8, 1)[0]) < 0.06
    assert predictors.bit_delta(fair[:100], 8, 1)[0] is None
    d = np.zeros(2000)
    for i in range(1, 2000):
        d[i] = 0.8 * d[i - 1] + rng.normal()
    assert predictors.rho(d, 4, 1) > 0.4


def test_markov_of_short_and_biased_sequences(spark):
    t = sequence(spark, [1], "bit").unionByName(sequence(spark, [0, 1] * 500, "bit", 2))
    got = {r["clip"]: r["chi2"] for r in randomness.markov_chi2(randomness.markov_counts(t, "bit", 2)).collect()}
    assert got[1] == 0 and got[2] > 100


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from seqloom.streaming.verdicts import streaming_segments, streaming_sprt

    rng = np.random.default_rng(5)
    rows = pd.DataFrame([(c, i, float(rng.normal(0.2, 1.2)), bool(rng.random() < 0.8)) for c in range(20) for i in range(int(rng.integers(1, 20)))], columns=["clip", "i", "llr", "speech"])
    for part in range(3):
        spark.createDataFrame(rows[rows["i"] // 7 == part]).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 50).parquet(str(tmp_path / "in"))
    q = streaming_sprt(stream, idle_ms=None).writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda t: sorted((r["clip"], r["k"], round(r["lambda"], 9), r["verdict"]) for r in t.collect())
    assert key(spark.table("verdicts")) == key(decisions.sprt(batch, "llr"))
    q = streaming_segments(stream.withColumnRenamed("llr", "x"), quota=3, idle_ms=None).writeStream.format("memory").queryName("segments").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    expected = S.segments(batch.where("speech"), quota=3, least=1).groupBy("clip", "seg").agg(F.avg("llr").alias("mean"))
    assert sorted((r["clip"], r["seg"], round(r["mean"], 9)) for r in spark.table("segments").collect()) == sorted((r["clip"], r["seg"], round(r["mean"], 9)) for r in expected.collect())


def test_roc_against_brute_force(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 40, 600) / 4.0, rng.integers(0, 2, 600)
    t = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    expected = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert abs(decisions.auc(t, "s", "y").first()[0] - expected) < 1e-12
    points = [(abs((neg >= c).mean() - (pos < c).mean()), -c, ((neg >= c).mean() + (pos < c).mean()) / 2) for c in np.unique(s)]
    assert abs(decisions.eer(t, "s", "y").first()[0] - min(points)[2]) < 1e-12


def test_manifest(spark, tmp_path):
    t = spark.createDataFrame([(i, f"s{i % 7}", "live" if i % 3 else "spoof") for i in range(200)], "id long, speaker string, label string")
    capped = manifest.capped(t, "speaker", "label", ["id"], 5, 20)
    assert capped.groupBy("label").count().agg(F.max("count")).first()[0] == 20
    split = manifest.speaker_split(t, "speaker", F.xxhash64("speaker", F.lit(1)))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"calib": 2, "train": 2, "test": 3}
    manifest.save(t.withColumn("split", F.lit("test")), str(tmp_path / "m"))
    assert manifest.load(spark, str(tmp_path / "m"), "all", "live").count() == t.where("label = 'live'").count()
    work = manifest.work_list(t.select("id"), ["clean", "g711a"])
    assert manifest.outstanding(work, work.where("channel = 'clean'"), ["id", "channel"]).count() == 200
    with pytest.raises(ValueError):
        manifest.picked_channel([], F.col("id"), 1)


def test_sources(spark, tmp_path):
    import wave

    (tmp_path / "clips").mkdir()
    with wave.open(str(tmp_path / "clips" / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.array([[1000, 3000]] * 80, "<i2").tobytes())
    (tmp_path / "clips" / "b.wav").write_bytes(b"junk")
    got = {r["path"][-5:]: r for r in signals.wav_clips(spark, str(tmp_path / "clips")).collect()}
    assert got["a.wav"]["sr"] == 8000 and abs(got["a.wav"]["samples"][0] - 2000 / 32768) < 1e-6 and got["b.wav"]["samples"] is None
    t = spark.createDataFrame([("0110",), ("01x",), ("",)], "s string").select(signals.bit_string(F.col("s")).alias("b"))
    assert [r["b"] for r in t.collect()] == [[0, 1, 1, 0], None, []]
    for kind in ("urandom", "mt", "lfsr"):
        bits = signals.generated_bits(spark, kind, 2000, [1, 2])
        assert bits.count() == 4000 and 0.4 < bits.agg(F.avg("bit")).first()[0] < 0.6
    assert signals.vowel(spark, seconds=0.5).agg(F.max("x")).first()[0] > 0


def test_numbered_over_many_ranges(spark):
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), F.concat(F.lit("wide "), F.col("id")).alias("extra"))
    got = manifest.numbered(rows, ["k"], "at", per_task=5_000)
    assert got.count() == 200_000 and got.select("at").distinct().count() == 200_000
    ordered = got.select("k", "at").orderBy("k").collect()
    assert [r["at"] for r in ordered] == list(range(200_000))


def test_bursty_loss_is_the_two_state_chain(spark):
    frames = spark.range(3000).select((F.col("id") % 3).alias("clip"), F.floor(F.col("id") / 3).alias("frame"))
    for pct, stay in ((10.0, 0.3), (45.0, 0.9), (80.0, 0.5)):
        rows = channel.bursty_loss(frames, pct, stay, 5).withColumn("u", channel.uniform("clip", "frame", seed=5)).orderBy("clip", "frame").collect()
        share = pct / 100
        fail = min(1.0, share * stay / (1 - share))
        state, clip = None, None
        for r in rows:
            if r["clip"] != clip:
                clip, state = r["clip"], int(r["u"] < share)
            else:
                state = int(r["u"] >= stay) if state else int(r["u"] < fail)
            assert r["lost"] == state


def test_feedback_register_bit_by_bit():
    for seed in (1, 42, 2**31 + 5):
        state, expected = seed, []
        for _ in range(5000):
            new = 0
            for tap in signals.LFSR_TAPS:
                new ^= state >> tap
            expected.append(state & 1)
            state = ((state << 1) | (new & 1)) & 0xFFFFFFFF
        assert signals.feedback_register(seed, 5000).tolist() == expected
    assert len(signals.feedback_register(7, 0)) == 0 and len(signals.feedback_register(7, 1)) == 1


def test_windows_of_all_widths_equal_those_of_each(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, int(b)) for c, n in ((1, 90), (2, 3), (3, 1)) for i, b in enumerate(rng.integers(0, 2, n))]
    seq = spark.createDataFrame(rows, "clip long, i long, bit int")
    key = lambda r: (r["clip"], r["w"], r["i"], r["ctx"], r["y"])
    got = S.all_windows(seq, "bit", (1, 2, 5)).collect()
    want = [r for w in (1, 2, 5) for r in S.windows(seq, "bit", w).withColumn("w", F.lit(w)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    counts = randomness.all_markov_counts(seq, "bit", (1, 2)).collect()
    # every clip has every cell, those too short for a window one each
    assert len(counts) == 3 * (4 + 8) and all(r["o"] == 1 for r in counts if r["clip"] == 3)
    assert sum(r["o"] - 1 for r in counts if r["clip"] == 1) == 89 + 88
