"""Prediction and pitch in chunks against whole clips, decoding against a test writer."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import cepstra, chunks, signal, splits
from seqloom.sources import signals

SR = 8000


def long(spark, clips):
    return spark.createDataFrame([(c, i, float(v)) for c, x in clips.items() for i, v in enumerate(x)], "clip string, i long, x double").repartition(5)


@pytest.mark.parametrize(("order", "frame", "per"), [(10, 160, 1), (10, 160, 3), (16, 320, 2), (16, 12, 2)])
def test_residual_in_chunks_is_that_of_the_clip(spark, order, frame, per):
    rng = np.random.default_rng(order)
    clips = {"a": rng.normal(size=2400).cumsum() * 0.01, "b": rng.normal(size=1607), "c": rng.normal(size=5), "d": np.zeros(700), "e": rng.normal(size=960)}
    got = {k: {} for k in clips}
    for r in chunks.residual(long(spark, clips), "x", frame, order, per).collect():
        got[r["clip"]][r["i"]] = (r["e"], r["bit"])
    for k, x in clips.items():
        e = signal.residual_of(x, frame, order)
        assert len(got[k]) == len(x)
        assert np.allclose([got[k][i][0] for i in range(len(x))], e, atol=1e-12)
        assert [got[k][i][1] for i in range(len(x))] == signal.bits_of(e, frame).tolist()


def test_symbols_of_voiced_and_unvoiced_frames(spark):
    x = voice(140.0, 1.0)
    x[3200:4800] = np.random.default_rng(1).normal(size=1600) * 0.1
    seq = long(spark, {"v": x})
    bits = signal.bits_of(signal.residual_of(x, 160, 10), 160)
    mask = {r["frame"]: r["voiced"] for r in signal.voiced_frames(seq, "x", 160, 13, 107).collect()}
    for which in ("all", "voiced", "unvoiced"):
        got = {r["i"]: r["bit"] for r in chunks.symbols(seq, "x", 160, 10, which, (13, 107), 7).collect()}
        want = np.concatenate([bits[f * 160 : f * 160 + 160] for f in range(50) if which == "all" or mask[f] == (which == "voiced")])
        assert [got[i] for i in range(len(got))] == want.tolist()
    assert 5 <= sum(not v for v in mask.values()) <= 15


def voice(f0, seconds, formant=500.0):
    """Pulses through a resonance above the pitch."""
    n, x = int(SR * seconds), np.zeros(int(SR * seconds))
    marks = np.round(np.arange(0, n, SR / f0)).astype(int)
    x[marks[marks < n]] = 1.0
    r = math.exp(-math.pi * 80 / SR)
    a1, a2, y = 2 * r * math.cos(2 * math.pi * formant / SR), -r * r, np.zeros(n)
    for i in range(n):
        y[i] = x[i] + a1 * (y[i - 1] if i else 0) + a2 * (y[i - 2] if i > 1 else 0)
    return y / np.abs(y).max() * 0.8


def test_pitch_of_vowels(spark):
    """Within 1 % and without octave errors, with a formant above the pitch; silence and noise have none."""
    rng = np.random.default_rng(0)
    clips = {f"{f0:g}/{g:g}": np.concatenate((voice(f0, 1.0, g), np.zeros(1600), rng.normal(size=1600) * 0.2)) for f0, g in ((140.0, 500.0), (140.0, 280.0), (125.0, 500.0), (210.0, 700.0), (95.0, 400.0))}
    seq = long(spark, clips)
    track = chunks.pitch_track(chunks.pitch_candidates(seq, "x", SR, 80, 400, hops_per_chunk=30)).cache()
    for k in clips:
        f0, rows = float(k.split("/")[0]), {r["frame"]: r["period"] for r in track.where(F.col("clip") == k).collect()}
        inside = [rows[f] for f in range(2, 94)]
        assert len(rows) == 140 and all(abs(SR / p / f0 - 1) < 0.01 for p in inside), (k, inside)
        assert all(rows[f] == 0 for f in range(102, 118)) and sum(rows[f] > 0 for f in range(122, 138)) <= 6
    periods = chunks.tracked_periods(seq, "x", track, 80).where("i < 7500").groupBy("clip").agg(F.avg("period").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    for r in periods:
        f0 = float(r["clip"].split("/")[0])
        assert abs(r["m"] - SR / f0) <= 1 and r["n"] > 0.8 * f0 * 0.9
    track.unpersist()


def test_path_equals_a_plain_program():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        periods = [sorted(rng.uniform(10, 100, int(rng.integers(0, 4))).tolist()) for _ in range(n)]
        strengths = [rng.uniform(0, 1, len(p)).tolist() for p in periods]

        def worth(path, periods=periods, strengths=strengths):
            total = 0.0
            for f, k in enumerate(path):
                total += strengths[f][k - 1] if k else 0.45
                if f and (k > 0) != (path[f - 1] > 0):
                    total -= 0.14
                if f and k and path[f - 1]:
                    total -= 0.35 * abs(math.log2(periods[f][k - 1] / periods[f - 1][path[f - 1] - 1]))
            return total

        paths = [[]]
        for p in periods:
            paths = [[*q, k] for q in paths for k in range(len(p) + 1)]
        best = max(map(worth, paths))
        got = chunks.best_path(periods, strengths, 0.45, 0.35, 0.14)
        assert worth([0 if not v else periods[f].index(v) + 1 for f, v in enumerate(got)]) == pytest.approx(best)


def wav(x, rate, width, kind=1, extra=b"", extensible=False, size=None):
    """x: [n, channels] in -1..1."""
    if kind == 3:
        body = x.astype(f"<f{width // 8}").tobytes()
    elif width == 8:
        body = np.clip(np.round(x * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    else:
        whole = np.clip(np.round(x * 2.0 ** (width - 1)), -(2 ** (width - 1)), 2 ** (width - 1) - 1).astype("<i8")
        body = whole.reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, : width // 8].tobytes()
    n = x.shape[1]
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, n, rate, rate * n * width // 8, n * width // 8, width)
    if extensible:
        fmt += struct.pack("<HHIH", 22, width, 0, kind) + bytes(14)
    parts = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(body) if size is None else size) + body
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def test_wav_files_come_back(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-0.99, 0.99, (501, 2))
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    files = {
        "8": (wav(x, 8000, 8), 1 / 128), "16": (wav(x, 16000, 16, extra=odd), 1 / 32768), "24": (wav(x, 44100, 24), 2.0**-22), "32": (wav(x[:, :1], 8000, 32), 1e-6), "f32": (wav(x, 8000, 32, 3), 1e-6),
        "f64": (wav(x, 8000, 64, 3), 1e-6), "extensible": (wav(x, 48000, 24, extensible=True), 2.0**-22), "unknown size": (wav(x, 8000, 16, size=0xFFFFFFFF), 1 / 32768),
    }
    bad = {"empty": b"", "null": None, "text": b"hello", "no data": wav(x, 8000, 16)[:36], "12 bit": wav(x, 8000, 16)[:34] + b"\x0c\0" + wav(x, 8000, 16)[36:], "law": wav(x, 8000, 8, kind=7), "large": wav(np.zeros((8000, 1)), 8000, 16)}
    t = spark.createDataFrame([(k, v if k in bad else v[0]) for k, v in (files | bad).items()], "path string, content binary")
    got = {r["path"]: r for r in signals.decoded(t, 12_000).collect()}
    assert got.keys() == files.keys() | bad.keys()
    for k, (_, off) in files.items():
        want = (x[:, :1] if k == "32" else x).mean(axis=1)
        assert got[k]["status"] == 200 and len(got[k]["samples"]) == 501 and np.abs(np.array(got[k]["samples"]) - want).max() <= 1.01 * off
    assert got["24"]["sr"] == 44100 and got["extensible"]["sr"] == 48000
    assert {k: got[k]["status"] for k in bad} == {k: 413 if k == "large" else 400 for k in bad} and all(got[k]["problem"] for k in bad)


def test_pcm_messages(spark):
    t = spark.createDataFrame([(1, b"\x00\x40\x00\xc0\x01"), (2, None), (3, b""), (4, b"\xff\x7f")], "k int, b binary").coalesce(1)
    got = {r["k"]: r["x"] for r in t.select("k", signals.pcm16("b").alias("x")).collect()}
    assert got[1] == [0.5, -0.5] and got[2] is None and got[3] == [] and abs(got[4][0] - 32767 / 32768) < 1e-7


def test_cepstra_of_overlapping_frames(spark):
    rng = np.random.default_rng(3)
    clips = {"a": rng.normal(size=SR // 2), "b": rng.normal(size=400), "c": rng.normal(size=100), "d": rng.normal(size=160)}
    seq = long(spark, clips)
    for per in (7, 500):
        got = {(r["clip"], r["frame"]): r["c"] for r in cepstra.cepstra(seq, "x", SR, hops_per_chunk=per).collect()}
        want = {}
        for k, x in clips.items():
            for f in range((len(x) - 160) // 80 + 1 if len(x) >= 160 else 0):
                power = np.abs(np.fft.rfft(x[f * 80 : f * 80 + 160] * np.hamming(160), 256)) ** 2
                edges = np.linspace(0, SR / 2, 22)
                bins = np.arange(129) * SR / 256
                logs = [math.log(sum(p * max(0.0, min((b - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - b) / (edges[m + 2] - edges[m + 1]))) for p, b in zip(power, bins, strict=True)) + 1e-8) for m in range(20)]
                want[k, f] = [math.sqrt((1 if q == 0 else 2) / 20) * sum(v * math.cos(math.pi * q * (2 * m + 1) / 40) for m, v in enumerate(logs)) for q in range(20)]
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    rows = cepstra.features(cepstra.cepstra(seq, "x", SR)).where("clip = 'a'").collect()
    x = np.array([r["features"] for r in sorted(rows, key=lambda r: r["frame"])])
    assert x.shape == (49, 60) and np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1)


def test_split_keeps_components_whole(spark):
    rng = np.random.default_rng(6)
    rows = [(k, f"v{rng.integers(60)}" if rng.random() < 0.7 else None, int(rng.integers(200)) if rng.random() < 0.5 else None, bool(rng.random() < 0.03)) for k in range(300)]
    rows += [(300 + k, f"chain{k // 2}", 1000 + (k + 1) // 2, False) for k in range(60)]  # one long chain
    t = spark.createDataFrame(rows, "id int, voice string, text int, unseen boolean")
    root = {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if (a[1] is not None and a[1] == b[1]) or (a[2] is not None and a[2] == b[2]):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    out = splits.constrained_split(t, "id", ["voice", "text"], F.col("component") * 31 % 101, F.col("unseen")).cache()
    got = {r["id"]: r for r in out.collect()}
    assert {k: r["component"] for k, r in got.items()} == {k: find(k) for k in root}
    assert splits.broken(out, ["voice", "text", "component"]).count() == 0
    held = {find(r[0]) for r in rows if r[3]}
    assert all(r["split"] == "test" for r in got.values() if r["component"] in held) and {r["split"] for r in got.values()} == {"calib", "train", "test"}
    out.unpersist()
    assert splits.constrained_split(t.where("false"), "id", ["voice"], F.col("component")).count() == 0
