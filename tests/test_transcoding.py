"""The live channel gives the batch chain's samples, however a stream is cut."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import channel
from seqloom.streaming import scoring, sessions, transcoding

N = 160


def tone(n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 8000
    return (0.3 * np.sin(2 * math.pi * 300 * t) + 0.2 * np.sin(2 * math.pi * 1000 * t) + 0.05 * rng.standard_normal(n)).tolist()


@pytest.fixture(scope="module")
def frames(spark):
    clips = [(c, tone(N * 30 + 50 * c, c)) for c in range(4)]
    return spark.createDataFrame([(c, f, x[f * N : f * N + N]) for c, x in clips for f in range(-(-len(x) // N))], "clip long, frame long, x array<double>"), clips


def streamed(spark, table, tmp_path, cuts, run):
    """table as a stream of so many files, cut at random places of each clip."""
    rows = sorted(table.collect(), key=lambda r: (r["frame"], r["clip"]))
    rng, edges = random.Random(cuts), None
    edges = [0, *sorted(rng.sample(range(1, len(rows)), cuts - 1)), len(rows)]
    os.makedirs(tmp_path / "files")
    for k in range(cuts):
        spark.createDataFrame(rows[edges[k] : edges[k + 1]], table.schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        for f in (tmp_path / f"p{k}").glob("part-*"):
            f.rename(tmp_path / "files" / f"{k:02d}.parquet")
        os.utime(tmp_path / "files" / f"{k:02d}.parquet", (time.time() - 100 + k,) * 2)
    before = sessions.use_rocksdb(spark)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
    out = scoring.finished(stream, str(tmp_path / "out"), str(tmp_path / "state"), run)
    spark.conf.set(sessions.PROVIDER, before) if before else spark.conf.unset(sessions.PROVIDER)
    return out


def samples(rows):
    return {(r["clip"], r["i"]): (r["lost"], r["y"]) for r in rows.collect()}


def spread(out):
    return out.select("clip", "frame", "lost", F.posexplode("y").alias("j", "y")).select("clip", (F.col("frame") * N + F.col("j")).alias("i"), "lost", "y")


def close(a, b):
    assert a.keys() == b.keys()
    assert all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-12 for k in a)


@pytest.mark.parametrize(("codec", "pct", "snr", "burst", "cuts"), [("g711a", 15.0, None, None, 1), ("g711u", 30.0, 12.0, None, 4), ("clean", 30.0, 20.0, 0.4, 5)])
def test_stream_gives_the_batch(spark, frames, tmp_path, codec, pct, snr, burst, cuts):
    table, _ = frames
    out = streamed(spark, table, tmp_path, cuts, lambda s: transcoding.streaming_channel(s, codec, transcoding.Loss(N, pct, burst), snr, ttl_ms=None))
    want = samples(channel.through_frames(table, codec, N, pct, snr, burst))
    close(samples(spread(out)), want)
    assert 0 < sum(v[0] for v in want.values()) < len(want)


def test_stream_gives_the_whole_chain(spark, frames, tmp_path):
    """Codec and losses of clips at once: the chain that batch jobs use."""
    table, clips = frames
    whole, rate = channel.simulated(spark.createDataFrame([(c, 8000, x) for c, x in clips], "clip long, sr int, samples array<double>"), "g711a", 8000, 20.0)
    assert rate == 8000
    out = streamed(spark, table, tmp_path, 3, lambda s: transcoding.streaming_channel(s, "g711a", transcoding.Loss(N, 20.0), ttl_ms=None))
    close(samples(spread(out)), samples(whole))


def test_leading_loss_is_silent_and_gaps_are_lost():
    own = transcoding.Channel(transcoding.Loss(N))
    x = np.ones(N)
    assert not own.push(0, x, 0.5, 1)[0][2].any() and not own.push(1, x, 0.5, 1)[0][2].any()
    assert (own.push(2, x, 0.5, 0)[0][2] == 1).all()
    rows = own.push(6, x, 0.5, 0)  # 3, 4 and 5 never came
    assert [(f, lost) for f, lost, _ in rows] == [(3, 1), (4, 1), (5, 1), (6, 0)]
    assert rows[0][2][-1] == pytest.approx(10 ** (-6 / 20)) and rows[1][2][0] == pytest.approx(10 ** (-12 / 20))
    assert own.push(5, x, 0.5, 0) == []


def test_codec_keeps_the_signal(frames):
    table, _ = frames
    pairs = table.withColumn("z", F.col("x")).transform(lambda t: channel.coded_frames(t, "g711a")).select(F.expr("aggregate(z, 0D, (a, v) -> a + v * v)").alias("s"), F.expr("aggregate(zip_with(x, z, (a, b) -> (a - b) * (a - b)), 0D, (a, v) -> a + v)").alias("e")).agg(F.sum("s").alias("s"), F.sum("e").alias("e")).first()
    assert 10 * math.log10(pairs["s"] / pairs["e"]) >= 30
