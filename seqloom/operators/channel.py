"""Telephone channels: frame loss with concealment, noise at a given signal-to-noise ratio, alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import g711
from . import sequences as S
from .signal import pink_noise, resampled

ATTENUATION_DB = 6.0
FADE = 16


def uniform(*columns: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only, not on how rows are dealt."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)


def bernoulli_loss(frames: DataFrame, pct: float, seed: int) -> DataFrame:
    return frames.withColumn("lost", (uniform("clip", "frame", seed=seed) * 100 < pct).cast("int"))


def bursty_loss(frames: DataFrame, pct: float, stay: float, seed: int) -> DataFrame:
    """Two states: lost frames recover with probability `stay`, good ones fail so often that pct are lost in the long run."""
    share = pct / 100
    if share <= 0 or share >= 1:
        return frames.withColumn("lost", F.lit(int(share >= 1)))
    fail = min(1.0, max(1e-6, share * stay / (1 - share)))
    # What a draw does to the state: it sets it, keeps it, or turns it over. The state is what was last set, turned over
    # as often as turns followed.
    first = F.row_number().over(S.in_clip("frame")) == 1
    u = uniform("clip", "frame", seed=seed)
    from_good, from_lost = u < fail, u >= stay
    one = frames.select("clip", "frame").distinct().withColumn("set", F.when(first, u < share).when(from_good == from_lost, from_good)).withColumn("turn", (~first & from_good & ~from_lost).cast("int"))
    w = S.in_clip("frame").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("turns", F.sum("turn").over(w))
    one = one.withColumn("base", F.last(F.when(F.col("set").isNotNull(), F.struct(F.col("set").cast("int").alias("s"), "turns")), True).over(w))
    states = one.select("clip", "frame", F.pmod(F.col("base.s") + F.col("turns") - F.col("base.turns"), F.lit(2)).cast("int").alias("lost"))
    return frames.join(states, ["clip", "frame"])


def concealed(seq: DataFrame, value: str, frame: int) -> DataFrame:
    """With `y`: lost frames (column lost) repeat the last good one, each further one weaker by 6 dB, faded in over the
    start of the first; before any good frame there is silence. seq: clip, i, frame, lost and value."""
    seq = seq.withColumn("j", F.col("i") - F.col("frame") * frame)
    frames = seq.groupBy("clip", "frame").agg(F.max("lost").alias("lost"))
    order = Window.partitionBy("clip").orderBy("frame")
    good = F.sum(1 - F.col("lost")).over(order)
    frames = frames.withColumn("island", good).withColumn("source", F.last(F.when(F.col("lost") == 0, F.col("frame")), True).over(order))
    frames = frames.withColumn("k", F.when(F.col("lost") == 1, F.row_number().over(Window.partitionBy("clip", "island", "lost").orderBy("frame"))))
    frames = frames.select("clip", "frame", "source", "k")
    fade = min(FADE, frame // 4)
    own = seq.select("clip", "frame", "j", F.col(value).alias("_x"))
    held = own.select("clip", F.col("frame").alias("source"), "j", F.col("_x").alias("_good"))
    tail = own.where(F.col("j") >= frame - fade).select("clip", (F.col("frame") + 1).alias("frame"), (F.col("j") - (frame - fade)).alias("j"), F.col("_x").alias("_tail"))
    out = seq.join(frames, ["clip", "frame"]).join(held, ["clip", "source", "j"], "left").join(tail, ["clip", "frame", "j"], "left")
    y = F.coalesce("_good", F.lit(0.0)) * F.pow(F.lit(10.0), -ATTENUATION_DB * F.col("k") / 20)
    a = F.col("j") / max(fade - 1, 1)
    mixed = F.when((F.col("k") == 1) & (F.col("frame") > 0) & (F.col("j") < fade), (1 - a) * F.coalesce("_tail", F.lit(0.0)) + a * y).otherwise(y)
    return out.withColumn("y", F.when(F.col("lost") == 1, mixed).otherwise(F.col(value))).drop("_good", "_tail", "j")


def actual_loss(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip").agg((100 * F.avg("lost")).alias("loss_pct"))


def noisy(seq: DataFrame, value: str, noise: str, snr_db: float, frame: int) -> DataFrame:
    """With `y`: noise of unit power added at snr_db below the active speech power (1 for silent clips)."""
    power = S.active_power(seq, value, frame)
    p = F.when(F.col("power") > 0, F.col("power")).otherwise(1.0)
    return seq.join(power, "clip").withColumn("y", F.col(value) + F.col(noise) * F.sqrt(p / 10 ** (snr_db / 10))).drop("power")


def best_lag(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """clip, lag: the shift of b (clip, i, x) in 0..most that correlates most with a, the smallest on ties. Samples are
    shuffled once, by clip; all lags come from one transform a block, and those near the top are summed exactly."""
    kind = a.schema["clip"].dataType.simpleString()

    def dense(pdf: pd.DataFrame, n: int) -> np.ndarray:
        out = np.zeros(n)
        at = pdf["i"].to_numpy(np.int64)
        out[at] = pdf["x"].to_numpy(float)
        return out

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"clip": [], "lag": []})
        n = int(max(one["i"].max(), two["i"].max())) + 1
        x, y = dense(one, n), dense(two, n)
        lags = min(most, n - 1) + 1
        about = np.zeros(lags)
        step = max(1 << 14, 4 * lags)
        size = 1 << (step + lags).bit_length()
        for at in range(0, n, step):  # blocks of x against the block of y and the lags behind it: partial sums add up
            left, right = np.fft.rfft(x[at : at + step], size), np.fft.rfft(y[at : at + step + lags], size)
            about += np.fft.irfft(left.conj() * right, size)[:lags]
        near = np.flatnonzero(about >= about.max() - 1e-9 * np.sqrt((x @ x) * (y @ y)) - 1e-300)
        corr = [float(x[: n - k] @ y[k:]) for k in near]
        return pd.DataFrame({"clip": one["clip"].iloc[:1], "lag": [int(near[np.argmax(corr)])]})

    return a.select("clip", "i", "x").groupBy("clip").cogroup(b.select("clip", "i", "x").groupBy("clip")).applyInPandas(run, f"clip {kind}, lag int")


def aligned(decoded: DataFrame, lags: DataFrame, lengths: DataFrame) -> DataFrame:
    """decoded (clip, i, x) moved back by its clip's lag, cut or filled with silence to the clip's length n."""
    moved = decoded.join(lags, "clip", "left").select("clip", (F.col("i") - F.coalesce("lag", F.lit(0))).alias("i"), "x")
    grid = lengths.where("n > 0").select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return grid.join(moved, ["clip", "i"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def sampled_noise(corpus: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """n samples of one recording of the corpus, tiled if it is shorter, from a drawn place, with mean 0 and deviation 1; pink noise without a corpus."""
    if not corpus:
        return pink_noise(n, seed)
    rng = np.random.default_rng(seed)
    x = corpus[int(rng.integers(len(corpus)))]
    if len(x) < n:
        x = np.tile(x, -(-n // max(len(x), 1)))
    at = int(rng.integers(len(x) - n + 1))
    x = x[at : at + n] - x[at : at + n].mean()
    return x / (x.std() or 1.0)


def prepared(clips: DataFrame, rate: int, seed: int, corpus: list[np.ndarray] | None = None) -> DataFrame:
    """clip, i, x, noise: clips (clip, sr, samples) at another rate, in long form, with a noise sample of each. A clip's
    noise depends on its name and the seed. corpus: a few recordings at that rate, which go to all tasks."""
    kind = clips.schema["clip"].dataType.simpleString()

    def run(batches):
        import zlib

        for pdf in batches:
            for r in pdf.itertuples():
                x = resampled(np.asarray(r.samples if r.samples is not None else [], float), rate, int(r.sr))
                noise = sampled_noise(corpus or [], len(x), zlib.crc32(f"{r.clip}:{seed}".encode())) if len(x) else x
                yield pd.DataFrame({"clip": [r.clip] * len(x), "i": np.arange(len(x)), "x": x, "noise": noise})

    return clips.select("clip", "sr", "samples").mapInPandas(run, f"clip {kind}, i long, x double, noise double")


def loss_of(draws: np.ndarray, pct: float, stay: float | None) -> np.ndarray:
    """Frames that are lost (1), from a number in [0, 1) each; by the rules of bernoulli_loss, or bursty_loss if stay is given."""
    share = pct / 100
    if stay is None:
        return (draws * 100 < pct).astype(np.int32)
    if share <= 0 or share >= 1:
        return np.full(len(draws), int(share >= 1), np.int32)
    fail, out = min(1.0, max(1e-6, share * stay / (1 - share))), np.zeros(len(draws), np.int32)
    for k, u in enumerate(draws):
        out[k] = u < share if not k else u >= stay if out[k - 1] else u < fail
    return out


def concealed_samples(x: np.ndarray, lost: np.ndarray, frame: int) -> np.ndarray:
    """`concealed` of one clip's samples; lost: 1 for each frame that is."""
    y, fade = x.copy(), min(FADE, frame // 4)
    source, k = None, 0
    for f, gone in enumerate(lost):
        here = slice(f * frame, min((f + 1) * frame, len(x)))
        if not gone:
            source, k = x[here], 0
            continue
        k += 1
        n = here.stop - here.start
        held = np.zeros(n)
        if source is not None:
            held[: len(source)] = source[:n] * 10.0 ** (-ATTENUATION_DB * k / 20)
        if k == 1 and f:
            m = min(fade, n)
            a = np.arange(m) / max(fade - 1, 1)
            tail = x[f * frame - fade : f * frame][:m]
            held[:m] = (1 - a) * tail + a * held[:m]
        y[here] = held
    return y


def speech_power(x: np.ndarray, frame: int, gate_db: float = 30.0) -> float:
    """sequences.active_power of one clip's samples."""
    whole = x[: len(x) // frame * frame].reshape(-1, frame)
    energy = (whole * whole).sum(axis=1)
    top = energy.max() / frame if len(energy) else 0.0
    active = energy[energy / frame >= top * 10 ** (-gate_db / 10)] if top > 0 else energy[:0]
    return float(active.sum() / (len(active) * frame)) if len(active) else float((x * x).mean())


def simulated(clips: DataFrame, codec: str, sr: int, loss_pct: float = 0.0, snr_db: float | None = None, burst: float | None = None, seed: int = 42, frame_ms: int = 20, corpus: list[np.ndarray] | None = None) -> tuple[DataFrame, int]:
    """(clip, i, y, lost) of clips (clip, sr, samples, all of rate sr) after a channel, and the rate: resampling, noise, codec,
    frame loss with concealment, limits. burst: the chance that a run of lost frames ends, for bursty loss. The codecs here
    delay nothing. A clip comes as one row and stays one until it is through, so that nothing is shuffled or joined."""
    if codec not in ("clean", "g711a", "g711u"):
        raise ValueError(f"no codec for {codec!r} on this machine")
    rate = sr if codec == "clean" else 8000
    frame = rate * frame_ms // 1000
    kind = clips.schema["clip"].dataType.simpleString()

    def before(batches):
        import zlib

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = resampled(np.asarray(r.samples if r.samples is not None else [], float), rate, int(r.sr))
                if snr_db is not None and len(x):
                    noise = sampled_noise(corpus or [], len(x), zlib.crc32(f"{r.clip}:{seed}".encode()))
                    x = x + noise * np.sqrt((speech_power(x, frame) or 1.0) / 10 ** (snr_db / 10))
                if len(x):
                    out.append((r.clip, x))
            if out:
                yield pd.DataFrame({"clip": [c for c, _ in out], "x": [x for _, x in out], "_n": [-(-len(x) // frame) for _, x in out]})

    def after(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            lost = [loss_of(np.asarray(u, float), loss_pct, burst) for u in pdf["_u"]]
            y = [np.clip(concealed_samples(np.asarray(x, float), gone, frame), -1.0, 1.0) for x, gone in zip(pdf["x"], lost, strict=True)]
            yield pd.DataFrame({"clip": pdf["clip"], "y": y, "lost": [np.repeat(gone, frame)[: len(v)] for gone, v in zip(lost, y, strict=True)]})

    rows = clips.select("clip", "sr", "samples").mapInPandas(before, f"clip {kind}, x array<double>, _n long")
    if codec != "clean":
        rows = rows.withColumn("x", F.transform("x", lambda v: g711.round_trip(v, "alaw" if codec == "g711a" else "ulaw")))
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda f: F.pmod(F.xxhash64(F.col("clip"), f, F.lit(seed)), F.lit(1 << 30)) / (1 << 30))
    out = rows.select("clip", "x", draws.alias("_u")).mapInPandas(after, f"clip {kind}, y array<double>, lost array<int>")
    return out.select("clip", F.posexplode(F.arrays_zip("y", "lost")).alias("i", "e")).select("clip", F.col("i").cast("long").alias("i"), "e.y", "e.lost"), rate


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def frame_noise(key: pd.Series, frame: pd.Series, x: pd.Series, snr_db: pd.Series, seed: pd.Series) -> pd.Series:
    """Frames with noise at snr_db below their own power (1 for silent ones), drawn anew for each key, frame and seed."""

    def one(k, f, v, snr, s):
        v = np.asarray(v, float)
        rng = np.random.default_rng([int(k) & 0xFFFFFFFF, int(k) >> 32 & 0xFFFFFFFF, int(f), int(s)])
        return v + rng.standard_normal(len(v)) * np.sqrt((np.mean(v * v) or 1.0) / 10 ** (snr / 10)) if len(v) else v

    return pd.Series([None if v is None else one(k, f, v, snr, s) for k, f, v, snr, s in zip(key, frame, x, snr_db, seed, strict=True)])


def coded_frames(frames: DataFrame, codec: str, snr_db: float | None = None, seed: int = 42) -> DataFrame:
    """frames (clip, frame, x array<double>, and others) with x after noise and codec, of a table or a stream."""
    if codec not in ("clean", "g711a", "g711u"):
        raise ValueError(f"no codec for {codec!r} on this machine")
    if snr_db is not None:
        frames = frames.withColumn("x", frame_noise(F.xxhash64("clip"), "frame", "x", F.lit(float(snr_db)), F.lit(seed)))
    if codec != "clean":
        frames = frames.withColumn("x", F.transform("x", lambda v: g711.round_trip(v, "alaw" if codec == "g711a" else "ulaw")))
    return frames


def through_frames(frames: DataFrame, codec: str, frame: int, loss_pct: float = 0.0, snr_db: float | None = None, burst: float | None = None, seed: int = 42) -> DataFrame:
    """clip, i, lost, y: what a live channel makes of frames that are all there."""
    seq = coded_frames(frames, codec, snr_db, seed).select("clip", "frame", F.posexplode("x").alias("j", "x")).select("clip", "frame", (F.col("frame") * frame + F.col("j")).alias("i"), "x")
    own = frames.select("clip", "frame")
    lost = bernoulli_loss(own, loss_pct, seed) if burst is None else bursty_loss(own, loss_pct, burst, seed)
    out = concealed(seq.join(lost, ["clip", "frame"]), "x", frame)
    return out.select("clip", "i", "lost", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("y"))).alias("y"))
