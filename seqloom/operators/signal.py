"""Linear prediction, cepstra, pitch and noise kernels over sequences.

What windows can say is said with windows; NumPy kernels work on arrays of frames in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sequences as S


def autocorrelation(seq: DataFrame, value: str, frame: int, order: int, hamming: bool = False) -> DataFrame:
    """clip, frame, r0..r<order> of each frame, on the periodic Hamming window if asked for."""
    rows = S.framed(seq, frame)
    place = F.col("i") % frame
    x = F.col(value) * (0.54 - 0.46 * F.cos(2 * math.pi * place / frame)) if hamming else F.col(value)
    w = Window.partitionBy("clip", "frame").orderBy("i")
    rows = rows.withColumn("_x", x)
    lagged = rows.select("clip", "frame", *((F.col("_x") * F.lag("_x", k).over(w)).alias(f"r{k}") if k else (F.col("_x") * F.col("_x")).alias("r0") for k in range(order + 1)))
    return lagged.groupBy("clip", "frame").agg(*(F.coalesce(F.sum(f"r{k}"), F.lit(0.0)).alias(f"r{k}") for k in range(order + 1)))


def lpc2(correlations: DataFrame) -> DataFrame:
    """a1, a2: predictor coefficients of order 2 in closed form; 0 for silent frames."""
    r0, r1, r2 = F.col("r0") * (1 + 1e-9), F.col("r1"), F.col("r2")
    d = r0 * r0 - r1 * r1
    ok = (F.col("r0") > 0) & (d > 0)
    return correlations.withColumn("a1", F.when(ok, r1 * (r0 - r2) / d).otherwise(0.0)).withColumn("a2", F.when(ok, (r0 * r2 - r1 * r1) / d).otherwise(0.0))


def rounded(correlations: DataFrame, digits: int) -> DataFrame:
    """With r0, r1 ... rounded: nearly singular frames magnify the order of summation, which engines are free to choose."""
    return correlations.withColumns({c: F.round(c, digits) for c in correlations.columns if c[0] == "r" and c[1:].isdigit()})


def residual2(seq: DataFrame, value: str, frame: int, digits: int = 9) -> DataFrame:
    """With `e`: what order-2 prediction leaves; the history crosses frames and is silent before the clip. Correlations
    are rounded to `digits`."""
    coefficients = lpc2(rounded(autocorrelation(seq, value, frame, 2), digits)).select("clip", "frame", "a1", "a2")
    w = S.in_clip()
    rows = S.framed(seq, frame).withColumn("_1", F.coalesce(F.lag(value, 1).over(w), F.lit(0.0))).withColumn("_2", F.coalesce(F.lag(value, 2).over(w), F.lit(0.0)))
    return rows.join(coefficients, ["clip", "frame"]).withColumn("e", F.col(value) - F.col("a1") * F.col("_1") - F.col("a2") * F.col("_2")).drop("_1", "_2")


def durbin(r: np.ndarray) -> np.ndarray:
    """Predictor coefficients [frames, order] for autocorrelations r [frames, order + 1], all frames at once."""
    n, order = r.shape[0], r.shape[1] - 1
    a, error = np.zeros((n, order)), r[:, 0] * (1 + 1e-9)
    live = r[:, 0] > 0
    for i in range(order):
        live &= error > 0
        k = np.where(live, (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / np.where(live, error, 1.0), 0.0)
        if i:
            a[:, :i] = np.where(live[:, None], a[:, :i] - k[:, None] * a[:, i - 1 :: -1][:, :i], a[:, :i])
        a[:, i] = k
        error = np.where(live, error * (1 - k * k), error)
    return a


def residual_of(x: np.ndarray, frame: int, order: int, before: np.ndarray | None = None) -> np.ndarray:
    """The prediction error of a signal, frame by frame, with the history before each frame; `before`: the `order` samples ahead of x, silence if not given."""
    step = max(order + 1, frame)
    whole = -(-len(x) // step)
    padded = np.zeros(whole * step)
    padded[: len(x)] = x
    frames = padded.reshape(whole, step) if whole else padded.reshape(0, step)
    sizes = np.minimum(step, len(x) - np.arange(whole) * step)
    window = np.zeros_like(frames)
    for i, n in enumerate(sizes):
        window[i, :n] = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    y = frames * window
    r = np.stack([(y[:, : step - k] * y[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1) if whole else np.zeros((0, order + 1))
    a = durbin(r)
    a[sizes <= order] = 0
    past = np.concatenate((np.zeros(order) if before is None else before, padded))
    history = np.stack([past[order - 1 - j : order - 1 - j + len(padded)] for j in range(order)], axis=1)
    return (padded - (history * np.repeat(a, step, axis=0)).sum(axis=1))[: len(x)]


def residual(clips: DataFrame, frame: int, order: int) -> DataFrame:
    """clip, residual: array of the prediction error of each clip (clip, samples array), order any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [residual_of(np.asarray(x or [], float), frame, order) for x in batch.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("clip"), pa.array([list(x) for x in out], pa.list_(pa.float64()))], ["clip", "residual"])

    kind = clips.schema["clip"].dataType.simpleString()
    return clips.select("clip", "samples").mapInArrow(run, f"clip {kind}, residual array<double>")


def jitter(periods: DataFrame, value: str) -> DataFrame:
    """With d, the relative change to the next period, and bit, whether it grows; the last row of a clip goes."""
    after = F.lead(value).over(S.in_clip())
    out = periods.withColumn("d", (after - F.col(value)) / F.avg(value).over(Window.partitionBy("clip")))
    return out.where("d IS NOT NULL").withColumn("bit", (F.col("d") > 0).cast("int"))


def valid_periods(df: DataFrame, seconds: str) -> DataFrame:
    """Voice periods: 0.8/600 s to 1.2/75 s."""
    return df.where(F.col(seconds).between(0.8 / 600, 1.2 / 75))


def lfcc_matrix(frame: int, sr: int, filters: int = 40, kept: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Triangular filters [filters, bins] with evenly spaced edges, and the orthonormal cosine matrix of the first `kept`."""
    bins = np.arange(frame // 2 + 1) * sr / frame
    edges = np.linspace(0, sr / 2, filters + 2)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None)
    n = np.arange(kept)
    cosine = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / (2 * kept)) * np.sqrt(2 / kept)
    cosine[0] /= np.sqrt(2)
    return bank, cosine


def lfcc(frames: np.ndarray, sr: int, kept: int = 20) -> np.ndarray:
    """Cepstra [frames, kept] of frames [frames, samples]. The cosine transform sees the first `kept` of 40 filters only."""
    bank, cosine = lfcc_matrix(frames.shape[1], sr, kept=kept)
    power = np.abs(np.fft.rfft(frames * np.hamming(frames.shape[1]), axis=1)) ** 2
    return np.log(power @ bank.T + 1e-8)[:, :kept] @ cosine.T


def lfcc_features(clips: DataFrame, frame: int, sr: int, kept: int = 20) -> DataFrame:
    """clip, features: mean and deviation of the cepstra over a clip's whole frames (clip, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf["samples"]:
                x = np.asarray(x if x is not None else [], float)
                x = x[: len(x) // frame * frame].reshape(-1, frame)
                c = lfcc(x, sr, kept) if len(x) else np.zeros((1, kept))
                out.append(np.concatenate((c.mean(axis=0), c.std(axis=0))))
            yield pd.DataFrame({"clip": pdf["clip"], "features": out})

    kind = clips.schema["clip"].dataType.simpleString()
    return clips.select("clip", "samples").mapInPandas(run, f"clip {kind}, features array<double>")


def pink_noise(n: int, seed: int) -> np.ndarray:
    """Noise whose power falls with the frequency, with mean 0 and deviation 1."""
    spectrum = np.fft.rfft(np.random.default_rng(seed).standard_normal(n))
    scale = np.sqrt(np.arange(len(spectrum), dtype=float))
    scale[0] = np.inf
    x = np.fft.irfft(spectrum / scale, n)
    x -= x.mean()
    return x / (x.std() or 1.0)


def resampled(x: np.ndarray, up: int, down: int, taps: int = 10) -> np.ndarray:
    """Rational resampling with a Kaiser-windowed sinc, polyphase."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x
    most = max(up, down)
    half = taps * most
    k = np.arange(-half, half + 1)
    h = np.sinc(k / most) / most * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    n = -(-len(x) * up // down)
    out = np.zeros(n)
    at = np.arange(n) * down + half
    for phase in range(up):
        hp = h[phase::up]
        own = np.flatnonzero(at % up == phase)
        if not len(own):
            continue
        first = at[own] // up
        index = first[:, None] - np.arange(len(hp))[None, :]
        ok = (index >= 0) & (index < len(x))
        out[own] = (np.where(ok, x[np.clip(index, 0, max(len(x) - 1, 0))], 0.0) * hp).sum(axis=1)
    return out


def bits_of(x: np.ndarray, frame: int) -> np.ndarray:
    """1 where a value is above its frame's median; a last, shorter frame has its own."""
    return np.concatenate([(x[k : k + frame] > np.median(x[k : k + frame])).astype(np.int64) for k in range(0, len(x), frame)]) if len(x) else np.zeros(0, np.int64)


def voiced_frames(seq: DataFrame, value: str, frame: int, shortest: int, longest: int, least: float = 0.3) -> DataFrame:
    """clip, frame, voiced: whether a frame's autocorrelation at some lag from shortest to longest is above `least` of
    that at 0. A frame's samples are one short array."""
    rows = S.framed(seq, frame).groupBy("clip", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("x")))), lambda s: s["x"]).alias("x"))
    at = lambda k: F.aggregate(F.zip_with(F.col("x"), F.slice("x", k + 1, F.greatest(F.size("x") - k, F.lit(0))), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda t, v: t + v)
    best = F.array_max(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), at))
    return rows.select("clip", "frame", F.coalesce((at(F.lit(0)) > 0) & (best > least * at(F.lit(0))), F.lit(False)).alias("voiced"))


def symbols_a(seq: DataFrame, value: str, frame: int, which: str = "all", speech: tuple[int, int] | None = None, digits: int = 9) -> DataFrame:
    """clip, i, bit: bits of the order-2 residual of the frames of a class, numbered anew. speech: shortest and longest lag of a voice's period in samples."""
    bits = S.binarised(residual2(seq, value, frame, digits).select("clip", "i", "e"), "e", frame).select("clip", "i", "frame", "bit")
    if which != "all":
        bits = S.chosen_frames(bits.join(voiced_frames(seq, value, frame, *speech), ["clip", "frame"]), which)
    return bits.select("clip", (F.row_number().over(S.in_clip()) - 1).cast("long").alias("i"), "bit")


def periods(seq: DataFrame, value: str, sr: int) -> DataFrame:
    """clip, i, period: samples between neighbouring peaks (above 0, above the sample before, not below the one after)
    that are as far apart as a voice's period can be."""
    w = S.in_clip()
    x = F.col(value)
    peaks = seq.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w)).where((x > 0) & (x > F.col("_p")) & (x >= F.col("_n")))
    gaps = peaks.select("clip", "i", (F.col("i") - F.lag("i").over(w)).alias("period"))
    return valid_periods(gaps.withColumn("_s", F.col("period") / sr), "_s").drop("_s")
