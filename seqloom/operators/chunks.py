"""Kernels over long recordings in pieces: a (clip, chunk) and a halo of samples around it is a task's unit, so that a
clip of any length is many bounded tasks. seq: clip, i (from 0), and a value; samples that are not there are silent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sequences as S
from .signal import bits_of, residual_of, voiced_frames


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for the rows of equal keys that lie together; a key whose rows go on in the next batch comes again."""
    for batch in batches:
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= np.diff(batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)) != 0
        edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):  # noqa: B905
            yield tuple(batch.column(k)[low].as_py() for k in keys), batch.slice(low, high - low)


def lists(rows: np.ndarray) -> pa.Array:
    """A list for each row of an array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def chunked(seq: DataFrame, value: str, size: int, before: int, after: int, kernel: Callable[[np.ndarray, int, int, int], dict], types: str) -> DataFrame:
    """clip, and what kernel(samples, start, n, end) gives for each chunk of `size` samples: `samples` begin `before` samples
    ahead of `start` and end `after` samples behind the chunk's n; those from `end` on are not there. types: names and
    types of what it gives. A task goes through its chunks one after the other, in batches that hold rows of many."""
    if before > size or after > size:
        raise ValueError("a halo goes over one neighbour at most")
    kind = seq.schema["clip"].dataType.simpleString()
    own, place = F.floor(F.col("i") / size), F.pmod("i", F.lit(size))
    near = F.array_compact(F.array(own, F.when(place >= size - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    dealt = seq.select("clip", F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("x"), F.explode(near).alias("chunk"))

    fields = [t.split() for t in types.split(", ")]

    def found(clip: pa.Scalar, chunk: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        i, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        start = chunk * size
        inside = i[(i >= start) & (i < start + size)]
        if not len(inside):  # only the halo of a neighbour
            return None
        n = int(inside.max()) - start + 1
        samples = np.zeros(before + n + after)
        at = i - start + before
        ok = at < len(samples)
        samples[at[ok]] = x[ok]
        got = kernel(samples, start, n, int(i.max()) + 1)
        columns = [lists(v) if isinstance(v, np.ndarray) and v.ndim == 2 else pa.array(v, ARROW[kind]) for v, (_, kind) in ((got[name], f) for f in fields for name in f[:1])]
        return pa.RecordBatch.from_arrays([pa.repeat(clip, len(columns[0])), *columns], ["clip", *(name for name, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, clip, parts, ready, many = None, None, [], [], 0
        for own, rows in runs(batches, "clip", "chunk"):
            if parts and own != key:
                ready.append(found(clip, key[1], parts))
                many, parts = many + len(parts[0][0]), []
                if many >= 10_000:
                    yield from joined(ready)
                    ready, many = [], 0
            key, clip = own, rows.column("clip")[0]
            parts.append((rows.column("i").to_numpy(zero_copy_only=False), rows.column("x").to_numpy(zero_copy_only=False)))
        if parts:
            ready.append(found(clip, key[1], parts))
        yield from joined(ready)

    return dealt.repartition("clip", "chunk").sortWithinPartitions("clip", "chunk").mapInArrow(run, f"clip {kind}, {types}")


def joined(batches: list[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    some = [b for b in batches if b is not None]
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def residual(seq: DataFrame, value: str, frame: int, order: int, frames_per_chunk: int = 256) -> DataFrame:
    """clip, i, e, bit: the prediction error of any order, with the history before each frame, and whether it is above its frame's median."""
    step = max(order + 1, frame)

    def kernel(samples: np.ndarray, start: int, n: int, end: int) -> dict:
        e = residual_of(samples[order:], frame, order, samples[:order])
        return {"i": np.arange(start, start + n), "e": e, "bit": bits_of(e, frame)}

    size = step * frames_per_chunk * frame if step != frame else frame * frames_per_chunk  # whole frames and whole steps
    return chunked(seq, value, size, order, 0, kernel, "i long, e double, bit int")


def symbols(seq: DataFrame, value: str, frame: int, order: int, which: str = "all", speech: tuple[int, int] | None = None, frames_per_chunk: int = 256) -> DataFrame:
    """clip, i, bit: bits of the residual of the frames of a class, numbered anew. speech: shortest and longest lag of a voice's period."""
    bits = S.framed(residual(seq, value, frame, order, frames_per_chunk).select("clip", "i", "bit"), frame)
    if which != "all":
        bits = S.chosen_frames(bits.join(voiced_frames(seq, value, frame, *speech), ["clip", "frame"]), which)
    per = bits.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"))
    first = per.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("clip", "frame").orderBy("i")) - 1
    return bits.join(first, ["clip", "frame"]).select("clip", (F.col("first") + inner).cast("long").alias("i"), "bit")


def candidates_of(frames: np.ndarray, sr: int, low: float, high: float, most: int, octave_cost: float) -> tuple[list[list[float]], list[list[float]]]:
    """For each frame the periods (samples, with a fraction) at which its normalised autocorrelation peaks, and their
    strengths; longer periods count for less, by `octave_cost` an octave."""
    frames = frames - frames.mean(axis=1, keepdims=True)
    w = frames.shape[1]
    shortest, longest = max(2, int(sr / high)), min(int(np.ceil(sr / low)), w - 2)
    spectrum = np.fft.rfft(frames, 2 * w)
    product = np.fft.irfft(spectrum * spectrum.conj(), 2 * w)[:, : longest + 2]
    energy = np.concatenate((np.zeros((len(frames), 1)), np.cumsum(frames * frames, axis=1)), axis=1)
    lags = np.arange(longest + 2)
    scale = np.sqrt(np.maximum(energy[:, w - lags] * (energy[:, [w]] - energy[:, lags]), 0.0))
    r = np.where(scale > 1e-12, product / np.maximum(scale, 1e-12), 0.0)
    mid, left, right = r[:, shortest : longest + 1], r[:, shortest - 1 : longest], r[:, shortest + 1 : longest + 2]
    peak = (mid > left) & (mid >= right) & (mid > 0.2)
    bend = left - 2 * mid + right
    shift = np.where(bend < 0, 0.5 * (left - right) / np.where(bend < 0, bend, -1.0), 0.0)
    periods = lags[shortest : longest + 1] + shift
    strength = np.where(peak, np.minimum(mid - 0.25 * (left - right) * shift, 1.0) - octave_cost * np.log2(np.maximum(periods, 1.0) * high / sr), -np.inf)
    best = np.argsort(-strength, axis=1, kind="stable")[:, :most]
    out = [[(float(periods[f, k]), float(strength[f, k])) for k in best[f] if np.isfinite(strength[f, k])] for f in range(len(frames))]
    return [[p for p, _ in c] for c in out], [[s for _, s in c] for c in out]


def pitch_candidates(seq: DataFrame, value: str, sr: int, hop: int, width: int, low: float = 75.0, high: float = 600.0, most: int = 5, octave_cost: float = 0.05, silence: float = 1e-6, hops_per_chunk: int = 400) -> DataFrame:
    """clip, frame, periods, strengths: candidates of overlapping frames of `width` samples, `hop` apart; none for silent ones."""

    def kernel(samples: np.ndarray, start: int, n: int, end: int) -> dict:
        count = -(-n // hop)
        view = np.lib.stride_tricks.sliding_window_view(np.pad(samples, (0, hop)), width)[: count * hop : hop]
        periods, strengths = candidates_of(view, sr, low, high, most, octave_cost)
        loud = (view * view).mean(axis=1) >= silence
        keep = lambda c: [v if ok else [] for v, ok in zip(c, loud, strict=True)]
        return {"frame": start // hop + np.arange(count), "periods": keep(periods), "strengths": keep(strengths)}

    return chunked(seq, value, hop * max(hops_per_chunk, -(-width // hop)), 0, width, kernel, "frame long, periods array<double>, strengths array<double>")


def best_path(periods: list, strengths: list, unvoiced: float, jump: float, change: float) -> list[float]:
    """The period of each frame (0: unvoiced) on the path with the highest sum of strengths, less `jump` an octave between
    neighbouring periods, less `change` where voicing begins or ends. Unvoiced frames have the strength `unvoiced`. The first of equal ones."""
    back, before, score = [], np.zeros(1), np.zeros(1)
    for p, s in zip(periods, strengths, strict=True):
        logs = np.log2(np.asarray(p, float)) if len(p) else np.zeros(0)
        own = np.concatenate(([unvoiced], np.asarray(s, float)))
        if back:
            step = np.zeros((len(score), len(own)))
            step[1:, 1:] = jump * np.abs(before[1:, None] - logs[None, :])
            step[0, 1:], step[1:, 0] = change, change
            total = score[:, None] - step
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + own
        else:
            back.append(np.zeros(len(own), int))
            score = own
        before = np.concatenate(([0.0], logs))
    out, at = [], int(score.argmax()) if back else 0
    for k in range(len(back) - 1, -1, -1):
        out.append(float(periods[k][at - 1]) if at else 0.0)
        at = int(back[k][at])
    return out[::-1]


def pitch_track(candidates: DataFrame, unvoiced: float = 0.45, jump: float = 0.35, change: float = 0.14) -> DataFrame:
    """clip, frame, period (samples; 0 where unvoiced). A clip's candidates, a few numbers a frame, are one task's."""
    kind = candidates.schema["clip"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        path = best_path(pdf["periods"].tolist(), pdf["strengths"].tolist(), unvoiced, jump, change)
        return pd.DataFrame({"clip": pdf["clip"], "frame": pdf["frame"], "period": path})

    return candidates.groupBy("clip").applyInPandas(run, f"clip {kind}, frame long, period double")


def tracked_periods(seq: DataFrame, value: str, track: DataFrame, hop: int, longest_run: int = 1000) -> DataFrame:
    """clip, i, period: from one peak to the next in each voiced run of frames, each looked for within a fifth of the
    track's period; peaks' places have a fraction. Runs are cut after `longest_run` frames."""
    kind = seq.schema["clip"].dataType.simpleString()
    order = Window.partitionBy("clip").orderBy("frame")
    voiced = track.where("period > 0").withColumn("_g", F.col("frame") - F.row_number().over(order))
    runs = voiced.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy("clip", "_g").orderBy("frame")) - 1) / longest_run))
    rows = S.framed(seq.select("clip", "i", F.col(value).cast("double").alias("x")), hop).join(runs, ["clip", "frame"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, x, t = pdf["i"].to_numpy(), pdf["x"].to_numpy(), pdf["period"].to_numpy()
        marks, at = [], int(np.argmax(x[: max(1, int(round(t[0])))])) if len(x) else 0
        while True:
            bend = x[at - 1] - 2 * x[at] + x[at + 1] if 0 < at < len(x) - 1 else 0.0
            marks.append(i[at] + (0.5 * (x[at - 1] - x[at + 1]) / bend if bend < 0 else 0.0))
            a, z = at + int(round(0.8 * t[at])), at + int(round(1.2 * t[at])) + 1
            if z > len(x) or a <= at:
                break
            at = a + int(np.argmax(x[a:z]))
        return pd.DataFrame({"clip": pdf["clip"].iloc[0], "i": np.floor(marks[1:]).astype(np.int64), "period": np.diff(marks)})

    return rows.groupBy("clip", "_g", "_k").applyInPandas(run, f"clip {kind}, i long, period double")
