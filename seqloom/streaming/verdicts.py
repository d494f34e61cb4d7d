"""Streaming sessions: segments of a fixed number of speech frames, and sequential verdicts over them.

Both keep the state of sessions and use the batch operators' rules, so that a stream gives what a batch gives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import barriers


def streaming_sprt(stream: DataFrame, alpha: float = 0.01, beta: float = 0.05, most: int = 8, idle_ms: int | None = 3_600_000, shards: int = 1024) -> DataFrame:
    """stream: clip long, i long (rising in a clip), llr double -> clip, i, k, lambda, verdict. A decided session stays
    as it is; a session without rows for idle_ms (None: however long) is forgotten.

    Sessions are dealt by hash to `shards` groups whose state holds those of each side by side: Python is called for a
    shard, and its sessions take their steps as arrays, where a call for every session costs more than its rows. A batch
    writes the state of the shards that it has rows of; shards must stay the same over restarts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Sessions.of(state.get if state.exists else None)
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        out = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            rows = rows.iloc[np.lexsort((rows["i"], ~rows["placed"], rows["clip"], rows["known"]))]
            out = held.advanced(rows, alpha, beta, most, now)
        if idle_ms:
            held = held.kept(held.seen + idle_ms > now)
        if len(held.clip):
            state.update(held.columns())
            if idle_ms:
                state.setTimeoutDuration(int(held.seen.min()) + idle_ms - now)
        elif state.exists:
            state.remove()
        if out is not None:
            yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    # nulls travel as flags: beside them whole numbers would be doubles
    known, placed = F.col("clip").isNotNull(), F.col("i").isNotNull()
    dealt = stream.select(F.pmod(F.xxhash64("clip"), F.lit(shards)).alias("shard"), known.alias("known"), F.coalesce("clip", F.lit(0)).cast("long").alias("clip"), placed.alias("placed"), F.coalesce("i", F.lit(0)).cast("long").alias("i"), F.col("llr").cast("double").alias("llr"))
    out = dealt.groupBy("shard").applyInPandasWithState(step, "known boolean, clip long, placed boolean, i long, k int, lambda double, verdict string", Sessions.TYPES, "append", timeout)
    return out.select(F.when(F.col("known"), F.col("clip")).alias("clip"), F.when(F.col("placed"), F.col("i")).alias("i"), "k", "lambda", "verdict")


@dataclass
class Sessions:
    """Sequential tests side by side, by rising (known, clip): rows seen, sum of the ratios until the verdict, the verdict's
    place in VERDICTS, when a row was last seen."""

    known: np.ndarray
    clip: np.ndarray
    k: np.ndarray
    total: np.ndarray
    verdict: np.ndarray
    seen: np.ndarray

    TYPES: ClassVar[str] = "known array<boolean>, clip array<long>, k array<int>, total array<double>, verdict array<int>, seen array<long>"
    VERDICTS: ClassVar[tuple[str, ...]] = ("pending", "suspicious", "normal", "undecided")

    @classmethod
    def of(cls, columns: tuple | None) -> Sessions:
        kinds = (bool, np.int64, np.int64, float, np.int64, np.int64)
        return cls(*(np.asarray(c, t) for c, t in zip(columns or ([],) * 6, kinds, strict=True)))

    def columns(self) -> tuple:
        return tuple(getattr(self, f.name).tolist() for f in fields(self))

    def kept(self, which: np.ndarray) -> Sessions:
        return Sessions(*(getattr(self, f.name)[which] for f in fields(self)))

    def advanced(self, rows: pd.DataFrame, alpha: float, beta: float, most: int, now: int) -> pd.DataFrame:
        """What the rows (by rising known, clip and place) give; the sessions are then those after them."""
        upper, lower = barriers(alpha, beta)
        known, clip, llr = rows["known"].to_numpy(bool), rows["clip"].to_numpy(np.int64), rows["llr"].to_numpy(float)
        new = np.concatenate(([True], (np.diff(clip) != 0) | (known[1:] != known[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(clip)))
        # the sessions held and those of the rows in one order; `own` are the latter
        both = np.lexsort((np.concatenate((self.clip, clip[first])), np.concatenate((self.known, known[first]))))
        a, b = np.concatenate((self.clip, clip[first]))[both], np.concatenate((self.known, known[first]))[both]
        place = np.cumsum(np.concatenate(([True], (np.diff(a) != 0) | (b[1:] != b[:-1])))) - 1
        at = np.empty(len(both), np.int64)
        at[both] = place
        n, old, own = int(place[-1]) + 1, at[: len(self.clip)], at[len(self.clip) :]

        def merged(held: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
            out = np.zeros(n, held.dtype)
            out[old] = held
            if given is not None:
                out[own] = given
            return out

        self.known, self.clip, self.seen = merged(self.known, known[first]), merged(self.clip, clip[first]), merged(self.seen, np.int64(now))
        self.k, self.total, self.verdict = merged(self.k), merged(self.total), merged(self.verdict)
        totals, verdicts = np.empty(len(clip)), np.empty(len(clip), np.int64)
        k = np.repeat(self.k[own], size) + np.arange(len(clip)) - np.repeat(first, size) + 1
        total, verdict = self.total[own], self.verdict[own]
        by_size = np.argsort(-size, kind="stable")  # sessions that have a row left in a round come first
        many, j = len(by_size), 0
        while many:
            some = by_size[:many]
            row = first[some] + j
            on = some[verdict[some] == 0]
            at_on = first[on] + j
            total[on] += llr[at_on]
            verdict[on] = np.select([total[on] >= upper, total[on] <= lower, k[at_on] >= most], [1, 2, 3], 0)
            totals[row], verdicts[row] = total[some], verdict[some]
            j += 1
            many = int(np.searchsorted(-size[by_size], -j, "left"))
            if not (verdict[by_size[:many]] == 0).any():
                break
        if many:  # all are decided: what is left repeats it
            of = np.repeat(np.arange(len(size)), size)
            left = np.arange(len(clip)) - first[of] >= j
            totals[left], verdicts[left] = total[of[left]], verdict[of[left]]
        self.k[own] += size
        self.total[own], self.verdict[own] = total, verdict
        return pd.DataFrame({"known": known, "clip": clip, "placed": rows["placed"].to_numpy(bool), "i": rows["i"].to_numpy(np.int64), "k": k, "lambda": totals, "verdict": np.array(self.VERDICTS, object)[verdicts]})


def streaming_segments(stream: DataFrame, quota: int = 50, least: float = 0.5, idle_ms: int | None = 60_000, patience: int = 500) -> DataFrame:
    """stream: clip long, i long (from 0, without gaps), speech boolean, x double -> clip, seg, n, mean: each `quota`
    speech frames of a session, as they fill up. Frames that come before their turn wait for those before them, until more
    than `patience` wait; a frame that comes after that is left out. A session
    without frames for idle_ms (None: none) ends: what waits counts, and a last segment of least * quota frames or more is
    given. A stream with a timeout never comes to an end of its own."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seg, at, held, places, speech, values = state.get if state.exists else (0, 0, [], [], [], [])
        waiting = dict(zip(places, zip(speech, values, strict=True), strict=True))
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            waiting |= {int(i): (bool(s), float(x)) for i, s, x in zip(rows["i"], rows["speech"], rows["x"], strict=True) if i >= at}
        held, out = list(held), []
        for k, i in enumerate(sorted(waiting)):
            if i != at and not state.hasTimedOut and len(waiting) - k <= patience:
                break
            if waiting[i][0]:
                held.append(waiting[i][1])
            at = i + 1
        waiting = {i: v for i, v in waiting.items() if i >= at}
        while len(held) >= quota or state.hasTimedOut and held and len(held) >= least * quota:
            part, held = held[:quota], held[quota:]
            out.append((key[0], seg, len(part), sum(part) / len(part)))
            seg += 1
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((seg, at, held, list(waiting), [v[0] for v in waiting.values()], [v[1] for v in waiting.values()]))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["clip", "seg", "n", "mean"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("clip").applyInPandasWithState(step, "clip long, seg int, n int, mean double", "seg int, at long, held array<double>, places array<long>, speech array<boolean>, x array<double>", "append", timeout)
