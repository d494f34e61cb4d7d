"""Channels over live streams of frames: noise, codec, loss and concealment, frame by frame.

Noise and codec depend on a frame alone and are columns. Draws depend on clip, frame and seed, not on a generator's
position, so that they are the batch's whatever the batches. What goes from frame to frame is kept in state: the last
good frame, how many are lost since, whether a burst goes on, and the number whose turn it is. State that no frame has touched for
`ttl_ms` goes (time-to-live, under processing time, with which a stream never comes to an end of its own)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.channel import ATTENUATION_DB, FADE, coded_frames, uniform

OUT = "frame long, lost int, y array<double>"
STATE = "next long, good binary, k int, burst int"


@dataclass(frozen=True)
class Loss:
    """frame: samples of a frame. pct of frames are lost; stay: the chance that a lost one is followed by a good one, none for losses without memory."""

    frame: int
    pct: float = 0.0
    stay: float | None = None

    def lost(self, u: float, before: int) -> bool:
        """before: whether the frame before was lost, -1 for the first."""
        share = self.pct / 100
        if self.stay is None or share <= 0 or share >= 1 or before < 0:
            return u < share
        fail = min(1.0, max(1e-6, share * self.stay / (1 - share)))
        return u >= self.stay if before else u < fail


class Channel:
    """The state of one clip, and its steps."""

    def __init__(self, loss: Loss, next_: int = 0, good: bytes = b"", k: int = 0, burst: int = -1):
        self.loss, self.next, self.k, self.burst = loss, next_, k, burst
        self.good = np.frombuffer(good, float)

    def saved(self) -> tuple:
        return self.next, self.good.tobytes(), self.k, self.burst

    def _conceal(self, n: int) -> np.ndarray:
        self.k += 1
        fade = min(FADE, self.loss.frame // 4)
        y = np.zeros(n)
        y[: len(self.good)] = self.good[:n] * 10 ** (-ATTENUATION_DB * self.k / 20)
        if self.k == 1 and len(self.good):
            a = np.arange(min(fade, n)) / max(fade - 1, 1)
            tail = self.good[self.loss.frame - fade :][: len(a)]
            y[: len(a)] = (1 - a) * np.pad(tail, (0, len(a) - len(tail))) + a * y[: len(a)]
        return y

    def push(self, frame: int, x: np.ndarray, u: float, lost: float | None) -> list[tuple[int, int, np.ndarray]]:
        """The frame, after those that never came, which are lost ones; nothing for a frame whose turn is over."""
        if frame < self.next:
            return []
        out = [(k, 1, self._conceal(self.loss.frame)) for k in range(self.next, frame)]
        self.next = frame + 1
        gone = bool(lost) if lost is not None else self.loss.lost(u, self.burst)
        self.burst = int(gone)
        if gone:
            y = self._conceal(len(x))
        else:
            self.good, self.k, y = x, 0, x
        return [*out, (frame, int(gone), np.clip(y, -1, 1) if lost is None else y)]


class ChannelProcessor(StatefulProcessor):
    def __init__(self, loss: Loss, ttl_ms: int | None):
        self.loss, self.ttl_ms = loss, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("channel", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = Channel(self.loss, *(v if not isinstance(v, bytearray) else bytes(v) for v in self.state.get())) if self.state.exists() else Channel(self.loss)
        yield _through(own, key[0], pd.concat(list(rows)))
        self.state.update(own.saved())

    def close(self) -> None:
        pass


def _through(own: Channel, clip: object, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, out = pdf.sort_values("frame", kind="stable"), []
    for frame, x, u, lost in zip(pdf["frame"], pdf["x"], pdf["u"], pdf["lost"], strict=True):
        out += own.push(int(frame), np.asarray(x, float), float(u), None if pd.isna(lost) else lost)
    table = pd.DataFrame(out, columns=["frame", "lost", "y"])
    table.insert(0, "clip", clip)
    return table


def streaming_channel(frames: DataFrame, codec: str, loss: Loss, snr_db: float | None = None, lost: str | None = None, seed: int = 42, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """frames (a stream): clip, frame long (rising from batch to batch), x array<double> -> clip, frame, lost, y of the
    same samples after noise, codec and loss; `lost` names a column of losses that are given, whose samples keep their
    range. Frames that never come are lost ones. Needs the RocksDB state store (sessions.use_rocksdb)."""
    kind = frames.schema["clip"].dataType.simpleString()
    given = F.lit(None).cast("double") if lost is None else F.col(lost).cast("double")
    rows = coded_frames(frames.withColumn("_lost", given), codec, snr_db, seed).select("clip", "frame", "x", uniform("clip", "frame", seed=seed).alias("u"), F.col("_lost").alias("lost"))
    return rows.groupBy("clip").transformWithStateInPandas(ChannelProcessor(loss, ttl_ms), f"clip {kind}, {OUT}", "append", "processingTime" if ttl_ms else "none")
