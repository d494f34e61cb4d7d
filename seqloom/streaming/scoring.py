"""Scoring of live sessions: messages of 16-bit samples become frames, frames of speech become segments, segments get
their two scores, a likelihood ratio and a sequential verdict. A file is replayed through the same steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import barriers
from ..operators import predictors, signal
from ..operators.detector import Linear
from ..operators.evaluation import REDUCED

OUT = "seg int, t double, s1 double, s2 double, llr double, lambda double, verdict string"
STATE = "next long, waiting array<struct<seq:bigint,pcm:binary>>, carry binary, held array<float>, seg int, lambda double, verdict string, late double"


@dataclass(frozen=True)
class Scorer:
    """sr; model: of s1, none gives no s1; profile: check -> (centre, scale) of s2, none gives no s2; fusion: weights of
    (s1, s2) and the intercept; gate: least mean square of a speech frame; wait: a segment has its own s2, not that of the one before; patience: so many messages wait for a missing one, no more."""

    sr: int = 8000
    model: Linear | None = None
    profile: dict[str, tuple[float, float]] | None = None
    fusion: tuple[float, float, float] = (0.5, 0.5, 0.0)
    patience: int = 64
    gate: float = 1e-6
    wait: bool = False
    alpha: float = 0.01
    beta: float = 0.05
    most: int = 60
    quota: int = 50
    seed: int = 42

    @property
    def frame(self) -> int:
        return self.sr // 50

    def s1(self, x: np.ndarray) -> float | None:
        if self.model is None:
            return None
        frames = x[: len(x) // self.frame * self.frame].reshape(-1, self.frame)
        c = signal.lfcc(frames, self.sr, len(self.model.mean) // 2)
        v = (np.concatenate((c.mean(axis=0), c.std(axis=0))) - self.model.mean) / self.model.scale
        most = np.log((1 - 1e-7) / 1e-7)
        return float(np.clip(v @ np.asarray(self.model.weights) + self.model.intercept, -most, most))

    def s2(self, x: np.ndarray) -> float | None:
        if self.profile is None:
            return None
        bits, out = signal.bits_of(signal.residual_of(x, self.frame, 16 if self.sr >= 16000 else 10), self.frame), [0.0]
        for mode, w, direction in REDUCED:
            delta, _ = (predictors.bit_delta if mode == "bit" else predictors.block_delta)(bits, w, self.seed, most=5000)
            if delta is not None:
                centre, scale = self.profile.get(f"A_{mode}_w{w}_{direction}", (0.0, 1.0))
                out.append(abs(delta - centre) / max(scale, 1e-9))
        return max(out)

    def segment(self, x: np.ndarray, state: dict) -> tuple:
        s1, own = self.s1(x), self.s2(x)
        s2 = own if self.wait else state["late"]
        state["late"] = own
        state["seg"] += 1
        a, b, c = self.fusion
        llr = a * (s1 or 0.0) + b * (s2 or 0.0) + c
        if state["verdict"] == "pending":
            upper, lower = barriers(self.alpha, self.beta)
            state["lambda"] += llr
            total = state["lambda"]
            state["verdict"] = "suspicious" if total >= upper else "normal" if total <= lower else "undecided" if state["seg"] >= self.most else "pending"
        return state["seg"] - 1, float(state["seg"]), s1, s2, llr, state["lambda"], state["verdict"]

    def start(self) -> dict:
        return {"next": 0, "waiting": [], "carry": b"", "held": np.zeros(0, np.float32), "seg": 0, "lambda": 0.0, "verdict": "pending", "late": None}

    def advance(self, state: dict, messages: list[tuple[int, bytes]], end: bool = False) -> list[tuple]:
        """Rows of the segments that the messages complete. Messages count in the order of their numbers, from 0: one that
        comes before its turn waits, until it is its turn or more than `patience` wait; what comes after that is left out.
        At the end what waits counts, and a last segment of half the quota or more."""
        waiting = sorted({**dict(state["waiting"]), **{s: p for s, p in messages if s >= state["next"]}}.items())
        data, k = [], 0
        while k < len(waiting) and (end or waiting[k][0] == state["next"] or len(waiting) - k > self.patience):
            state["next"] = waiting[k][0] + 1
            data.append(bytes(waiting[k][1]))
            k += 1
        state["waiting"] = waiting[k:]
        return self.feed(state, b"".join(data), end)

    def feed(self, state: dict, pcm: bytes, end: bool = False) -> list[tuple]:
        """The same of samples that are in order."""
        raw, size = state["carry"] + pcm, 2 * self.frame
        whole = len(raw) // size * size
        state["carry"] = raw[whole:]
        frames = (np.frombuffer(raw[:whole], "<i2") / 32768).astype(np.float32).reshape(-1, self.frame)
        speech = frames[(frames.astype(float) ** 2).mean(axis=1) >= self.gate] if len(frames) else frames
        held, step, out = np.concatenate((state["held"], speech.ravel())), self.quota * self.frame, []
        while len(held) >= step or end and len(held) >= step / 2:
            out.append(self.segment(held[:step].astype(float), state))
            held = held[step:]
        state["held"] = held
        return out


def _rows(name: str, key: object, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["seg", "t", "s1", "s2", "llr", "lambda", "verdict"])
    out.insert(0, name, key)
    return out.astype({"s1": float, "s2": float})


def streaming_scores(stream: DataFrame, scorer: Scorer, idle_ms: int = 60_000) -> DataFrame:
    """stream: clip long, seq long, pcm binary -> clip and the columns of OUT. A session without messages for idle_ms ends."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields = ["next", "waiting", "carry", "held", "seg", "lambda", "verdict", "late"]
        own = dict(zip(fields, state.get, strict=True)) if state.exists else scorer.start()
        own["held"] = np.asarray(own["held"], np.float32)
        own["waiting"] = [tuple(w.values()) if isinstance(w, dict) else tuple(w) for w in own["waiting"]]
        own["waiting"] = [(int(s), bytes(p)) for s, p in own["waiting"]]
        own["carry"] = bytes(own["carry"])
        if state.hasTimedOut:
            out = scorer.advance(own, [], end=True)
            state.remove()
        else:
            rows = pd.concat(list(batches))
            out = scorer.advance(own, [(int(s), bytes(p)) for s, p in zip(rows["seq"], rows["pcm"], strict=True)])
            own["held"], own["waiting"] = own["held"].tolist(), [{"seq": s, "pcm": p} for s, p in own["waiting"]]
            state.update(tuple(own[f] for f in fields))
            state.setTimeoutDuration(idle_ms)
        yield _rows("clip", key[0], out)

    return stream.groupBy("clip").applyInPandasWithState(step, f"clip long, {OUT}", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def replayed(messages: DataFrame, scorer: Scorer) -> DataFrame:
    """The same columns for whole sessions (clip, seq, pcm) at once."""
    kind = messages.schema["clip"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = scorer.start()
        rows = scorer.advance(own, [(int(s), bytes(p)) for s, p in zip(pdf["seq"], pdf["pcm"], strict=True)], end=True)
        return _rows("clip", pdf["clip"].iloc[0], rows)

    return messages.groupBy("clip").applyInPandas(run, f"clip {kind}, {OUT}")


def messages_of(clips: DataFrame, samples: int = 800) -> DataFrame:
    """clip, seq, pcm: 16-bit messages of clips (clip, samples)."""
    kind = clips.schema["clip"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                pcm = np.clip(np.asarray(r.samples if r.samples is not None else [], float) * 32768, -32768, 32767).astype("<i2")
                parts = [pcm[k : k + samples].tobytes() for k in range(0, len(pcm), samples)]
                yield pd.DataFrame({"clip": [r.clip] * len(parts), "seq": range(len(parts)), "pcm": parts})

    return clips.select("clip", "samples").mapInPandas(run, f"clip {kind}, seq long, pcm binary")


def finished(stream: DataFrame, path: str, checkpoint: str, start: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over all that is there, into Parquet, and reads it back. start must set no timeout: with one a stream never comes to its end."""
    out = start(stream)
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(path)
