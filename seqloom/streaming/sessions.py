"""Live sessions: numbered messages of 16-bit samples, of which some are late, doubled or lost, become a gapless log of events.

A reorder buffer holds messages that come before their turn. A gap is given up when the first message that waits behind it
has waited `gap_ms`, or when `most_waiting` wait; what comes later for it counts as late. Time is the messages' arrival
time: a later message of the session shows that it has passed, and where none comes an event-time timer does. Either way the
same messages make the same events, however they are cut into batches.

A session's state is bounded: at most `most_waiting` messages, one incomplete frame, fewer speech frames than a segment
holds, and a few numbers. `call_ended`, or `idle_ms` without a message, ends it: a last half segment is scored, the state goes, and for
`keep_ms` only the event's number is kept, so that stragglers open no new session. (Spark has time-to-live
of state under processing time only; these are timers in event time.)"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .scoring import Scorer

EVENTS = "event long, type string, at_ms long, seg int, t double, s1 double, s2 double, llr double, lambda double, verdict string, lost long, late long"
COLUMNS = ["event", "type", "at_ms", "seg", "t", "s1", "s2", "llr", "lambda", "verdict", "lost", "late"]
HEAD = "next long, lost long, late_messages long, carry binary, seg int, lambda double, verdict string, late double, event long, last_ms long, timer long, closed boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Reorder:
    """next: the number whose turn it is; waiting: number -> (arrival, what came); lost: numbers given up; late: messages
    after their turn or doubled."""

    gap_ms: int = 60
    most: int = 64
    next: int = 0
    lost: int = 0
    late: int = 0
    waiting: dict[int, tuple[int, bytes]] = field(default_factory=dict)

    def due(self) -> int | None:
        """When the gap ahead is given up."""
        return min(at for at, _ in self.waiting.values()) + self.gap_ms if self.waiting else None

    def _ready(self, skip: bool = False) -> Iterator[tuple[int, bytes]]:
        if skip and self.waiting:
            first = min(self.waiting)
            self.lost += first - self.next
            self.next = first
        while self.next in self.waiting:
            yield self.next, self.waiting.pop(self.next)[1]
            self.next += 1

    def tick(self, now: int) -> Iterator[tuple[int, int, bytes]]:
        """(time, number, what came) of messages whose turn comes by `now`."""
        while (due := self.due()) is not None and due <= now:
            yield from ((due, n, p) for n, p in self._ready(skip=True))

    def push(self, at: int, number: int, what: bytes) -> Iterator[tuple[int, int, bytes]]:
        yield from self.tick(at)
        if number < self.next or number in self.waiting:
            self.late += 1
            return
        self.waiting[number] = (at, what)
        yield from ((at, n, p) for n, p in self._ready())
        while len(self.waiting) > self.most:
            yield from ((at, n, p) for n, p in self._ready(skip=True))

    def flush(self, at: int) -> Iterator[tuple[int, int, bytes]]:
        while self.waiting:
            yield from ((at, n, p) for n, p in self._ready(skip=True))


@dataclass(frozen=True)
class Rules:
    scorer: Scorer
    gap_ms: int = 60
    most_waiting: int = 64
    idle_ms: int = 60_000
    keep_ms: int = 3_600_000


class Session:
    """One session's steps. `state` is what its scorer keeps."""

    def __init__(self, rules: Rules):
        self.rules, self.order, self.state = rules, Reorder(rules.gap_ms, rules.most_waiting), rules.scorer.start()
        self.event, self.last_ms, self.closed, self.log = 0, 0, False, []

    def _tell(self, kind: str, at: int, row: tuple = (None,) * 7) -> None:
        self.log.append((self.event, kind, at, *row, self.order.lost, self.order.late))
        self.event += 1

    def _score(self, ready: Iterator[tuple[int, int, bytes]]) -> None:
        for at, _, pcm in ready:
            self._rows(at, self.rules.scorer.feed(self.state, bytes(pcm)))

    def _rows(self, at: int, rows: list[tuple]) -> None:
        for row in rows:
            told = self.state["told"] if "told" in self.state else "pending"
            self._tell("window", at, row)
            if row[6] != "pending" and told == "pending":
                self._tell("verdict", at, row)
            self.state["told"] = row[6]

    def message(self, at: int, number: int | None, kind: str, pcm: bytes | None) -> None:
        if self.closed:
            return
        self.last_ms = max(self.last_ms, at)
        if kind == "pcm":
            self._score(self.order.push(at, number, pcm or b""))
            return
        self._score(self.order.tick(at))
        if kind == "call_ended":
            self.end(at)
        else:
            self._tell(kind, at)

    def tick(self, now: int) -> None:
        if not self.closed:
            self._score(self.order.tick(now))
            if now >= self.last_ms + self.rules.idle_ms:
                self.end(now)

    def end(self, at: int) -> None:
        self._score(self.order.flush(at))
        self._rows(at, self.rules.scorer.feed(self.state, b"", end=True))
        self._tell("call_ended", at)
        self.closed, self.state = True, self.rules.scorer.start()

    def taken(self) -> list[tuple]:
        out, self.log = self.log, []
        return out


def _frame(key: object, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS).astype({"seg": "Int32", "t": float, "s1": float, "s2": float, "llr": float, "lambda": float})
    out.insert(0, "session", key)
    return out


def _in_order(pdf: pd.DataFrame) -> Iterator[tuple]:
    """(at_ms, seq, kind, pcm) by arrival; at the same time samples come before other messages."""
    rows = ((int(a), None if pd.isna(s) else int(s), k, None if p is None else bytes(p)) for a, s, k, p in zip(pdf["at_ms"], pdf["seq"], pdf["kind"], pdf["pcm"], strict=True))
    return iter(sorted(rows, key=lambda r: (r[0], r[2] != "pcm", r[2], -1 if r[1] is None else r[1])))


class SessionProcessor(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.waiting = handle.getMapState("waiting", "seq long", "at_ms long, pcm binary")
        self.held = handle.getListState("held", "samples binary")

    def _load(self) -> tuple[Session, dict, int]:
        s = Session(self.rules)
        if not self.head.exists():
            return s, {}, 0
        o = s.order
        o.next, o.lost, o.late, carry, seg, total, verdict, late, s.event, s.last_ms, timer, s.closed = self.head.get()
        o.waiting = {int(k[0]): (int(v[0]), bytes(v[1])) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        held = b"".join(bytes(r[0]) for r in self.held.get()) if self.held.exists() else b""
        s.state |= {"carry": bytes(carry), "seg": seg, "lambda": total, "verdict": verdict, "late": late, "told": verdict, "held": np.frombuffer(held, np.float32)}
        return s, dict(o.waiting), timer

    def _save(self, s: Session, before: dict, timer: int, now: int) -> None:
        for k in before.keys() - s.order.waiting.keys():
            self.waiting.removeKey((k,))
        for k in s.order.waiting.keys() - before.keys():
            self.waiting.updateValue((k,), s.order.waiting[k])
        x = s.state
        self.held.put([(x["held"].astype(np.float32).tobytes(),)]) if len(x["held"]) else self.held.clear()
        if s.closed:
            wanted = s.last_ms + self.rules.keep_ms
        else:
            wanted = min(t for t in (s.order.due(), s.last_ms + self.rules.idle_ms) if t is not None)
        wanted = max(wanted, now + 1)
        if wanted != timer:  # one timer a session
            if timer > now:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        o = s.order
        self.head.update((o.next, o.lost, o.late, x["carry"], x["seg"], float(x["lambda"]), x["verdict"], x["late"], s.event, s.last_ms, wanted, s.closed))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, before, timer = self._load()
        for r in _in_order(pd.concat(list(rows))):
            s.message(*r)
        self._save(s, before, timer, timerValues.getCurrentWatermarkInMs())
        yield _frame(key[0], s.taken())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        s, before, _ = self._load()
        if s.closed:
            self.head.clear()
            self.waiting.clear()
            self.held.clear()
            return
        s.tick(now)
        self._save(s, before, now, max(now, timerValues.getCurrentWatermarkInMs()))
        yield _frame(key[0], s.taken())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> str | None:
    """State with maps, lists and timers needs this store; gives the setting that was there, to put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    return before


def session_events(stream: DataFrame, rules: Rules, delay: str = "1 second") -> DataFrame:
    """stream: session, seq long, at timestamp (arrival), kind (pcm, call_ended, or another event's name), pcm binary ->
    session and the columns of EVENTS. Rows that come more than `delay` behind the latest arrival of all sessions are
    dropped by Spark; it must cover how unevenly the sources are read. Needs use_rocksdb."""
    kind = stream.schema["session"].dataType.simpleString()
    rows = stream.withWatermark("at", delay).select("session", "seq", F.unix_millis("at").alias("at_ms"), "kind", "pcm", "at")
    return rows.groupBy("session").transformWithStateInPandas(SessionProcessor(rules), f"session {kind}, {EVENTS}", "append", "eventTime")


def replayed_events(messages: DataFrame, rules: Rules, end: bool = True) -> DataFrame:
    """The same events of messages that are all there. end: sessions that no call_ended closes end when they have been idle."""
    kind = messages.schema["session"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Session(rules)
        for r in _in_order(pdf):
            s.tick(r[0]) if r[0] >= s.last_ms + rules.idle_ms and s.last_ms else None
            s.message(*r)
        if end:
            due = s.order.due()
            if due is not None:
                s.tick(due)
            s.tick(s.last_ms + rules.idle_ms)
        return _frame(pdf["session"].iloc[0], s.taken())

    rows = messages.select("session", "seq", F.unix_millis("at").alias("at_ms"), "kind", "pcm")
    return rows.groupBy("session").applyInPandas(run, f"session {kind}, {EVENTS}")


def since(events: DataFrame, k: int) -> DataFrame:
    """The events of the log from number k on."""
    return events.where(F.col("event") >= k)
