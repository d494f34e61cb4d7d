"""Live sessions against a plain loop: lost, late and doubled messages, timers, bounded state."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import detector
from seqloom.streaming import scoring, sessions

SCORER = scoring.Scorer(sr=800, model=detector.Linear([0.0] * 40, [1.0] * 40, [0.01] * 40, 0.0), fusion=(0.01, 0.0, 0.9), quota=10)
RULES = sessions.Rules(SCORER, idle_ms=2_000, keep_ms=20_000)


def spoken(n, seed):
    return [(np.random.default_rng([seed, k]).normal(size=160) * 8000).clip(-32768, 32767).astype("<i2").tobytes() for k in range(n)]


def sent(session, n, seed, lost=(), late=None, doubled=(), end=True, start=0):
    """Messages of 200 ms each: (session, seq, at_ms, kind, pcm)."""
    late, rows = late or {}, []
    for k, pcm in enumerate(spoken(n, seed)):
        if k in lost:
            continue
        at = start + 200 * k + late.get(k, 0)
        rows.append((session, k, at, "pcm", pcm))
        if k in doubled:
            rows.append((session, k, at + 20, "pcm", pcm))
    rows.append((session, None, start + 333, "sms", None))
    if end:
        rows.append((session, None, start + 200 * n, "call_ended", None))
    return rows


def frame(spark, rows):
    t = spark.createDataFrame(rows, "session string, seq long, at_ms long, kind string, pcm binary")
    return t.select("session", "seq", "kind", "pcm", F.timestamp_millis(F.col("at_ms") + 10**12).alias("at"))


CASES = [*sent("plain", 12, 1), *sent("lost", 15, 2, lost={4, 5, 9}), *sent("late", 12, 3, late={3: 230, 6: 290}), *sent("doubled", 12, 4, doubled={2, 7}), *sent("idle", 7, 5, end=False), *sent("gap_at_end", 6, 6, lost={4}, end=False)]


def looped(rows, rules):
    """The rules as prose has them: a message counts when its turn comes, or when the first that waits has waited 60 ms."""
    arrivals, out = sorted(rows, key=lambda r: (r[2], r[3] != "pcm", r[1] or 0)), []
    turn, waiting, gone = 0, {}, set()
    for _, seq, at, kind, _ in arrivals + [(None, None, 10**9, "stop", None)]:
        while waiting and min(waiting.values()) + rules.gap_ms <= at:
            due = min(waiting.values()) + rules.gap_ms
            turn = min(waiting)
            while turn in waiting:
                waiting.pop(turn)
                out.append((due, turn))
                turn += 1
        if kind == "call_ended":
            for k in sorted(waiting):
                out.append((at, k))
            return out
        if kind == "pcm" and seq >= turn and seq not in waiting and seq not in gone:
            waiting[seq] = at
            while turn in waiting:
                waiting.pop(turn)
                out.append((at, turn))
                turn += 1
    return out


def test_reorder_equals_the_rules():
    rng = random.Random(1)
    for _ in range(300):
        rows = [("s", k, 20 * k + rng.choice((0, 0, 0, 15, 45, 90, 200)), "pcm", b"") for k in range(40) if rng.random() > 0.1]
        rows += [r for r in rows if rng.random() < 0.1]
        order, got = sessions.Reorder(60, 1000), []
        for r in sorted(rows, key=lambda r: (r[2], r[1])):
            got += [(at, n) for at, n, _ in order.push(r[2], r[1], b"")]
        got += [(at, n) for at, n, _ in order.tick(10**9)]
        assert got == looped(rows, RULES) and not order.waiting
        assert order.lost + len(got) == max(n for _, n in got) + 1


def test_waiting_is_bounded_and_a_gap_costs_its_bound():
    order = sessions.Reorder(60, 16)
    most = 0
    for k in range(1, 500):  # number 0 never comes
        list(order.push(k, k, b""))
        most = max(most, len(order.waiting))
    assert most <= 17 and order.lost == 1
    s = sessions.Session(RULES)
    for _, seq, at, kind, pcm in sent("x", 12, 1, lost={4}):
        s.message(at, seq, kind, pcm)
    whole = sessions.Session(RULES)
    for _, seq, at, kind, pcm in sent("x", 12, 1):
        whole.message(at, seq, kind, pcm)
    # message 5 comes at 1000 and waits 60 ms for the lost one
    ended = [e[2] for e in s.taken() if e[1] == "window"], [e[2] for e in whole.taken() if e[1] == "window"]
    assert ended[1] == [200 * k for k in range(12)]
    assert ended[0] == [200 * k + 60 * (k == 5) for k in range(12) if k != 4]


def test_scorer_gives_up_a_gap():
    state = SCORER.start()
    rows = SCORER.advance(state, [(k, p) for k, p in enumerate(spoken(500, 1)) if k != 6])
    assert len(state["waiting"]) == 0 or len(state["waiting"]) <= SCORER.patience
    assert len(rows) > 200


@pytest.mark.parametrize("cut", [1, 3])
def test_stream_equals_the_loop(spark, tmp_path, cut):
    batch = frame(spark, CASES)
    key = lambda t: sorted((r["session"], r["event"], r["type"], r["at_ms"], r["seg"], r["lambda"], r["verdict"], r["lost"], r["late"]) for r in t.collect())
    want = key(sessions.replayed_events(batch, RULES))
    assert {r[0] for r in want} == {r[0] for r in CASES} and any(r[2] == "verdict" for r in want)
    per = {s: [e for e in want if e[0] == s] for s in {r[0] for r in CASES}}
    for s, rows in per.items():
        assert [r[1] for r in rows] == list(range(len(rows)))  # a gapless log
        assert sum(r[2] == "call_ended" for r in rows) == 1 and sum(r[2] == "sms" for r in rows) == 1
    assert [per[s][-1][7] for s in ("plain", "lost", "late", "doubled")] == [0, 3, 1, 0]
    assert [per[s][-1][8] for s in ("plain", "lost", "late", "doubled")] == [0, 0, 1, 2]  # 30 ms are waited for, 90 are not
    # the stream: files in order of arrival, then a last session whose time lets all timers pass
    arrivals = sorted(CASES, key=lambda r: r[2])
    n = len(arrivals) // (4 * cut) + 1
    parts = [arrivals[k : k + n] for k in range(0, len(arrivals), n)] + [[("clock", 0, 100_000 + 40_000 * k, "pcm", b"")] for k in range(3)]
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
        for f in (tmp_path / "in" / f"{k:03d}").glob("part-*"):
            f.rename(tmp_path / f"{k:03d}.parquet")
    (tmp_path / "files").mkdir()
    for k in range(len(parts)):
        os.rename(tmp_path / f"{k:03d}.parquet", tmp_path / "files" / f"{k:03d}.parquet")
        os.utime(tmp_path / "files" / f"{k:03d}.parquet", (time.time() - 100 + k,) * 2)
    before = sessions.use_rocksdb(spark)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
    out = scoring.finished(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda s: sessions.session_events(s, RULES))
    spark.conf.set(sessions.PROVIDER, before) if before else spark.conf.unset(sessions.PROVIDER)
    got = out.where("session <> 'clock'")
    assert key(got) == want
    assert sessions.since(got.where("session = 'lost'"), 3).count() == len(per["lost"]) - 3
