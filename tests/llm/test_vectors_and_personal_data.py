import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from seqloom.llm import delta_lloyd, hard_negatives, personal_data

VECTORS = "vec_id long, embedding array<float>, label int, x int, cell string, owner string"


def rows_of(n, size=64, seed=1, hot=0.0):
    """Vectors around a few centres, with extra columns whose names clash; `hot`: the share that is one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, size))
    out = []
    for i in range(n):
        v = centres[0] if rng.random() < hot else centres[rng.integers(7)] * 0.3 + rng.normal(size=size) * 0.2
        out.append((i, [float(np.float32(c)) for c in v], int(rng.integers(10)), 1, "c", "o"))
    return out


ODD = [
    (9001, None, 1, 0, "", ""), (9002, [], 1, 0, "", ""), (9003, [0.5] * 63, 1, 0, "", ""), (9004, [0.5] * 63 + [None], 2, 0, "", ""),
    (9005, [float("nan")] * 64, 2, 0, "", ""), (9006, [float("inf")] + [0.1] * 63, 3, 0, "", ""), (9007, [0.0] * 64, None, 0, "", ""), (None, [0.25] * 64, 3, 0, "", ""),
]


def lloyd(vectors, k=16, rounds=3):
    """The same by full passes in whole numbers of Python."""
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in vectors if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, owners, strict=True) if o == j]
            if own:
                c[j] = [sum(t) // len(own) for t in zip(*own, strict=True)]
    return sorted(((i is None, i or 0), *nearest(v)[::-1]) for i, v in kept), c


@pytest.mark.parametrize(("n", "hot"), [(400, 0.0), (300, 0.4), (5, 0.0)])
def test_clusters_equal_full_passes(spark, n, hot):
    rows = rows_of(n, hot=hot) + ODD + rows_of(20)  # repeated rows are vectors each
    want, c = lloyd([r[:2] for r in rows])
    state, got = delta_lloyd.cluster(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert got.astype(int).tolist() == c
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["owner"], r["distance"]) for r in state.collect()) == want


def test_only_changed_centroids_and_moved_owners_are_compared():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-40, 40, (500, 8)).astype(float), rng.integers(-40, 40, (6, 8)).astype(float)
    owner, distance = delta_lloyd.reassigned(x, np.full(500, -1), np.zeros(500), c, np.arange(6))
    for changed in ([], [2], [0, 5], [1, 2, 3]):
        fresh = c.copy()
        fresh[changed] += rng.integers(-9, 9, (len(changed), 8))
        got = delta_lloyd.reassigned(x, owner, distance, fresh, np.array(changed, int))
        full = ((x[:, None] - fresh) ** 2).sum(axis=2)
        assert (got[0] == full.argmin(axis=1)).all() and (got[1] == full.min(axis=1)).all()


def test_clusters_of_nothing(spark):
    state, c = delta_lloyd.cluster(spark.createDataFrame(ODD[:7], VECTORS).where("vec_id < 9007"))
    assert state.count() == 0 and len(c) == 0
    assert delta_lloyd.cluster(spark.createDataFrame([], VECTORS))[0].count() == 0
    big = spark.createDataFrame([(1, [1e30] * 64, 1, 0, "", ""), (2, [-1e30] * 64, 1, 0, "", "")], VECTORS)
    assert sorted(r["distance"] for r in delta_lloyd.cluster(big)[0].collect()) == [0, 0]


def mined(rows):
    """All pairs, in whole numbers."""
    kept = [(i, label, [math.floor(256 * c) for c in v]) for i, v, label, *_ in rows if i is not None and v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = sorted({(i, label, tuple(x)) for i, label, x in kept if i % 20 == 0})
    out = []
    for i, label, q in anchors:
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j, other) for j, other, x in kept if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            fits = [(n, -t) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, k, n, -s, t) for k, (n, t) in enumerate(fits[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "hot", "size"), [(600, 0.0, 64), (500, 0.4, 64), (700, 0.0, 3), (8, 0.0, 64)])
def test_hard_negatives_equal_all_pairs(spark, n, hot, size):
    rows = rows_of(n, size, hot=hot) + ODD + rows_of(60, size, seed=5)  # vec_id repeats with other vectors and labels
    vectors = hard_negatives.quantised(spark.createDataFrame(rows, VECTORS).repartition(6), 256)
    got = hard_negatives.mine(vectors, vectors.where("vec_id % 20 = 0"), chunk=16, n_pivots=8, sampled=50)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    none = hard_negatives.quantised(spark.createDataFrame(ODD[3:6], VECTORS), 256)
    assert hard_negatives.mine(none, none).count() == 0
    some = hard_negatives.quantised(spark.createDataFrame(rows_of(30), VECTORS), 256)
    assert hard_negatives.mine(some, some.where("false")).count() == 0
    alone = some.withColumn("label", some["vec_id"])
    assert hard_negatives.mine(alone, alone).count() == 0


def test_pivots_skip_rows_and_lose_none():
    """Rows far apart: the triangle inequality leaves few to multiply out, and the best are the same."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 64)) * 300
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 64)) * 10)
    q = np.floor(centres[:20] + rng.normal(size=(20, 64)) * 10)
    pivots = hard_negatives.choose_pivots(x[::40], float((x * x).sum(axis=1).max()), 20)
    d = pivots.to_rows(x)
    cells = d.argmin(axis=1)
    every = np.full(20, np.inf)
    w = hard_negatives.Wanted(q, np.full(20, -1), np.zeros(20, int), np.arange(20), -every, every, True)
    best, done = hard_negatives.Best(20, 5), 0
    for cell in np.unique(cells):
        own = np.flatnonzero(cells == cell)
        own = own[np.argsort(d[own, cell])]
        to = pivots.to_anchors(q)
        done += hard_negatives.search(x[own], own, np.zeros(len(own), int), d[own], int(cell), w, to, pivots.top, best)
    assert done < 0.3 * 20 * 4000
    scores = q @ x.T
    for k in range(20):
        order = np.lexsort((np.arange(4000), -scores[k]))[:5]
        assert best.id[k].tolist() == order.tolist() and best.score[k].tolist() == scores[k][order].tolist()


CONTRACT = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)
TEXTS = [
    None, "", "nothing here", "mail a.b+c@d.e.f.g@h.i x@y, @z.w, q@-.-. é𝔘 me@ex-ample.org.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 00000000001.2.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 7 , 0000000000000", "+1 (017) 555-7713 +49..30 1234567 +1 2 3 +123456789012345 +1234567890123456 ++12345678901",
    "pay with card 4111 1111 1111 1111 12 27 please", "IBAN DE89 3704 0044 0532 0130 00 OK, GB82WEST12345698765432 and GB83WEST12345698765432", "call me: (030) 1234567 or 555-123-4567; order 555-123-4567",
    "ssn 123-45-6789, invoice 123-45-6780, 000-12-3456", "card 4111.1111.1111.1111 or 1.1.1.1", "a" * 3000 + "@b.c " + "1" * 5000 + " 1" * 3000,
]


def base_of(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, ok in CONTRACT for m in re.finditer(pattern, text) if len(m[0]) < 4000 and ok(m[0])]


def generated(n):
    rng = random.Random(8)
    parts = ["@", ".", "-", " ", "+", "1", "23", "456", "255", "a", "b.c", "@x.y", "4111111111111111", "(", ")", "é", "DE89370400440532013000", " card ", " tel ", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_base_spans_equal_the_patterns(spark, nothing):
    texts = TEXTS + generated(3000)
    t = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, found int, kind string")
    for r in personal_data.find(t).collect():
        base = [f"{x['kind']}:{x['start']}:{x['end']}" for x in r["found"] if x["kind"] in personal_data.BASE]
        assert base == base_of(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
        added = [x for x in r["found"] if x["kind"] not in personal_data.BASE]
        assert all(0.5 <= x["score"] <= 1 for x in added)
        for x in added:
            assert all(x is y or x["end"] <= y["start"] or y["end"] <= x["start"] for y in r["found"])
    assert personal_data.find(nothing).count() == 0 and personal_data.redact(nothing).count() == 0
    twice = spark.createDataFrame([(1, "x@y.z"), (1, "x@y.z"), (None, "x@y.z")], "doc_id long, text string")
    assert [len(r["found"]) for r in personal_data.find(twice).collect()] == [1, 1, 1]


def test_validators_and_context_add_spans(spark):
    t = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], TEXTS[r["doc_id"]][x["start"] : x["end"]]) for x in r["found"] if x["kind"] not in personal_data.BASE] for r in personal_data.find(t).collect()}
    assert got[7] == [("card_part", "4111 1111 1111 1111")]
    assert got[8] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert got[9] == [("phone_local", "(030) 1234567"), ("phone_local", "555-123-4567")]
    assert got[10] == [("national_id", "123-45-6789")]
    assert got[11] == [("card_part", "4111.1111.1111.1111")]
    assert not any(got[k] for k in range(7))
    masked = {r["doc_id"]: r["text"] for r in personal_data.redact(t).collect()}
    assert masked[8] == "IBAN [iban] OK, [iban] and GB83WEST12345698765432" and masked[0] == "" and masked[2] == TEXTS[2]


def test_long_texts_take_time_in_proportion(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + " " * 300_000, "+1" * 150_000, "a@" * 150_000, "@a." * 100_000, "tel 12 34 56 78 9 " * 20_000, "card 4111 1111 1111 1111 1 " * 10_000]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    assert personal_data.find(t).count() == len(texts)
    assert time.perf_counter() - began < 30
