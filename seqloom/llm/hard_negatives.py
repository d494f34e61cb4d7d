"""Hard-negative mining with a pivot table (operator 12).

Inner products become distances: with M the largest squared norm, a row x gets one more component, sqrt(M - |x|^2), and an
anchor q a zero, so that |x' - q'|^2 = M + |q|^2 - 2 <x, q>. The pivot table holds each row's distances to a few pivots, rows of a
bounded sample that lie far from each other. A row belongs to its nearest pivot's cell; the table is laid out by
(cell, distance to it) in ranges, so that neighbours lie together.

Anchors go through the table in chunks of at most `chunk`, which is what a broadcast holds. For a chunk and a batch of
one cell's rows, an anchor's scores are wanted in some interval, thus its distances, [near, far]. By the triangle
inequality a batch is skipped for an anchor if for any pivot the batch's interval of distances lies further than `far` from
the anchor's, or if all its rows are surely nearer than `near`; of the others, whose rows are sorted by their distance to
the own pivot, only the ring within `far` of the anchor's is multiplied out, and scores are compared exactly. `far`
shrinks as better rows are found. It starts from the bounded sample, whose rows are rows of the table too, so that it
is never too small. Bounds have a margin for rounding; scores are whole numbers in doubles, exact for components of at
most `LARGEST` (others are held at it) and 4096 components.

First each anchor's positives are found, then for each of them the negatives in the interval that it allows. Each
task gives at most so many rows an anchor and list as are asked for, of which the best are taken.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. A vector that is shorter than others counts
as if zeros followed. An anchor's other rows are those with another vec_id; rows that repeat a vec_id, with whatever
vector, are candidates each (equal ones follow each other in a list), and anchors each, but for rows equal in all
three columns, which are one anchor. An empty vector scores 0. Empty tables and tables without anchors give empty
results. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import small_batches, stored

LARGEST = 1 << 20
NONE = -np.inf


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, x (array<int>) of the rows that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    x = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-LARGEST / scale), F.least(F.lit(LARGEST / scale), v.cast("double"))) * scale).cast("int"))
    some = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))


def padded(column: pa.Array, size: int) -> np.ndarray:
    """The rows of an array column as doubles, zeros after the shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), size))
    out[np.arange(size) < n[:, None]] = flat
    return out


@dataclass(frozen=True)
class Pivots:
    """points: pivots with their added component; top: the largest squared norm of the table."""

    points: np.ndarray
    top: float

    def to_rows(self, x: np.ndarray) -> np.ndarray:
        own = (x * x).sum(axis=1)
        return self._distances(x, np.sqrt(np.maximum(self.top - own, 0.0)), own)

    def to_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distances(q, np.zeros(len(q)), (q * q).sum(axis=1))

    def _distances(self, x: np.ndarray, added: np.ndarray, norm: np.ndarray) -> np.ndarray:
        p, last = self.points[:, :-1], self.points[:, -1]
        squared = norm[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T) + (added[:, None] - last) ** 2
        return np.sqrt(np.maximum(squared, 0.0))


def choose_pivots(sample: np.ndarray, top: float, count: int) -> Pivots:
    """Rows of the sample, each the one furthest from those before it."""
    full = np.concatenate((sample, np.sqrt(np.maximum(top - (sample * sample).sum(axis=1), 0.0))[:, None]), axis=1)
    chosen, gap = [0], ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
    return Pivots(full[chosen], top)


def pivot_table(rows: DataFrame, pivots: Pivots, size: int) -> DataFrame:
    """rows with cell (the nearest pivot), own (the distance to it) and all distances, laid out by cell and own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.to_rows(padded(b.column("x"), size)).astype(np.float32)
            cell = d.argmin(axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell]), lists], ["vec_id", "label", "x", "cell", "own", "d"])

    placed = rows.mapInArrow(run, "vec_id long, label long, x array<int>, cell int, own float, d array<float>")
    # a hash of the row cuts a cell of equal rows into ranges too
    return stored(placed.withColumn("_h", F.xxhash64("vec_id", "x")).repartitionByRange("cell", "own", "_h").sortWithinPartitions("cell", "own").drop("_h"))


class Best:
    """The best `most` (score, vec_id) of each of `lists` lists: higher scores first, ties by smaller vec_id."""

    def __init__(self, lists: int, most: int):
        self.score, self.id = np.full((lists, most), NONE), np.zeros((lists, most), np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        most = self.score.shape[1]
        own = np.unique(at)
        at = np.concatenate((np.repeat(own, most), at))
        score, ids = np.concatenate((self.score[own].ravel(), score)), np.concatenate((self.id[own].ravel(), ids))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < most
        self.score[at[keep], place[keep]], self.id[at[keep], place[keep]] = score[keep], ids[keep]

    def floor(self) -> np.ndarray:
        """What a score must reach to be in a list."""
        return self.score[:, -1]


@dataclass(frozen=True)
class Wanted:
    """Lists of a chunk's anchors: the anchors' vectors, ids and labels, and for each list its anchor's number, the least and
    the highest score, and whether labels must be equal or differ."""

    q: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, d: np.ndarray, cell: int, w: Wanted, to: np.ndarray, top: float, best: Best, block: int = 1 << 20) -> int:
    """Adds a batch of one cell's rows, sorted by their distance to its pivot, to the lists, and gives the number of
    scores that were worked out. to: distances of the anchors to the pivots."""
    norm = (w.q * w.q).sum(axis=1)
    least = np.maximum(w.low, best.floor())
    # over an anchor's lists: the lowest score that any of them can take, and the highest
    low, high = np.full(len(w.q), np.inf), np.full(len(w.q), NONE)
    np.minimum.at(low, w.anchor, least)
    np.maximum.at(high, w.anchor, w.high)
    margin = 1e-6 * (1 + np.sqrt(top + norm))
    far = np.sqrt(np.maximum(top + norm - 2 * np.where(np.isfinite(low), low, -(top + norm)), 0.0)) + margin
    near = np.sqrt(np.maximum(top + norm - 2 * np.where(np.isfinite(high), high, top + norm), 0.0)) - margin
    near[~np.isfinite(high)] = NONE
    lo, hi = d.min(axis=0), d.max(axis=0)
    apart = np.maximum(to - hi, lo - to).max(axis=1)
    reach = (to + hi).min(axis=1)
    alive = np.flatnonzero((low <= high) & (apart <= far) & (reach >= near))
    own = d[:, cell]
    begin = np.searchsorted(own, to[alive, cell] - far[alive], "left")
    end = np.searchsorted(own, to[alive, cell] + far[alive], "right")
    step = max(1, block // max(1, len(x)))
    first_list = np.argsort(w.anchor, kind="stable")
    bounds = np.searchsorted(w.anchor[first_list], np.arange(len(w.q) + 1))
    done = 0
    for k in range(0, len(alive), step):
        some = alive[k : k + step]
        a, z = int(begin[k : k + step].min()), int(end[k : k + step].max())
        if a >= z:
            continue
        scores = w.q[some] @ x[a:z].T
        done += scores.size
        fits = ((w.labels[some][:, None] == labels[a:z]) == w.same) & (w.ids[some][:, None] != ids[a:z])
        for j in range(int((bounds[some + 1] - bounds[some]).max(initial=0))):  # the j-th list of each anchor that has one
            has = bounds[some] + j < bounds[some + 1]
            lists = first_list[np.minimum(bounds[some] + j, len(first_list) - 1)]
            hit = fits & has[:, None] & (scores >= least[lists][:, None]) & (scores <= w.high[lists][:, None])
            r, c = np.nonzero(hit)
            if len(r):
                best.add(lists[r], scores[r, c], ids[a:z][c])
    return done


def _searched(w: Wanted, to: np.ndarray, top: float, floor: np.ndarray, most: int):
    """list, score, vec_id: the task's best rows of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(w.anchor), most)
        asked = Wanted(w.q, w.ids, w.labels, w.anchor, np.maximum(w.low, floor), w.high, w.same)
        for b in batches:
            cells = b.column("cell").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s < e:
                    p = b.slice(s, e - s)
                    if np.any(np.diff(p.column("own").to_numpy()) < 0):  # a batch may go from one file into another
                        p = p.take(pa.array(np.argsort(p.column("own").to_numpy(), kind="stable")))
                    d = p.column("d").flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1).astype(float)
                    search(padded(p.column("x"), w.q.shape[1]), p.column("vec_id").to_numpy(), p.column("label").to_numpy(), d, int(cells[s]), asked, to, top, best)
        at, place = np.nonzero(np.isfinite(best.score))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best.score[at, place].astype(np.int64)), pa.array(best.id[at, place])], ["list", "score", "id"])

    return run


def best_rows(table: DataFrame, w: Wanted, pivots: Pivots, sample: dict[str, np.ndarray], most: int) -> DataFrame:
    """list, rank (from 1), score, id of the best `most` rows of each list of a chunk."""
    seen = Best(len(w.anchor), most)
    for k in range(0, len(w.anchor), 256):  # lower bounds of the lists' last scores, from rows that are in the table
        part, who = np.arange(k, min(k + 256, len(w.anchor))), w.anchor[k : k + 256]
        s = w.q[who] @ sample["x"].T
        ok = ((w.labels[who][:, None] == sample["labels"]) == w.same) & (w.ids[who][:, None] != sample["ids"]) & (s >= w.low[part][:, None]) & (s <= w.high[part][:, None])
        r, c = np.nonzero(ok)
        if len(r):
            seen.add(part[r], s[r, c], sample["ids"][c])
    found = table.mapInArrow(_searched(w, pivots.to_anchors(w.q), pivots.top, seen.floor(), most), "list int, score long, id long")
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, least: int = 80, of: int = 100, chunk: int = 2048, n_pivots: int = 32, sampled: int = 2048, seed: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows, anchors: vec_id, label, x (array<int>). Negatives of a positive have of its score p: least * p <= of * score <= of * p.
    sampled: rows from which pivots are chosen and first bounds taken; chunk: anchors that are searched for at once."""
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    small_batches(spark, 8192)
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("size"), F.max(squares).alias("top")).first()
    if not facts["n"]:
        return spark.createDataFrame([], result)
    size, top = max(1, facts["size"]), float(facts["top"])
    if size > 4096:
        raise ValueError("scores are exact for up to 4096 components")
    place = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.where(place < 2 * sampled / facts["n"]).limit(sampled).collect()
    drawn = drawn or rows.limit(1).collect()
    values = np.zeros((len(drawn), size))
    for k, r in enumerate(drawn):
        values[k, : len(r["x"])] = r["x"]
    sample = {"x": values, "ids": np.array([r["vec_id"] for r in drawn], np.int64), "labels": np.array([r["label"] for r in drawn], np.int64)}
    pivots = choose_pivots(values, top, n_pivots)
    table = pivot_table(rows, pivots, size)
    asked = anchors.distinct()
    chunks = max(1, -(-asked.count() // (chunk // 2)))  # by hash: half of `chunk` on average
    asked = stored(asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(chunks)).cast("int")))
    out = None
    for part in range(chunks):
        own = asked.where(F.col("part") == part).orderBy("vec_id", "label", "x").collect()  # about chunk / 2 rows
        for at in range(0, len(own), chunk):
            got = _chunk(table, own[at : at + chunk], pivots, sample, size, n_positives, n_negatives, least, of)
            if got is not None:
                out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], result) if out is None else out


def _chunk(table: DataFrame, own: list, pivots: Pivots, sample: dict[str, np.ndarray], size: int, n_positives: int, n_negatives: int, least: int, of: int) -> DataFrame | None:
    q = np.zeros((len(own), size))
    for k, r in enumerate(own):
        q[k, : len(r["x"])] = r["x"][:size]
    ids, labels = np.array([r["vec_id"] for r in own], np.int64), np.array([r["label"] for r in own], np.int64)
    every = np.full(len(own), np.inf)
    first = Wanted(q, ids, labels, np.arange(len(own)), -every, every, True)
    positives = [(r["list"], r["id"], r["score"]) for r in best_rows(table, first, pivots, sample, n_positives).orderBy("list", "rank").collect()]
    positives = [p for p in positives if p[2] >= 0]  # below 0 the interval is empty
    if not positives:
        return None
    anchor, scores = np.array([p[0] for p in positives]), np.array([p[2] for p in positives], np.int64)
    second = Wanted(q, ids, labels, anchor, -((-least * scores) // of).astype(float), scores.astype(float), False)
    negatives = best_rows(table, second, pivots, sample, n_negatives)
    spark = table.sparkSession
    names = spark.createDataFrame([(k, int(ids[a]), p, s) for k, (a, p, s) in enumerate(positives)], "list int, anchor_id long, positive_id long, positive_score long")
    joined = negatives.join(F.broadcast(names), "list")  # a chunk's lists
    return stored(joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), 256)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored(rows.withColumn("label", label))
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
s AS (SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b, CAST(coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS s
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s
QUALIFY rank <= 5
"""
