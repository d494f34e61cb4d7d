"""Centroid clustering by delta Lloyd (operator 11).

Vectors become integers once, in a table in the shared folder. Each round is one pass over it that writes each vector
with its owner and the squared distance to it. A pass knows which centroids changed since the one before: a vector
whose owner stood still is compared with the changed centroids only, a vector whose owner changed with all. Global
sums and counts are kept from round to round; a round adds signed integer transfers to them, of vectors whose owner
is another now: minus from the old, plus to the new. Each task adds up its own transfers, so that a row a centroid and
task is shuffled, however large a cluster is. Only the k centroids, sums and counts are on the driver.

All arithmetic is exact: components are at most `LARGEST` (vectors beyond it have those components held at it), so
that squared distances of up to 512 components fit a double's 53 bits.

Vectors of another length, with a null or non-finite component, and null vectors are left out. Repeated rows are
vectors each; a null vec_id is hashed as an empty string. With fewer than k vectors there are as many centroids as
vectors; an empty table gives an empty result. Ties go to the centroid of the smaller number, and, among first
centroids with the same hash, to the smaller components. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import stored

LARGEST = 1 << 20


def quantised(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """vec_id, x (array<int>): floor(scale * component) of the vectors (vec_id, embedding) of `size` finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-LARGEST / scale), F.least(F.lit(LARGEST / scale), v)) * scale).cast("int"))
    return vectors.where((F.size("embedding") == size) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of an array column as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c; exact for whole numbers."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, c: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance under centroids c, of which those in `changed` are not what they were when owner (-1: none) and distance were found."""
    owner, distance = owner.copy(), distance.copy()
    moved = (owner < 0) | np.isin(owner, changed)
    if moved.any():
        d = distances(x[moved], c)
        owner[moved] = d.argmin(axis=1)  # the first of equal ones
        distance[moved] = d.min(axis=1)
    still = np.flatnonzero(~moved)
    if len(still) and len(changed):
        d = distances(x[still], c[changed])
        best = d.argmin(axis=1)
        d, j = d[np.arange(len(still)), best], changed[best]
        nearer = (d < distance[still]) | ((d == distance[still]) & (j < owner[still]))
        owner[still[nearer]], distance[still[nearer]] = j[nearer], d[nearer]
    return owner, distance


def _assign(c: np.ndarray, changed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, before = matrix(b.column("x"), c.shape[1]), b.column("owner").to_numpy()
            owner, distance = reassigned(x, before, b.column("distance").to_numpy().astype(float), c, changed)
            arrays = [b.column("vec_id"), b.column("x"), pa.array(before.astype(np.int32)), pa.array(owner.astype(np.int32)), pa.array(distance.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "x", "before", "owner", "distance"])

    return run


def _transfers(k: int, size: int):
    """A row a centroid of which the task has transfers: the signed count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            x = matrix(b.column("x"), size).astype(np.int64)
            for side, sign in (("before", -1), ("owner", 1)):
                j = b.column(side).to_numpy()
                own = j >= 0
                np.add.at(n, j[own], sign)
                np.add.at(sums, j[own], sign * x[own])
        some = np.flatnonzero(n.astype(bool) | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), *(pa.array(sums[some, i]) for i in range(size))], ["owner", "n", *(f"s{i}" for i in range(size))])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and vec_id, in their order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], float)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, before, owner, distance) of the vectors (vec_id, embedding) after `rounds` rounds, and the centroids."""
    if size > 512:
        raise ValueError("squared distances are exact for up to 512 components")
    spark = vectors.sparkSession
    base = stored(quantised(vectors, scale, size))
    c = first_centroids(base, k, seed)
    k = len(c)
    state = base.select("vec_id", "x", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    if not k:
        return state.withColumn("before", F.col("owner")), np.zeros((0, size))
    n, sums, changed = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.arange(k)
    for r in range(rounds + 1):
        if len(changed) or r == 0:
            state = stored(state.mapInArrow(_assign(c, changed), "vec_id long, x array<int>, before int, owner int, distance long"))
        if r == rounds or not len(changed):
            break  # with no changed centroid the further rounds change nothing
        moved = state.where("before <> owner").select("x", "before", "owner")
        types = ", ".join(f"s{i} long" for i in range(size))
        parts = moved.mapInArrow(_transfers(k, size), f"owner int, n long, {types}").groupBy("owner").agg(F.sum("n").alias("n"), F.array(*(F.sum(f"s{i}") for i in range(size))).alias("s"))
        for row in parts.collect():  # k rows at most
            n[row["owner"]] += row["n"]
            sums[row["owner"]] += np.array(row["s"], np.int64)
        some = n > 0
        fresh = c.copy()
        fresh[some] = sums[some] // n[some, None]
        changed = np.flatnonzero((fresh != c).any(axis=1))
        c = fresh
    return state, c


def digests(c: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in c]


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, c = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    # a row a centroid: their number is a parameter
    inertia = {r["owner"]: r["d"] for r in state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}
    rows = [(j, inertia.get(j, 0), sum(inertia.values()), s) for j, s in enumerate(digests(c))]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("vec_id", F.col("owner").alias("cluster"), "distance")
    return out.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    x = "CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)"
    ctes = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda v: {x}) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS j, x AS c FROM v QUALIFY j < 16)",
    ]
    for r in range(4):
        d = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        ctes.append(f"a{r} AS (SELECT vec_id, any_value(x) AS x, min({{'d': CAST({d} AS BIGINT), 'j': j}}) AS m FROM v, c{r} GROUP BY vec_id)")
        if r < 3:
            ctes += [
                f"e{r} AS (SELECT m.j AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2)",
                f"m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM e{r} GROUP BY j)",
                f"c{r + 1} AS (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.j = c{r}.j)",
            ]
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.j = a3.m.j
"""


OP11_SQL = _sql()
