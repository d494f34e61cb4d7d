"""Near-duplicate detection by a chosen-path set similarity join (operator 7).

1. Every text becomes its set of word shingles (64-bit hashes), the set's 128-bit digest and a minwise signature.
   Texts with equal sets are one class from here on, represented by its smallest doc_id.
2. Trees. In each of `trees` trees a class walks down `depth` levels, branching at each by the token of a minwise
   coordinate. No two trees share a coordinate, so that they are independent. Classes that choose the same path meet
   in a node. A pair with the threshold's similarity s keeps together over a level with chance s, over a tree's with
   s^depth. `path_counts` takes as many trees as the target recall needs, large nodes (4) included.
3. In each node every class is compared with the node's smallest id, not with all others: links of a large group of
   near copies stay in proportion to its members.
4. Components of the verified links are computed. A node whose members are of one component has no more to give. In a
   node with several, members of different components are compared exhaustively where the node is small (at most
   `small` classes and `small_shingles` shingles, which bounds a task's memory). In larger nodes `pivots` members are
   compared with all, and the node branches on: each class goes down `depth` more levels on `fanout` paths, and steps 3
   and 4 repeat. Each node below hashes the whole sets anew, by its own hash, so that its branches are independent of
   all others. Below `max_depth` the nodes that are still large are compared exhaustively too, block against block in
   tasks of that size, so nothing is capped.
5. Every link is confirmed on the full shingle sets, with integers only.

Null and empty texts have no shingles and are linked with nothing; texts with fewer words than a shingle have one,
the whole sequence. Rows that repeat a doc_id with another text share a component; rows with a null doc_id are linked with nothing, are
kept, and have a null component. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import components
from .session import small_batches, stored
from .text import LOWER, U, blocks, mix, per_row, windows, word_hashes, words


def path_counts(similarity: float, depth: int, recall: float, most_lost: float = 0.25) -> tuple[int, int]:
    """(trees, fanout) by which a pair of this similarity is compared with a chance of `recall`, were all its nodes large.

    A pair in a large node is lost there with chance q: on none of `fanout` paths does it keep together and is not lost
    further down, q = (1 - s^depth (1 - q))^fanout. Iterated from 0, the exhaustive last level, q grows to its limit,
    which holds for any number of levels. `fanout` is the least that brings q to `most_lost`; the trees make up for it."""
    keep = similarity**depth
    if keep >= 1:
        return 1, 1
    fanout = math.ceil(1 / keep)
    while True:
        lost = 0.0
        for _ in range(10_000):
            lost = (1 - keep * (1 - lost)) ** fanout
        if lost <= most_lost:
            return math.ceil(math.log(1 - recall) / math.log(1 - keep * (1 - lost))), fanout
        fanout += 1


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row of a block, sorted, one row after the other, and their offsets."""
    n = len(off) - 1
    data = LOWER[data]
    start, end, row = words(data, off)
    h = word_hashes(data, start, end)
    first, shingle = windows(h, row, k)
    owner = row[first]
    count = per_row(np.ones(len(row)), row, n)
    at = np.concatenate(([0], np.cumsum(count)))
    for r in np.flatnonzero((count > 0) & (count < k)):  # few: the whole sequence is the shingle
        _, x = windows(h[at[r] : at[r + 1]], row[at[r] : at[r + 1]], int(count[r]))
        shingle, owner = np.append(shingle, mix(x + U(count[r]))), np.append(owner, r)
    if len(owner) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        shingle, owner = shingle[order], owner[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))) if len(owner) else np.zeros(n + 1, np.int64)
    sets = [np.unique(shingle[bounds[r] : bounds[r + 1]]) for r in range(n)]
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


def _features(k: int, coordinates: int):
    seeds = np.random.default_rng(7).integers(1, 1 << 63, coordinates).astype(U) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in blocks(batch.column("text")):
                flat, at = shingle_sets(data, off, k)
                size = np.diff(at)
                some = np.flatnonzero(size)
                sig = np.zeros((b - a, coordinates), np.uint32)
                k1, k2 = np.zeros(b - a, U), np.zeros(b - a, U)
                if len(some):
                    with np.errstate(over="ignore"):
                        for j in range(coordinates):
                            sig[some, j] = np.minimum.reduceat((flat * seeds[j]) >> U(32), at[some]).astype(np.uint32)
                        k1[some] = np.add.reduceat(mix(flat), at[some])
                        k2[some] = np.add.reduceat(mix(flat ^ U(0x5851F42D4C957F2D)), at[some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "signature"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in blocks(batch.column("text")):
                flat, at = shingle_sets(data, off, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([flat[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "shingles"])

    return run


def _paths(trees: int, depth: int):
    """Nodes at which each class arrives from the root: one a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, trees, depth).astype(U)
            out = []
            with np.errstate(over="ignore"):
                for tree in range(trees):
                    node = mix(np.full(n, tree + 1, U) * U(0xD6E8FEB86659FD93))
                    for level in range(depth):
                        node = mix(node + mix(sig[:, tree, level] + U(level + 1) * U(0x100000001)))
                    out.append(pa.array(node.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column("id")] * trees), pa.concat_arrays(out)], ["id", "node"])

    return run


def _onward(fanout: int, depth: int):
    """Nodes at which each class arrives from a given node, on `fanout` paths. The least product of a shingle and a node's hash names the branch."""
    ways = (np.arange(fanout) + 1).astype(U) * U(0xD6E8FEB86659FD93)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            out = np.empty((batch.num_rows, fanout), U)
            sets = batch.column("shingles")
            with np.errstate(over="ignore"):
                for i in range(batch.num_rows):
                    flat = np.frombuffer(sets[i].as_buffer(), U)
                    node = mix(at[i] + ways)
                    for _ in range(depth):
                        seeds = mix(node ^ U(0x2545F4914F6CDD1D)) | U(1)
                        node = mix(node + mix((flat * seeds[:, None]).min(axis=1)))
                    out[i] = node
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), fanout)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out.ravel().view(np.int64))], ["id", "node"])

    return run


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            ok = []
            one, two = batch.column("sa"), batch.column("sb")
            ids = batch.column("a").to_pylist()
            for i in range(batch.num_rows):
                x = held.get(ids[i])
                if x is None:
                    held = {ids[i]: (x := np.frombuffer(one[i].as_buffer(), U))}
                y = np.frombuffer(two[i].as_buffer(), U)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(denominator * same >= numerator * (len(x) + len(y) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _inside(numerator: int, denominator: int):
    """Links that join a node's components, found by growing one component after the other: each member of it is compared
    with all that are still outside, at once."""

    def run(table: pa.Table) -> pa.Table:
        ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("shingles")]
        size = np.array([len(x) for x in sets])
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.concatenate(([0], np.cumsum(size)))
        marked = np.zeros(int(token.max()) + 1, bool)
        _, root = np.unique(roots, return_inverse=True)
        out: list[tuple[int, int]] = []
        outside = np.ones(len(ids), bool)
        for start in range(len(ids)):
            if not outside[start]:
                continue
            queue = np.flatnonzero(root == root[start]).tolist()
            outside[queue] = False
            rest, changed = np.zeros(0, np.int64), True
            while queue:
                if changed:
                    rest, changed = np.flatnonzero(outside), False
                    flat = np.concatenate([token[at[r] : at[r + 1]] for r in rest]) if len(rest) else np.zeros(0, np.int64)
                    begin = np.cumsum(size[rest]) - size[rest]
                if not len(rest):
                    break
                y = queue.pop()
                own = token[at[y] : at[y + 1]]
                marked[own] = True
                same = np.add.reduceat(marked[flat].astype(np.int64), begin)
                marked[own] = False
                near = rest[denominator * same >= numerator * (size[y] + size[rest] - same)]
                for z in near.tolist():
                    out.append((int(ids[y]), int(ids[z])))
                if len(near):
                    fresh = np.flatnonzero(outside & np.isin(root, root[near]))
                    outside[fresh] = False
                    queue += fresh.tolist()
                    changed = True
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, numerator: int = 80, denominator: int = 100, recall: float = 0.9999, depth: int = 4, small: int = 2048, small_shingles: int = 4_000_000, pivots: int = 4, max_depth: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Texts are linked when denominator * |intersection| >= numerator * |union| of their sets of `shingle` words."""
    spark = docs.sparkSession
    small_batches(spark)
    similarity = numerator / denominator
    trees, fanout = path_counts(similarity, depth, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = stored(docs.mapInArrow(_features(shingle, trees * depth), "doc_id long, n_shingles long, k1 long, k2 long, signature binary"))
    full = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id"))
    reps = full.select(F.col("doc_id").alias("id"), "k1", "k2", "n_shingles", "signature").join(classes, ["id", "k1", "k2", "n_shingles"], "left_semi").select("id", "n_shingles", "signature")

    sizes = reps.select("id", F.col("n_shingles").alias("n"))
    links, sets, roots = None, None, None
    nodes = stored(_crowded(reps.mapInArrow(_paths(trees, depth), "id long, node long")))
    level = 0
    while True:
        level += 1
        if sets is None:  # only classes that meet another one need their whole sets again
            wanted = nodes.select("id").distinct()
            sets = stored(docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi").mapInArrow(_sets(shingle), "id long, shingles binary"))
        lowest = nodes.groupBy("node").agg(F.min("id").alias("a"))
        found = stored(_verified(nodes.join(lowest, "node").where("id <> a").select("a", F.col("id").alias("b")).distinct(), sets, numerator, denominator))
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        # nodes that still hold several components
        mixed = stored(_mixed(nodes, roots))
        if mixed.isEmpty():
            break
        last = level * depth >= max_depth
        held = mixed.join(sizes, "id").groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
        # blocks of a quarter of the bounds, as two of them meet in a task and their sizes vary
        parts = F.greatest(F.ceil(F.col("m") * 4 / small), F.ceil(F.col("w") * 4 / small_shingles)).cast("long")
        held = stored(held.select("node", ((F.col("m") <= small) & (F.col("w") <= small_shingles)).alias("whole"), parts.alias("parts")))
        whole = mixed.join(held.where("whole"), "node", "left_semi").join(sets, "id")
        found = whole.groupBy("node").applyInArrow(_inside(numerator, denominator), "a long, b long")
        large = held.where("NOT whole").select("node", "parts")
        if more := not large.isEmpty():
            rest = mixed.join(large, "node", "left_semi")
            if last:
                found = found.unionByName(_block_pairs(mixed.join(large, "node")).join(sets, "id").groupBy("node", "i", "j").applyInArrow(_inside(numerator, denominator), "a long, b long"))
            else:
                chosen = F.array(*(F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id"))["id"] for i in range(pivots)))
                drawn = rest.groupBy("node").agg(chosen.alias("ids")).select("node", F.explode(F.array_distinct("ids")).alias("id"))
                asked = rest.join(drawn, ["node", "id"], "left_semi")
                other = rest.select("node", F.col("id").alias("b"), F.col("root").alias("rb"))
                pairs = asked.join(other, "node").where("root <> rb").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
                found = found.unionByName(_verified(pairs, sets, numerator, denominator))
        found = stored(found)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
        if last or not more:
            break
        left = _mixed(rest.select("id", "node"), roots).select("id", "node")
        nodes = stored(_crowded(left.join(sets, "id").select("id", "node", "shingles").mapInArrow(_onward(fanout, depth), "id long, node long")))
        if nodes.isEmpty():
            break
    # back to all rows: class, then component
    membership = full.select("k1", "k2", "n_shingles", "doc_id").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "id")
    if docs_repeat := _repeats(full):  # rows that share a doc_id link their classes
        both = membership.join(docs_repeat, "doc_id").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        roots = components(links.unionByName(both.select("a", "b")))
    rooted = classes.join(roots, "id", "left").select("k1", "k2", "n_shingles", F.coalesce("root", "id").alias("root"))
    return features.join(rooted, ["k1", "k2", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"),
    )


def _repeats(full: DataFrame) -> DataFrame | None:
    again = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    return None if again.isEmpty() else again


def _crowded(nodes: DataFrame) -> DataFrame:
    """Without nodes of one class."""
    several = nodes.groupBy("node").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("node")
    return nodes.join(several, "node", "left_semi").distinct()


def _mixed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, node, root) of the nodes whose classes are of several components."""
    of = nodes.join(roots, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root"))
    several = of.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("node")
    return of.join(several, "node", "left_semi")


def _block_pairs(members: DataFrame) -> DataFrame:
    """(id, node, root, i, j): members of each node dealt to `parts` blocks (4 at least), and each pair of blocks i < j with the members of both."""
    dealt = members.withColumn("_block", F.pmod(F.xxhash64("id", F.lit(99)), F.col("parts")))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("_block <> _other")
    return paired.select("id", "node", "root", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"))


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    one, two = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(_confirm(numerator, denominator), "a long, b long")


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; all columns stay."""
    gone = near_duplicates(docs, **parameters).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=3, numerator=85, denominator=100)
