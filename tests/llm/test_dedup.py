import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import exact_dedup, minhash_dedup, substring_dedup
from seqloom.llm.fm_index import FMIndex
from seqloom.llm.links import components


def test_exact_groups(docs, texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.groups(docs).collect()}
    for i, t in texts:
        own = groups[t or ""]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), i == max(own))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.deduplicate(docs, "min")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_exact_odd_rows(spark, nothing):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "b")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.groups(t).collect())
    assert got == [(-1, 1, True), (-1, 3, False), (1, 3, True), (1, 3, True), (2, 1, True)]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in exact_dedup.deduplicate(t).collect()) == [(-1, ""), (1, "a"), (2, "b")]
    assert exact_dedup.groups(nothing).count() == 0


def test_hot_text_is_dealt_to_salts(spark):
    t = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 6))).alias("text"))
    plain, salted = ({tuple(r) for r in exact_dedup.groups(t, hot_rows=n).collect()} for n in (10_000, 20))
    assert plain == salted and len(plain) == 3000
    assert exact_dedup.deduplicate(t).count() == 501


def linked(texts, k, threshold):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (find(i), len(sets[i])) for i in sets}


def test_near_duplicates(docs, texts):
    for k, threshold, more in ((3, 85, {}), (5, 80, {}), (3, 85, {"small": 8, "pivots": 2})):
        expected = linked(texts, k, threshold)
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash_dedup.near_duplicates(docs, k, threshold, 100, **more).collect()}
        assert got == expected
    kept = minhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (c, _) in linked(texts, 5, 80).items() if c == i}


def test_near_pairs_in_large_nodes(spark):
    """Pairs just at the threshold, joined by nothing else, among texts that share most of a template."""
    pairs, rows = 150, []
    for p in range(pairs):
        shared = [f"t{i}" for i in range(35)] + [f"p{p}_{i}" for i in range(5)]
        rows += [(2 * p + side, " ".join(shared + [f"o{p}_{side}_{i}" for i in range(5)])) for side in (0, 1)]
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # large nodes branch on once, and are compared block against block below
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(t, 1, 80, 100, small=32, max_depth=8).collect()}
    assert all(got[2 * p] == 2 * p for p in range(pairs))  # no other pair is similar
    assert all(got[2 * p + 1] == 2 * p for p in range(pairs))  # 0.015 misses expected at a recall of 0.9999


def test_near_path_counts():
    for s in (0.8, 0.85, 0.95):
        trees, fanout = minhash_dedup.path_counts(s, 4, 0.9999)
        lost = 0.0
        for _ in range(8):
            lost = (1 - s**4 * (1 - lost)) ** fanout
        assert (1 - s**4 * (1 - lost)) ** trees <= 1e-4


def test_near_odd_rows(spark, nothing):
    text = " ".join(f"w{i}" for i in range(40))
    t = spark.createDataFrame([(3, text), (3, "other words stand here"), (4, text + " more"), (None, text), (5, "Other words stand here"), (6, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(t).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False), (6, 6, True)]
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def without_repeats(texts, window):
    first, rows = {}, {}
    for i, t in sorted((i, t or "") for i, t in texts):
        w = t.encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
        rows[i] = w
    out = {}
    for i, w in rows.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, texts, nothing):
    for window, more in ((50, {}), (20, {"heavy": 3, "shard_words": 500})):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, window, **more).collect()}
        assert got == without_repeats(texts, window)
    assert sum(v[1] for v in got.values()) > 1000
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_a_passage_of_many_documents_is_one_row_of_a_shard(spark, tmp_path, monkeypatch):
    """The largest group that meets in one task does not grow with the documents that share a passage."""
    inner = substring_dedup._shard

    def counting(window):
        run, place = inner(window), str(tmp_path)

        def counted(pdf):
            import uuid

            with open(f"{place}/{len(pdf)}-{uuid.uuid4().hex}", "w"):
                pass
            return run(pdf)

        return counted

    monkeypatch.setattr(substring_dedup, "_shard", counting)
    passage, largest = " ".join(f"p{i}" for i in range(60)), []
    for n in (300, 1200):
        for f in tmp_path.iterdir():
            f.unlink()
        rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(40)), passage, *(f"b{i}x{j}" for j in range(40))])) for i in range(n)]
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), heavy=100, shard_words=20_000).collect()
        assert sum(r["n_removed"] for r in got) == 60 * (n - 1)
        runs = [int(f.name.split("-")[0]) for f in tmp_path.iterdir()]
        largest.append(max(runs))
    assert max(largest) < 2 * 20_000 / 51


def test_repeats_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    t = spark.createDataFrame([(None, text), (2, text), (2, "before " + text), (3, text + " after")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(t).collect())
    assert got == [(-1, 60, 0), (2, 60, 0), (2, 61, 0), (3, 61, 60)]


def test_index_statistics():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 400)
    text[[60, 200, 399]] = 0
    index = FMIndex(text, 12)
    patterns = rng.integers(0, 5, 300)
    patterns[100:140] = text[210:250]
    starts, ends = np.array([0, 90, 200]), np.array([90, 200, 300])
    size, at = index.statistics(patterns, starts, ends, 10)
    suffixes = sorted(range(400), key=lambda i: tuple(text[i : i + 12]))
    joined = "".join(map(str, text))
    for s, e in zip(starts, ends, strict=True):
        for p in range(s, e):
            n = 0
            while n < 10 and p + n < e and patterns[p + n] and "".join(map(str, patterns[p : p + n + 1])) in joined:
                n += 1
            assert size[p] == n
            assert (text[suffixes[at[p]] :][:n] == patterns[p : p + n]).all()
    counts = Counter(text.tolist())
    for c in range(5):
        assert index.bwt.rank(np.array([c]), np.array([400]))[0] == counts[c]


def test_pieces_of_one_task(spark, docs):
    """Few rows a batch and one text a batch give the same."""
    a = {tuple(r) for r in substring_dedup.remove_repeats(docs.repartition(7)).drop("kept_text").collect()}
    b = {tuple(r) for r in substring_dedup.remove_repeats(docs.coalesce(1).orderBy(F.desc("doc_id"))).drop("kept_text").collect()}
    assert a == b


def test_windows_longer_than_a_byte():
    """Shared lengths above 255 are kept in wider numbers."""
    rng = np.random.default_rng(12)
    shared = rng.integers(1, 40, 420)
    texts = [np.concatenate((rng.integers(1, 40, n), shared, rng.integers(1, 40, 60))).astype(np.int64) for n in (30, 70, 5)]
    for window in (256, 300):
        index = FMIndex(np.concatenate([*(np.append(t, 100 + k) for k, t in enumerate(texts)), [0]]).astype(np.int64), window)
        assert int(index.lcp.max()) == window and index.lcp.dtype != np.uint8
        wide = index.groups(window)
        assert (wide[1] - wide[0]).max() == 3 and ((wide[1] - wide[0]) == 3).sum() == 420 - window + 1
