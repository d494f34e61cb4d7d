import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import mixing, packing


def test_pieces_and_sequences(spark, docs, texts, nothing):
    odd = [(5000, "X<|endoftext|>y <|ENDOFTEXT|>. A.B... don't İİ 'S é. …. ½."), (5001, "́a ͅ  b"), (5001, "́a ͅ  b"), (None, "text!?")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in [*texts, *odd]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            expected.append((i or -1, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for per_task in (50_000, 20):
        rows = packing.pack_documents(both, per_task=per_task).collect()
        assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 2048
        total = sum(r["length"] for r in rows)
        assert len(bins) <= -(-total // 2048) * (1.1 if per_task > 100 else 1.3) + 1
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit():
    to, offset, fill = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert fill == [10, 10] and to == [0, 1, 0, 1, 1] and offset == [0, 0, 6, 5, 8]


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 0], [5, 2], 1.5, 2.0) == [0.0, 0.0]


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 1).tolist() != mixing.permuted(np.arange(1000), 1000, 2).tolist()


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 37 * 5)) if i % 11 else None, ("a" if i % 3 else f"s{i % 4}") if i % 10 else None, "en", 1) for i in range(900)]
    rows += [(1, rows[1][1], "a", "en", 1), (None, "some words", "a", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")


def test_mix(sources, nothing):
    got = mixing.taken(sources, block=64).join(sources.select("doc_id", "source").distinct(), "doc_id").collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source"], r["source_size"], r["target"]), []).append((r["size"], r["taken"]))
    for (_, size, target), rows in by.items():
        assert target <= 2 * size and abs(sum(t for _, t in rows) - target) <= 12
    assert mixing.taken(sources).count() == 902
    assert sorted(map(str, mixing.taken(sources, block=64).collect())) == sorted(map(str, mixing.taken(sources.repartition(5), block=64).collect()))
    assert mixing.taken(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents(sources):
    docs = sources.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumns({c: F.lit(1) for c in ("size", "turn", "spans", "before", "src")})
    out = mixing.mixed_documents(docs, block=64)
    assert out.columns == docs.columns
    words = out.withColumn("w", F.size(F.split("text", " "))).groupBy("doc_id").agg(F.sum("w").cast("long").alias("w"))
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(docs, block=64).where("taken > 0").collect()}
    assert {r["doc_id"]: r["w"] for r in words.collect()} == want
    whole = docs.join(out.select("doc_id", F.col("text").alias("t")), "doc_id").where("text = t").count()
    assert whole > 300


def test_known_parts_stay_within_their_bytes():
    known, rng = packing.Known(20_000), np.random.default_rng(1)
    for _ in range(200):
        keys = np.unique(np.concatenate((rng.integers(0, 50, 30), rng.integers(0, 100_000, 40)))).astype(np.uint64)
        new = np.flatnonzero(known.missing(keys))
        known.add(keys[new], [[int(k)] * int(k % 4) for k in keys[new]])
        at, size = known.slots(keys)
        assert [known.flat[a : a + n].tolist() for a, n in zip(at, size, strict=True)] == [[int(k)] * int(k % 4) for k in keys]
        known.shrink()
        assert known.bytes() <= 20_000
    assert len(known.keys)
