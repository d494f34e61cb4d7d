"""The pipeline against brute force: each stage on the input that it had."""

from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_dedup import linked

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, stages):
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    (before, after), labels = stages[0], spark.read.parquet(f"{DATA}/labels.parquet")
    kept = after.join(labels, "doc_id").where("toxic = 0").count()
    assert kept >= 0.95 * before.join(labels, "doc_id").where("toxic = 0").count()
    before, after = stages[1]
    groups = defaultdict(list)
    for r in before.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    assert ids(after) == sorted(max(g) for g in groups.values())
    before, after = stages[2]
    expected = linked([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(i for i, (c, _) in expected.items() if c == i)
    before, after = stages[3]
    n = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(n(after) - 1.5 * n(before)) < 0.01 * n(before)
    before, after = stages[4]
    assert ids(after.where("piece = 0")) == ids(before)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_gives_the_stages_rows(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1][1].count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, empty, repeated and very long rows, clashing column names, and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, _h string"
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "one two three"), (None, "a text without an id"), (5, long), (6, " \t\n")]
    for name, data in (("odd", rows), ("none", [])):
        d = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, "s", None, 0.5, 7, "x") for i, t in data], schema).write.parquet(f"{d}/documents.parquet")
        spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(got[0].asDict() if got else corpus_pipeline.run(spark, d).columns)
        if name == "none":
            assert not got
            continue
        # of the equal texts the largest id stays; pieces of the long text follow one another without gaps
        assert 3 not in {r["doc_id"] for r in got} and 4 in {r["doc_id"] for r in got}
        assert any(r["doc_id"] == 5 and r["piece"] > 0 for r in got)
        places = {}
        for r in got:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for spans in places.values():
            assert all(b == a + n for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:])) and sum(n for _, n in spans) <= 2048
