"""The message source: round trip, pushed filters, streams that start again from their checkpoint."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

from seqloom.operators import detector
from seqloom.sources import messages
from seqloom.streaming import scoring, sessions


@pytest.fixture
def sent(spark):
    messages.register(spark)
    t = spark.range(300).select((F.col("id") % 5).alias("session"), F.when(F.col("id") % 50 != 49, F.floor(F.col("id") / 5)).cast("long").alias("seq"), F.timestamp_millis(10**12 + F.col("id") * 20).alias("at"), F.when(F.col("id") % 50 == 49, "sms").otherwise("pcm").alias("kind"), F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("pcm"))
    return t


def rows(df):
    return sorted(((r["session"], -1 if r["seq"] is None else r["seq"], r["at"], r["kind"], bytes(r["pcm"])) for r in df.collect()))


def test_round_trip_and_filters(spark, sent, tmp_path):
    path = str(tmp_path / "m")
    assert spark.read.format("session_messages").load(path).count() == 0
    sent.repartition(3).write.format("session_messages").mode("append").save(path)
    back = spark.read.format("session_messages").load(path)
    assert rows(back) == rows(sent) and len(list((tmp_path / "m").glob("*.messages"))) == 3 and not list((tmp_path / "m").glob("_*"))
    some = back.where("session = 3 AND seq > 10")
    assert rows(some) == rows(sent.where("session = 3 AND seq > 10"))
    assert rows(back.where("session IN (1, 2) AND seq <= 4 AND kind = 'pcm'")) == rows(sent.where("session IN (1, 2) AND seq <= 4 AND kind = 'pcm'"))
    reader = messages.MessageReader(path)
    left = list(reader.pushFilters([EqualTo(("session",), 3), GreaterThan(("seq",), 10), IsNull(("seq",)), EqualTo(("kind",), "pcm")]))
    assert left == [IsNull(("seq",)), EqualTo(("kind",), "pcm")]
    read = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert read == some.count() < sent.count()


def test_stream_starts_again_without_loss_or_repeats(spark, sent, tmp_path):
    path, got = str(tmp_path / "m"), []

    def run():
        stream = spark.readStream.format("session_messages").option("filesPerBatch", 1).load(path)
        q = stream.writeStream.foreachBatch(lambda df, k: got.append((k, rows(df)))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    for k in range(3):
        sent.where(F.col("session") == k).coalesce(1).write.format("session_messages").mode("append").save(path)
        run()
    sent.where("session > 2").repartition(2).write.format("session_messages").mode("append").save(path)
    run()
    run()  # nothing new
    assert sorted(r for _, part in got for r in part) == rows(sent)
    # a batch that failed is read again, the same rows
    broken = []

    def fail(df, k):
        broken.append(rows(df))
        if len(broken) == 1:
            raise RuntimeError("lost")

    for _ in range(2):
        q = spark.readStream.format("session_messages").load(path).writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(60)
        except Exception as error:  # noqa: BLE001
            assert "lost" in str(error)
    assert broken == [rows(sent)] * 2


def test_messages_become_events(spark, tmp_path):
    """Source, sessions and log together."""
    messages.register(spark)
    path, rules = str(tmp_path / "m"), sessions.Rules(scoring.Scorer(sr=800, model=detector.Linear([0.0] * 40, [1.0] * 40, [0.01] * 40, 0.0), quota=2), idle_ms=2_000)
    t = spark.range(60).select((F.col("id") % 3).alias("session"), F.floor(F.col("id") / 3).alias("seq"), F.timestamp_millis(10**12 + F.col("id") * 20).alias("at"), F.lit("pcm").alias("kind"), F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("pcm")).where("seq <> 7")
    t = t.unionByName(t.groupBy("session").agg(F.max("at").alias("at")).select("session", F.lit(None).cast("long").alias("seq"), (F.col("at") + F.expr("INTERVAL 1 SECOND")).alias("at"), F.lit("call_ended").alias("kind"), F.lit(None).cast("binary").alias("pcm")))
    t.coalesce(1).write.format("session_messages").mode("append").save(path)
    before = sessions.use_rocksdb(spark)
    out = scoring.finished(spark.readStream.format("session_messages").load(path), str(tmp_path / "o"), str(tmp_path / "s"), lambda s: sessions.session_events(s, rules))
    spark.conf.set(sessions.PROVIDER, before) if before else spark.conf.unset(sessions.PROVIDER)
    key = lambda df: sorted((r["session"], r["event"], r["type"], r["seg"] if r["seg"] is not None else -1, r["lost"]) for r in df.collect())
    assert key(out) == key(sessions.replayed_events(spark.read.format("session_messages").load(path), rules)) and out.where("type = 'call_ended' AND lost = 1").count() == 3
