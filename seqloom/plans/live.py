"""Queries of live sessions: the event log, the channel as a stream, the message source. Each embedding is a message of 64
samples, eight of them a session; some never come and some come too late."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import detector
from ..sources import messages, shared
from ..streaming import scoring, sessions, transcoding
from .catalogue import LOSS_SQL, _lossy, query, r6

RULES = sessions.Rules(scoring.Scorer(sr=800, model=detector.Linear([0.0] * 40, [1.0] * 40, [0.01] * 40, 0.1), fusion=(0.4, 0.0, 0.5), quota=10))


def _messages(spark, d):
    """session, seq, at, kind, pcm: every 200 ms one; vec_id % 11 = 5 never comes, vec_id % 13 = 4 comes 290 ms late."""
    t = scoring.messages_of(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("clip"), F.col("embedding").alias("samples")), 64)
    seq = F.pmod("clip", F.lit(8))
    at = F.timestamp_millis(10**12 + 200 * seq + F.when(F.pmod("clip", F.lit(13)) == 4, 290).otherwise(0))
    sent = t.where(F.pmod("clip", F.lit(11)) != 5).select(F.floor(F.col("clip") / 8).alias("session"), seq.alias("seq"), at.alias("at"), F.lit("pcm").alias("kind"), "pcm")
    ended = sent.select("session").distinct().select("session", F.lit(None).cast("long").alias("seq"), F.timestamp_millis(F.lit(10**12 + 2100)).alias("at"), F.lit("call_ended").alias("kind"), F.lit(None).cast("binary").alias("pcm"))
    return sent.unionByName(ended)


SENT_SQL = """
m AS (SELECT vec_id // 8 AS session, vec_id % 8 AS k, vec_id % 13 = 4 AS slow FROM embeddings WHERE vec_id % 11 <> 5),
n AS (SELECT a.session, a.k, a.slow AND b.k IS NOT NULL AS missed FROM m a LEFT JOIN m b ON b.session = a.session AND b.k = a.k + 1),
o AS (SELECT session, count(*) FILTER (NOT missed) AS taken, coalesce(max(k) FILTER (NOT missed), -1) + 1 AS upto, count(*) FILTER (missed) AS late FROM n GROUP BY session)"""


@query(f"""
WITH {SENT_SQL} SELECT session, upto - taken AS lost, late, 4 * taken // 10 + CAST(4 * taken % 10 >= 5 AS BIGINT) AS windows, CAST(1 AS BIGINT) AS ended FROM o
""")
def session_losses(spark, d):
    """What each session lost and what came too late, and the windows that the rest gave."""
    log = sessions.replayed_events(_messages(spark, d), RULES)
    return log.groupBy("session").agg(F.max_by("lost", "event").alias("lost"), F.max_by("late", "event").alias("late"), F.count_if(F.col("type") == "window").alias("windows"), F.count_if(F.col("type") == "call_ended").alias("ended"))


@query()
def session_log(spark, d):
    """The events of a stream of messages, read from a message source."""
    place = f"{shared.shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    messages.register(spark)
    _messages(spark, d).write.format("session_messages").mode("append").save(f"{place}/in")
    before = sessions.use_rocksdb(spark)
    try:
        out = scoring.finished(spark.readStream.format("session_messages").load(f"{place}/in"), f"{place}/out", f"{place}/state", lambda s: sessions.session_events(s, RULES))
    finally:
        spark.conf.set(sessions.PROVIDER, before) if before else spark.conf.unset(sessions.PROVIDER)
    return out.select("session", "event", "type", "seg", r6("llr").alias("llr"), r6("lambda").alias("lambda"), "verdict", "lost", "late")


@query("SELECT vec_id // 8 AS session, vec_id % 8 AS seq, CAST(128 AS BIGINT) AS bytes FROM embeddings WHERE vec_id % 11 <> 5 AND vec_id // 8 < 20 AND vec_id % 8 >= 3")
def message_scan(spark, d):
    """Written as messages, read back with filters that the source takes over."""
    messages.register(spark)
    place = f"{shared.shared_dir(spark)}/messages-{uuid.uuid4().hex}"
    _messages(spark, d).write.format("session_messages").mode("append").save(place)
    return spark.read.format("session_messages").load(place).where("session < 20 AND seq >= 3").select("session", "seq", F.octet_length("pcm").cast("long").alias("bytes"))


@query(f"""
WITH {LOSS_SQL}, g AS (SELECT *, sum(1 - lost) OVER w AS island, max(CASE WHEN lost = 0 THEN frame END) OVER w AS source FROM fr WINDOW w AS (PARTITION BY clip ORDER BY frame)),
k AS (SELECT *, CASE WHEN lost = 1 THEN row_number() OVER (PARTITION BY clip, island, lost ORDER BY frame) END AS k FROM g),
y AS (SELECT f.*, k.k, coalesce(h.x, 0) * power(10, -6.0 * k.k / 20) AS y, coalesce(t.x, 0) AS tail FROM f JOIN k ON f.clip = k.clip AND f.frame = k.frame
 LEFT JOIN f h ON h.clip = f.clip AND h.frame = k.source AND h.j = f.j LEFT JOIN f t ON t.clip = f.clip AND t.frame = f.frame - 1 AND t.j = f.j + 12)
SELECT clip, i, lost, round(CASE WHEN lost = 0 THEN x WHEN k = 1 AND frame > 0 AND j < 4 THEN (1 - j / 3.0) * tail + j / 3.0 * y ELSE y END, 5) AS y FROM y
""")
def stream_concealment(spark, d):
    """Lost frames of a stream, concealed from state: the samples of the batch."""
    frames = _lossy(spark, d).groupBy("clip", "frame", "lost").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    held = shared.stored(frames)
    place = f"{shared.shared_dir(spark)}/channel-{uuid.uuid4().hex}"
    before = sessions.use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1_000_000).parquet(held.inputFiles()[0].rsplit("/", 1)[0])
        out = scoring.finished(stream, f"{place}/out", f"{place}/state", lambda s: transcoding.streaming_channel(s, "clean", transcoding.Loss(16), lost="lost", ttl_ms=None))
    finally:
        spark.conf.set(sessions.PROVIDER, before) if before else spark.conf.unset(sessions.PROVIDER)
    return out.select("clip", (F.col("frame") * 16).alias("first"), "lost", F.posexplode("y").alias("j", "y")).select("clip", (F.col("first") + F.col("j")).alias("i"), "lost", F.round("y", 5).alias("y"))
