"""Queries of long recordings in chunks and of decoding."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cepstra, chunks, splits
from ..sources import signals
from ..streaming import scoring
from .catalogue import I_SQL, items, query, r6


def durbin_sql(order: int, frame: int) -> str:
    """p<order>: clip, frame, n, a (predictor coefficients) of frames of x, one step of the recursion after the other."""
    lags = ", ".join(f"lag(y, {k}) OVER w AS y{k}" for k in range(1, order + 1))
    sums = ", ".join(["sum(y * y)", *(f"coalesce(sum(y * y{k}), 0)" for k in range(1, order + 1))])
    steps = [
        f"""p{i} AS (SELECT clip, frame, n, r, list_concat(list_transform(range(1, {i}), lambda j: a[j] - k * a[{i} - j]), [k]) AS a, err * (1 - k * k) AS err
 FROM (SELECT *, CASE WHEN r[1] > 0 AND err > 0 THEN (r[{i + 1}] - coalesce(list_sum(list_transform(range(1, {i}), lambda j: a[j] * r[{i + 1} - j])), 0)) / err ELSE 0 END AS k FROM p{i - 1}))"""
        for i in range(1, order + 1)
    ]
    return ",\n".join([
        f"fr AS (SELECT clip, i, x, i // {frame} AS frame, i % {frame} AS j, count(*) OVER (PARTITION BY clip, i // {frame}) AS n FROM s)",
        "wy AS (SELECT *, x * (0.54 - 0.46 * cos(2 * pi() * j / n)) AS y FROM fr)",
        f"lg AS (SELECT clip, frame, n, y, {lags} FROM wy WINDOW w AS (PARTITION BY clip, frame ORDER BY i))",
        f"p0 AS (SELECT clip, frame, any_value(n) AS n, [{sums}] AS r, CAST([] AS DOUBLE[]) AS a, sum(y * y) * (1 + 1e-9) AS err FROM lg GROUP BY clip, frame)",
        *steps,
    ])


def residual_sql(order: int, frame: int) -> str:
    past = " + ".join(f"a[{k}] * coalesce(lag(x, {k}) OVER v, 0)" for k in range(1, order + 1))
    return f"""WITH {I_SQL}, {durbin_sql(order, frame)},
e AS (SELECT clip, i, frame, x - CASE WHEN n > {order} THEN past ELSE 0 END AS e FROM (SELECT fr.clip, i, fr.frame, fr.n, x, {past} AS past FROM fr JOIN p{order} p ON p.clip = fr.clip AND p.frame = fr.frame WINDOW v AS (PARTITION BY fr.clip ORDER BY i)))
SELECT clip, i, round(e, 3) AS e, CAST(e > median(e) OVER (PARTITION BY clip, frame) AS INTEGER) AS bit FROM e"""


@query(residual_sql(10, 160))
def lpc_residual_order10_chunks(spark, d):
    return chunks.residual(items(spark, d), "x", 160, 10, 2).select("clip", "i", F.round("e", 3).alias("e"), "bit")


@query(residual_sql(16, 320))
def lpc_residual_order16_chunks(spark, d):
    return chunks.residual(items(spark, d), "x", 320, 16, 1).select("clip", "i", F.round("e", 3).alias("e"), "bit")


@query()
def pitch_tracks(spark, d):
    """The period of each overlapping frame of the long clips."""
    found = chunks.pitch_candidates(items(spark, d), "x", 8000, 80, 400, hops_per_chunk=10)
    return chunks.pitch_track(found, unvoiced=0.2).select("clip", "frame", r6("period").alias("period"))


#: A header of 64 mono samples of 16 bit at 8 kHz.
HEAD = b"RIFF" + struct.pack("<I", 36 + 128) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 128)


@query("""
SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 3 THEN 400 WHEN vec_id % 5 = 1 THEN 413 ELSE 200 END AS INTEGER) AS status, CASE WHEN vec_id % 7 <> 3 AND vec_id % 5 <> 1 THEN 8000 END AS sr,
 CASE WHEN vec_id % 7 <> 3 AND vec_id % 5 <> 1 THEN CAST(64 AS BIGINT) END AS samples, CASE WHEN vec_id % 7 <> 3 AND vec_id % 5 <> 1 THEN round(trunc(CAST(embedding[64] AS DOUBLE) * 32768) / 32768, 6) END AS last FROM embeddings
""")
def decoded_uploads(spark, d):
    """Embeddings as WAV files, of which some are cut off and some too large."""
    t = scoring.messages_of(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("clip"), F.col("embedding").alias("samples")), 64)
    content = F.concat(F.unhex(F.lit(HEAD.hex())), "pcm")
    sent = F.when(F.col("clip") % 7 == 3, F.substring(content, 1, 30)).when(F.col("clip") % 5 == 1, F.concat(content, content)).otherwise(content)
    out = signals.decoded(t.select(F.col("clip").cast("string").alias("path"), sent.alias("content")), 300)
    return out.select(F.col("path").cast("long").alias("vec_id"), "status", "sr", F.when(F.col("samples").isNotNull(), F.size("samples")).cast("long").alias("samples"), r6(F.try_element_at("samples", F.lit(64)).cast("double")).alias("last"))


def slope_sql(name: str, source: str, value: str) -> str:
    lag = lambda n: f"coalesce(lag({value}, {n}) OVER w, first_value({value}) OVER w)"
    lead = lambda n: f"coalesce(lead({value}, {n}) OVER w, last_value({value}) OVER (PARTITION BY clip, k ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return f"{name} AS (SELECT *, ({lead(1)} - {lag(1)}) / 10 + 2 * ({lead(2)} - {lag(2)}) / 10 AS {name} FROM {source} WINDOW w AS (PARTITION BY clip, k ORDER BY frame))"


@query(f"""
WITH c AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings), l AS (SELECT clip, frame, k, CAST(embedding[k] AS DOUBLE) AS c FROM c, range(1, 21) t(k)),
{slope_sql("d", "l", "c")}, {slope_sql("dd", "d", "d")},
f AS (SELECT clip, frame, k - 1 AS k, c AS v FROM dd UNION ALL SELECT clip, frame, k + 19, d FROM dd UNION ALL SELECT clip, frame, k + 39, dd FROM dd)
SELECT CAST(clip AS INTEGER) AS clip, frame, CAST(k AS INTEGER) AS k, round((v - avg(v) OVER z) / stddev_pop(v) OVER z, 5) AS v FROM f WINDOW z AS (PARTITION BY clip, k)
""")
def cepstral_features(spark, d):
    """Slopes and normalisation of given cepstra: the first twenty components of embeddings."""
    t = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("clip"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("frame"), F.transform(F.slice("embedding", 1, 20), lambda v: v.cast("double")).alias("c"))
    return cepstra.features(t).select("clip", "frame", F.posexplode("features").alias("k", "v")).withColumn("v", F.round("v", 5))


@query()
def clip_cepstra(spark, d):
    """Sixty numbers a frame of the long clips."""
    found = cepstra.features(cepstra.cepstra(items(spark, d), "x", 800))
    return found.select("clip", "frame", F.transform("features", lambda v: F.round(v, 4)).alias("features"))


def _linked(spark, d):
    """Customers as clips: a voice of three, some with a text that others have too, some of a generator of their own."""
    t = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return t.select("c_custkey", F.floor(F.col("c_custkey") / 3).alias("voice"), F.when(F.col("c_custkey") % 10 == 0, F.floor(F.col("c_custkey") / 10) % 50).alias("text"), (F.col("c_custkey") % 97 == 5).alias("unseen"))


@query("""
WITH RECURSIVE r AS (SELECT c_custkey, c_custkey // 3 AS voice, CASE WHEN c_custkey % 10 = 0 THEN (c_custkey // 10) % 50 END AS text, c_custkey % 97 = 5 AS unseen FROM customer),
e AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM r a JOIN r b ON a.voice = b.voice UNION SELECT a.c_custkey, b.c_custkey FROM r a JOIN r b ON a.text = b.text),
w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
c AS (SELECT a AS c_custkey, min(b) AS component FROM w GROUP BY a),
k AS (SELECT component, bool_or(unseen) AS held FROM r JOIN c USING (c_custkey) GROUP BY component),
n AS (SELECT component, row_number() OVER (ORDER BY (component * 7919) % 10007, component) - 1 AS pl, count(*) OVER () AS n FROM k WHERE NOT held)
SELECT c_custkey, component, unseen, CASE WHEN pl < CAST(floor(0.3 * n) AS BIGINT) THEN 'calib' WHEN pl < CAST(floor(0.3 * n) AS BIGINT) + CAST(floor(0.4 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM r JOIN c USING (c_custkey) LEFT JOIN n USING (component)
""")
def constrained_split(spark, d):
    out = splits.constrained_split(_linked(spark, d), "c_custkey", ["voice", "text"], (F.col("component") * 7919) % 10007, F.col("unseen"))
    return out.select("c_custkey", "component", "unseen", F.col("split").alias("part"))
