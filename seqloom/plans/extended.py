"""More queries over the driver's tables: reports, profiles, detectors, evaluation, channels, streams and small operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import channel_spec, scalars
from ..operators import channel, decisions, detector, evaluation, predictors, profiles, randomness, reports, signal
from ..operators import sequences as S
from ..sources import manifest, shared, signals
from ..streaming import scoring
from ..streaming.verdicts import streaming_sprt
from .catalogue import A_SQL, B_SQL, E_SQL, I_SQL, M_SQL, R_SQL, SCORED_SQL, SPEC_SQL, SPRT_SQL, _centred, bits, calls, events, items, manifest_rows, query, r6, scored, specified

ODD_FACTORIALS = [float(math.prod(range(1, 2 * k + 2, 2))) for k in range(70)]


def erfc_sql(square2: str) -> str:
    """erfc(x) by its series, of twice the square of x (x below 5)."""
    series = f"list_sum(list_transform(range(0, 70), lambda k: pow({square2}, k) / ({ODD_FACTORIALS})[k + 1]))"
    return f"(1 - 2 / sqrt(pi()) * exp(-({square2}) / 2) * sqrt(({square2}) / 2) * {series})"


def even_tail_sql(x: str, df: int) -> str:
    return f"exp(-({x}) / 2) * list_sum(list_transform(range(0, {df // 2}), lambda k: pow(({x}) / 2, k) / ([{', '.join(str(float(math.factorial(k))) for k in range(df // 2))}])[k + 1]))"


def deltas_sql(w: int) -> str:
    """dl<w>: clip, n_test, delta of the counting predictor on contexts of w bits."""
    code = " + ".join(f"{1 << k} * lag(bit, {k + 1}) OVER z" for k in range(w))
    return f"""
w{w} AS (SELECT clip, i - {w} AS i, {code} AS ctx, bit AS y, i AS j FROM b WINDOW z AS (PARTITION BY clip ORDER BY i)),
h{w} AS (SELECT clip, i, ctx, y, floor(0.8 * count(*) OVER (PARTITION BY clip)) AS cut FROM w{w} WHERE j >= {w}),
t{w} AS (SELECT clip, ctx, CAST(2 * sum(y) > count(*) AS INTEGER) AS guess FROM h{w} WHERE i < cut GROUP BY ALL),
dl{w} AS (SELECT h{w}.clip, {w} AS w, count(*) AS n_test, avg(CAST(coalesce(guess, 0) = y AS INTEGER)) - 0.5 AS delta FROM h{w} LEFT JOIN t{w} USING (clip, ctx) WHERE i >= cut GROUP BY h{w}.clip)"""


WS = (2, 3, 4)
DELTAS_SQL = ", ".join(deltas_sql(w) for w in WS) + ", dl AS (" + " UNION ALL ".join(f"SELECT * FROM dl{w}" for w in WS) + ")"


def deltas(spark, d):
    """clip, mode, w, dir, n_test, delta, check_id of the counting predictor, for three windows."""
    out = randomness.counted_predictors(bits(spark, d), "bit", WS).select("clip", F.lit("bit").alias("mode"), "w", F.lit("fwd").alias("dir"), "n_test", "delta")
    return out.withColumn("check_id", scalars.check_id(F.lit("A"), F.col("mode"), F.col("w"), F.col("dir")))


def segments_of(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("clip"), F.concat(F.lit("c"), F.col("s_suppkey") % 2).alias("channel"), F.col("s_nationkey").alias("speaker"))


SEG_SQL = "sg AS (SELECT s_suppkey AS clip, 'c' || (s_suppkey % 2) AS channel, s_nationkey AS speaker FROM supplier)"


# scans, splits, small operators


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def manifest_scan(spark, d):
    return manifest.load(spark, f"{d}/embeddings.parquet", split="all", label=3).select("vec_id", "label")


@query(f"""
WITH {M_SQL}, p AS (SELECT DISTINCT speaker FROM m), q AS (SELECT speaker, row_number() OVER (ORDER BY (speaker * 7919) % 10007, speaker) - 1 AS pos, count(*) OVER () AS n FROM p)
SELECT c_custkey, label, CASE WHEN pos < CAST(floor(0.3 * n) AS BIGINT) THEN 'calib' WHEN pos < CAST(floor(0.3 * n) AS BIGINT) + CAST(floor(0.4 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM m JOIN q USING (speaker)
""")
def split_membership(spark, d):
    rows = manifest_rows(spark, d).drop("split")
    return manifest.membership(rows, manifest.speaker_split(rows, "speaker", (F.col("speaker") * 7919) % 10007), "speaker").select("c_custkey", "label", F.col("split").alias("part"))


@query("""
WITH q AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY (n_nationkey * 7) % 26, n_nationkey) - 1 AS pos FROM nation)
SELECT id, CASE WHEN pos < 7 THEN 'calib' WHEN pos < 17 THEN 'train' ELSE 'test' END AS split FROM q
""")
def row_split(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.lit("only").alias("speaker"))
    return manifest.row_split(t, "speaker", [(F.col("id") * 7) % 26, F.col("id")]).select("id", "split")


@query("SELECT n_name AS name, 0 AS part FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT s_name, 2 FROM supplier")
def chained_sources(spark, d):
    tables = (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))
    return manifest.chained(*(spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("name")) for t, c in tables))


@query("SELECT vec_id, len(embedding[1:20]) AS n, CAST(embedding[20] AS DOUBLE) AS last FROM embeddings")
def first_seconds(spark, d):
    t = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.lit(10).alias("sr"), F.col("embedding").alias("samples"))
    return manifest.first_seconds(t, 2).select("vec_id", F.size("samples").cast("long").alias("n"), F.element_at("samples", -1).cast("double").alias("last"))


@query("SELECT page_id, CASE WHEN coalesce(strlen(html), 0) = 0 THEN 400 WHEN strlen(html) > 2000 THEN 413 ELSE 200 END AS status FROM pages")
def upload_status(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("html").cast("binary").alias("content"))
    return manifest.uploads(t, 2000).select("page_id", "status")


@query("SELECT c_nationkey AS speaker, count(DISTINCT c_mktsegment) AS splits FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def shared_speakers(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("speaker"), "c_mktsegment")
    return manifest.disjoint(t, "speaker", "c_mktsegment").select("speaker", "splits")


@query("""
WITH p AS (SELECT s_nationkey AS channel, avg(s_acctbal) AS mu FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1), z AS (SELECT mu FROM p WHERE channel = (SELECT min(channel) FROM p))
SELECT c_custkey, round(coalesce(p.mu, z.mu), 6) AS mu FROM customer LEFT JOIN p ON channel = c_nationkey CROSS JOIN z
""")
def profile_fallback(spark, d):
    p = spark.read.parquet(f"{d}/supplier.parquet").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").cast("string").alias("channel")).agg(F.avg("s_acctbal").alias("mu"))
    base = p.agg(F.min(F.col("channel").cast("int"))).first()[0]
    t = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("string").alias("channel"))
    return manifest.with_fallback(t, p, base=str(base)).select("c_custkey", r6("mu").alias("mu"))


@query("SELECT 'g' || (n % 3) AS generator, n_nationkey % 5 AS seed, max(CASE WHEN r = 'AFRICA' THEN v END) AS \"AFRICA\", max(CASE WHEN r = 'ASIA' THEN v END) AS \"ASIA\" FROM (SELECT n_nationkey AS n, n_nationkey, r_name AS r, n_nationkey * 3 AS v FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL")
def comparison_pivot(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = t.select(F.concat(F.lit("g"), F.col("n_nationkey") % 3).alias("generator"), (F.col("n_nationkey") % 5).alias("seed"), F.col("r_name").alias("check"), (F.col("n_nationkey") * 3).alias("v"))
    return reports.comparison_table(t, ["generator", "seed"], "check", "v", ["AFRICA", "ASIA"])


@query(f"""
WITH v AS (SELECT o_orderkey AS id, o_totalprice / 600000 AS p, o_orderpriority AS s, o_custkey AS c FROM orders), u AS (SELECT *, greatest(least(p, 1 - 1e-7), 1e-7) AS pc FROM v)
SELECT id, round(ln(pc / (1 - pc)), 6) AS logit, round(ln(greatest(least(p, 1 - 1e-9), 1e-9) / greatest(least(1 - p, 1 - 1e-9), 1e-9)), 6) AS ratio, round({scalars.z_threshold(0.01, 12)!r} / (2 * sqrt(c + 1)), 6) AS epsilon,
 round(2 * exp(-p * p / 2), 6) AS rough_p, round(pow(10, p / 20), 6) AS from_db, round(20 * log10(p + 1), 6) AS to_db, s || '_' || lpad(CAST(c AS VARCHAR), CAST(greatest(4, len(CAST(c AS VARCHAR))) AS INTEGER), '0') AS clip_id,
 coalesce(CASE WHEN c % 3 = 0 THEN 'named' END, substr(md5(s), 1, 8), 'unknown') AS speaker, replace('amrnb_12.2', '.', '_') AS file, array_to_string(list_filter(list_transform(string_split(' a, ,b,' || s, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS listed, round({erfc_sql('p * p')}, 6) AS tail
FROM u
""")
def scalar_functions(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 600000).alias("p"), F.col("o_orderpriority").alias("s"), F.col("o_custkey").alias("c"))
    p, c, s = F.col("p"), F.col("c"), F.col("s")
    return t.select(
        "id", r6(scalars.logit(p)).alias("logit"), r6(scalars.log_ratio(p, 1 - p)).alias("ratio"), r6(scalars.epsilon(F.lit(scalars.z_threshold(0.01, 12)), c + 1)).alias("epsilon"), r6(scalars.two_sided_p_rough(p)).alias("rough_p"),
        r6(scalars.ratio_from_db(p)).alias("from_db"), r6(scalars.db_from_ratio(p + 1)).alias("to_db"), scalars.clip_id(s, c).alias("clip_id"), scalars.speaker_id([F.when(c % 3 == 0, "named")], [s]).alias("speaker"),
        scalars.file_name(F.lit("amrnb_12.2")).alias("file"), F.array_join(scalars.listed(F.concat(F.lit(" a, ,b,"), s)), "|").alias("listed"), r6(scalars.two_sided_p(p)).alias("tail"),
    )


@query(f"""
WITH {SPEC_SQL}, k AS (SELECT p_partkey, spec, codec || CASE WHEN codec LIKE 'amr%' THEN '_' || regexp_replace(CAST(rate AS VARCHAR), '\\.0$', '') ELSE '' END || CASE WHEN loss > 0 THEN '+loss' || regexp_replace(CAST(CAST(loss AS DOUBLE) AS VARCHAR), '\\.0$', '') ELSE '' END
 || CASE WHEN snr IS NULL THEN '' ELSE '+snr' || regexp_replace(CAST(CAST(snr AS DOUBLE) AS VARCHAR), '\\.0$', '') END AS canonical FROM r WHERE valid)
SELECT p_partkey, spec, canonical, CASE WHEN canonical LIKE 'g711%' OR canonical LIKE 'amrnb%' THEN 8000 WHEN canonical LIKE 'amrwb%' THEN 16000 ELSE 44100 END AS rate FROM k
""")
def channel_spec_canonical(spark, d):
    return specified(spark, d).where("p.valid").select("p_partkey", "spec", channel_spec.canonical(F.col("p")).alias("canonical"), channel_spec.target_rate(F.col("p.codec"), F.lit(44100)).alias("rate"))


REGISTER_BITS = 96


@query(f"""
WITH RECURSIVE r AS (SELECT s_suppkey AS clip, 0 AS i, list_transform(range(32), lambda j: CAST((CASE s_suppkey WHEN 0 THEN 1 ELSE s_suppkey END >> CAST(31 - j AS INTEGER)) & 1 AS INTEGER)) AS h FROM supplier
 UNION ALL SELECT clip, i + 1, list_append(h[2:], xor(xor(h[1], h[11]), xor(h[31], h[32]))) FROM r WHERE i < {REGISTER_BITS - 1})
SELECT CAST(clip AS BIGINT) AS clip, CAST(i AS BIGINT) AS i, h[32] AS bit FROM r
""")
def register_bits(spark, d):
    """The feedback register's bits, a sequence seeded by each supplier's key."""
    seeds = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("clip"))
    return signals.generated_bits(spark, "lfsr", REGISTER_BITS, seeds)


# voicing, symbols, periods


V_SQL = (
    ", vl AS (SELECT clip, frame, x, " + ", ".join(f"lag(x, {k}) OVER w AS y{k}" for k in range(2, 6)) + " FROM v WINDOW w AS (PARTITION BY clip, frame ORDER BY i)), "
    "vr AS (SELECT clip, frame, sum(x * x) AS q0, " + ", ".join(f"coalesce(sum(x * y{k}), 0) AS q{k}" for k in range(2, 6)) + " FROM vl GROUP BY ALL), "
    "vo AS (SELECT clip, frame, q0 > 0 AND greatest(q2, q3, q4, q5) > 0.3 * q0 AS voiced FROM vr)"
)


@query(f"WITH {R_SQL}{V_SQL} SELECT clip, frame, voiced FROM vo")
def voiced_frames(spark, d):
    return signal.voiced_frames(_centred(spark, d), "x", 10, 2, 5)


@query(f"""
WITH {R_SQL.replace('round(', 'round(')}{V_SQL}, rr AS (SELECT clip, frame, round(r0, 9) AS r0, round(r1, 9) AS r1, round(r2, 9) AS r2 FROM r){A_SQL.replace('FROM r)', 'FROM rr)')},
hh AS (SELECT clip, i, frame, x, coalesce(lag(x, 1) OVER w, 0) AS h1, coalesce(lag(x, 2) OVER w, 0) AS h2 FROM v WINDOW w AS (PARTITION BY clip ORDER BY i)),
ee AS (SELECT hh.clip, hh.i, hh.frame, x - a1 * h1 - a2 * h2 AS e FROM hh JOIN a USING (clip, frame)), eb AS (SELECT *, CAST(e > median(e) OVER (PARTITION BY clip, frame) AS INTEGER) AS bit FROM ee)
SELECT eb.clip, row_number() OVER (PARTITION BY eb.clip ORDER BY i) - 1 AS i, bit FROM eb JOIN vo USING (clip, frame) WHERE NOT voiced
""")
def unvoiced_symbols(spark, d):
    return signal.symbols_a(_centred(spark, d), "x", 10, "unvoiced", (2, 5))


@query(f"""
WITH {I_SQL}, l AS (SELECT clip, i, x - 40000 AS x, lag(x) OVER w - 40000 AS p, lead(x) OVER w - 40000 AS n FROM s WINDOW w AS (PARTITION BY clip ORDER BY i)), k AS (SELECT clip, i FROM l WHERE x > 0 AND x > p AND x >= n),
g AS (SELECT clip, i, i - lag(i) OVER (PARTITION BY clip ORDER BY i) AS period FROM k) SELECT clip, i, period FROM g WHERE period / 1000.0 BETWEEN 0.8 / 600 AND 1.2 / 75
""")
def pitch_periods(spark, d):
    return signal.periods(items(spark, d).withColumn("x", F.col("x") - 40000), "x", 1000)


# profiles


@query(f"WITH {SEG_SQL} SELECT channel, count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers, count(*) < 500 OR count(DISTINCT speaker) < 50 AS underpowered FROM sg GROUP BY channel")
def profile_headers(spark, d):
    return profiles.headers(segments_of(spark, d))


PI_SQL = f"""
{SEG_SQL}, x2 AS (SELECT clip, i, lag(bit, 1) OVER z + 2 * lag(bit, 2) OVER z AS ctx, bit FROM b WINDOW z AS (PARTITION BY clip ORDER BY i)), g2 AS (SELECT c AS ctx, y AS bit FROM range(4) r(c), range(2) q(y)),
n2 AS (SELECT clip, ctx, bit, count(*) AS o FROM x2 WHERE ctx IS NOT NULL GROUP BY ALL), cl AS (SELECT DISTINCT clip FROM b), o2 AS (SELECT cl.clip, channel, g2.ctx, g2.bit, coalesce(o, 0) + 1 AS o FROM cl JOIN sg USING (clip) CROSS JOIN g2 LEFT JOIN n2 ON n2.clip = cl.clip AND n2.ctx = g2.ctx AND n2.bit = g2.bit),
tot2 AS (SELECT channel, ctx, bit, sum(o - 1) + 1 AS o FROM o2 GROUP BY ALL), p2 AS (SELECT channel, ctx, bit, o / sum(o) OVER (PARTITION BY channel, ctx) AS p FROM tot2)
"""


@query(f"WITH {B_SQL}, {PI_SQL} SELECT channel, 2 AS \"order\", ctx, CAST(bit AS INTEGER) AS b, round(p, 6) AS p FROM p2")
def profile_transitions(spark, d):
    return profiles.transitions(bits(spark, d), "bit", segments_of(spark, d), (2,)).withColumn("p", r6("p"))


CHI_SQL = "e2 AS (SELECT o2.*, p * sum(o) OVER (PARTITION BY clip, o2.ctx) AS ex FROM o2 JOIN p2 USING (channel, ctx, bit)), c2 AS (SELECT clip, sum(pow(o - ex, 2) / ex) AS chi2 FROM e2 GROUP BY clip)"


@query(f"WITH {B_SQL}, {PI_SQL}, {CHI_SQL} SELECT clip, 2 AS \"order\", round(chi2, 6) AS chi2, round({even_tail_sql('chi2', 4)}, 6) AS p FROM c2")
def markov_reference_p(spark, d):
    b, of = bits(spark, d), segments_of(spark, d)
    out = profiles.markov_p(b, "bit", of, profiles.transitions(b, "bit", of, (2,)), (2,))
    return out.select("clip", "order", r6("chi2").alias("chi2"), r6("p").alias("p"))


@query(f"""
WITH {B_SQL}, {DELTAS_SQL}, {PI_SQL}, {CHI_SQL}, q AS (SELECT dl.*, channel FROM dl JOIN sg USING (clip)), md AS (SELECT channel, w, median(delta) AS m0 FROM q GROUP BY ALL),
ma AS (SELECT q.channel, q.w, any_value(m0) AS m0, coalesce(nullif(median(abs(delta - m0)) * 1.4826, 0), 1e-4) AS s0 FROM q JOIN md USING (channel, w) GROUP BY ALL)
SELECT q.clip, round(max(abs((delta - m0) / s0)), 5) AS s2, count(*) AS n_checks, round(any_value({even_tail_sql('chi2', 4)}), 6) AS chi2_p FROM q JOIN ma USING (channel, w) JOIN c2 USING (clip) GROUP BY q.clip
""")
def segment_analysis(spark, d):
    b, of = bits(spark, d), segments_of(spark, d)
    found = shared.stored(deltas(spark, d))  # a row a clip and check, used three times
    out = profiles.analysed(found, of, profiles.statistics(found, of), profiles.markov_p(b, "bit", of, profiles.transitions(b, "bit", of, (2,)), (2,)), robust=True)
    return out.select("clip", F.round("s2", 5).alias("s2"), "n_checks", r6(F.col("chi2_p")["order_2"]).alias("chi2_p"))


@query(f"""
WITH {B_SQL}, {DELTAS_SQL}, {SEG_SQL}, q AS (SELECT dl.*, channel FROM dl JOIN sg USING (clip))
SELECT channel, 'A_bit_w' || w || '_fwd' AS check_id, round(avg(delta), 6) AS mu0, round(stddev_samp(delta), 6) AS sigma0, count(*) AS n FROM q GROUP BY ALL
""")
def profile_round_trip(spark, d):
    """A profile as JSON, read again."""
    of, config = segments_of(spark, d), {"windows": "2,3,4", "modes": "bit"}
    path = f"{shared.shared_dir(spark)}/profile-{uuid.uuid4().hex}"
    profiles.save(path, profiles.statistics(deltas(spark, d), of), profiles.headers(of), profiles.transitions(bits(spark, d), "bit", of, (2,)), config)
    return profiles.load(spark, path, config)[0].select("channel", "check_id", r6("mu0").alias("mu0"), r6("sigma0").alias("sigma0"), "n")


# reports


def middle_sql(w: int, direction: str) -> str:
    code = " + ".join(f"{1 << k} * lag(bit, {k + 1}) OVER z" for k in range(w))
    name = f"{w}{direction}"
    if direction == "fwd":
        rows = f"SELECT clip, i - {w} AS a, ctx, bit AS y, s, h, n FROM c{name} WHERE i >= {w}"
        train, test = f"a >= greatest(0, s - h) AND a < least(s + h, n - {w})", "a >= s"
    else:
        rows = f"SELECT clip, i AS a, ctx, coalesce(before, fin) AS y, s, h, n FROM c{name} WHERE i >= {w}"
        train, test = f"a <= least(n - 1, s + h) AND a > greatest({w - 1}, s - h)", "a <= s"
    return f"""
c{name} AS (SELECT clip, i, bit, {code} AS ctx, lag(bit, {w + 1}) OVER z AS before, last_value(bit) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin, count(*) OVER (PARTITION BY clip) // 2 AS s, least(count(*) OVER (PARTITION BY clip) // 5, 50) // 2 AS h, count(*) OVER (PARTITION BY clip) AS n FROM b WINDOW z AS (PARTITION BY clip ORDER BY i)),
r{name} AS ({rows}), f{name} AS (SELECT clip, ctx, CASE WHEN sum(y) > 0 THEN pow(sum(y) - count(*) / 2, 2) / (count(*) / 2) ELSE 0 END + CASE WHEN sum(y) < count(*) THEN pow(count(*) - sum(y) - count(*) / 2, 2) / (count(*) / 2) ELSE 0 END AS chi2 FROM r{name} WHERE {train} GROUP BY ALL),
o{name} AS (SELECT clip, {w} AS w, '{direction}' AS dir, count(*) AS tests, avg(chi2) AS chi2, avg({erfc_sql('chi2')}) AS p FROM r{name} JOIN f{name} USING (clip, ctx) WHERE {test} GROUP BY clip)"""


MIDDLES = (3, 8, 16, 32)
MIDDLE = tuple((w, x) for w in MIDDLES for x in ("fwd", "bwd"))
MIDDLE_SQL = ", ".join(middle_sql(w, x) for w, x in MIDDLE) + ", ms AS (" + " UNION ALL ".join(f"SELECT * FROM o{w}{x}" for w, x in MIDDLE) + ")"


@query(f"WITH {B_SQL}, {MIDDLE_SQL} SELECT clip, w, dir, tests, round(chi2, 6) AS chi2, round(p, 6) AS p FROM ms")
def middle_statistics(spark, d):
    return reports.middle_statistics(bits(spark, d), "bit", MIDDLES).select("clip", "w", "dir", "tests", r6("chi2").alias("chi2"), r6("p").alias("p"))


@query(f"WITH {B_SQL}, {MIDDLE_SQL} SELECT clip, CAST(sum(tests) AS BIGINT) AS total, round(sum(chi2 * tests) / sum(tests), 6) AS chi2, round(sum(p * tests) / sum(tests), 6) AS p, sum(p * tests) / sum(tests) > 0.05 AS strong FROM ms GROUP BY clip")
def weighted_statistics(spark, d):
    t = reports.weighted(reports.middle_statistics(bits(spark, d), "bit", MIDDLES), "tests", "chi2", "p")
    return t.select("clip", "total", r6("chi2").alias("chi2"), r6("p").alias("p"), (F.col("p") > 0.05).alias("strong"))


def draw(clip, k):
    return clip * 7919 + k * 104729


PLACES_SQL = "sz AS (SELECT clip, count(*) AS n FROM b GROUP BY clip HAVING count(*) > 64), pl AS (SELECT clip, CAST(k AS INTEGER) AS k, 32 + (clip * 7919 + k * 104729) % (n - 63) AS place FROM sz, range(50) r(k))"


def block_sql(w: int, direction: str) -> str:
    code = " + ".join([f"{1 << k} * lag(bit, {k}) OVER z" for k in range(1, w)] + ["bit"])
    name = f"{w}{direction}"
    first, after = ("place", f"place + {w}") if direction == "fwd" else (f"place - {w}", f"place - {2 * w}")
    return f"""
k{name} AS (SELECT clip, i - {w - 1} AS start, {code} AS code FROM b WINDOW z AS (PARTITION BY clip ORDER BY i)), a{name} AS (SELECT * FROM k{name} WHERE start >= 0),
p{name} AS (SELECT clip, start, code AS ctx, lead(code, {w}) OVER (PARTITION BY clip ORDER BY start) AS nxt, max(start) OVER (PARTITION BY clip) AS last FROM a{name}),
t{name} AS (SELECT clip, ctx, nxt, count(*) AS c, min(start) AS fs FROM p{name} WHERE start < last - {w} GROUP BY ALL), u{name} AS (SELECT clip, ctx, sum(c) AS total, count(*) AS m, arg_max(nxt, struct_pack(c := c, f := -fs)) AS predicted FROM t{name} GROUP BY ALL),
q{name} AS (SELECT pl.*, x.code AS ctx, y.code AS actual FROM pl JOIN a{name} x ON x.clip = pl.clip AND x.start = {first} JOIN a{name} y ON y.clip = pl.clip AND y.start = {after}),
v{name} AS (SELECT q.clip, q.k, q.place, {w} AS w, '{direction}' AS dir, coalesce(predicted, 0) AS predicted, actual, coalesce(c, 0) + 1 AS a1, CASE WHEN c IS NULL THEN 0 ELSE total - c END + 1 AS b1, total - coalesce(c, 0) + 1 AS c1, (m - CASE WHEN c IS NULL THEN 0 ELSE 1 END) * total - (total - coalesce(c, 0)) + 1 AS d1
 FROM q{name} q LEFT JOIN u{name} u ON u.clip = q.clip AND u.ctx = q.ctx LEFT JOIN t{name} t ON t.clip = q.clip AND t.ctx = q.ctx AND t.nxt = q.actual)"""


BLOCKS = tuple((w, x) for w in (8, 16, 32) for x in ("fwd", "bwd"))
BLOCK_SQL = ", ".join(block_sql(w, x) for w, x in BLOCKS) + ", bs AS (SELECT *, CASE WHEN c1 IS NULL THEN 0 ELSE (a1 + b1 + c1 + d1) * pow(greatest(0, abs(a1 * d1 - b1 * c1) - (a1 + b1 + c1 + d1) / 2), 2) / ((a1 + b1) * (c1 + d1) * (a1 + c1) * (b1 + d1)) END AS chi2 FROM (" + " UNION ALL ".join(f"SELECT * FROM v{w}{x}" for w, x in BLOCKS) + "))"


@query(f"WITH {B_SQL}, {PLACES_SQL}, {BLOCK_SQL} SELECT clip, k, place, w, dir, CAST(predicted AS BIGINT) AS predicted, CAST(actual AS BIGINT) AS actual, round(chi2, 6) AS chi2 FROM bs")
def block_statistics(spark, d):
    b = bits(spark, d)
    out = reports.block_statistics(b, "bit", reports.drawn_places(b, 50, draw))
    return out.select("clip", "k", "place", "w", "dir", "predicted", "actual", r6("chi2").alias("chi2"))


E4 = scalars.z_threshold(0.01, 12)


@query(f"WITH {B_SQL}, {DELTAS_SQL} SELECT clip, round(max(delta), 6) AS delta_max, round({E4!r} / (2 * sqrt(arg_max(n_test, w))), 6) AS epsilon, arg_max(n_test, w) AS n_test, max(delta) > {E4!r} / (2 * sqrt(arg_max(n_test, w))) AS is_violation, CASE WHEN max(delta) > {E4!r} / (2 * sqrt(arg_max(n_test, w))) THEN '{reports.VIOLATION}' ELSE '{reports.CONFORMS}' END AS verdict FROM dl GROUP BY clip")
def threshold_verdicts(spark, d):
    out = reports.dissertation_verdicts(deltas(spark, d))
    return out.select("clip", r6("delta_max").alias("delta_max"), r6("epsilon").alias("epsilon"), "n_test", "is_violation", "verdict")


@query()
def prng_verdicts(spark, d):
    """Feedback register and Mersenne Twister under the twelve checks, trained on at most 50 windows."""
    grid, out = manifest.run_grid(spark, ["lfsr", "mt"], [42, 43]), None
    for k, g in enumerate(("lfsr", "mt")):
        one = signals.generated_bits(spark, g, 8000, [42, 43]).select((F.col("clip") + 1000 * k).alias("clip"), "i", "bit")
        out = one if out is None else out.unionByName(one)
    named = grid.select(F.when(F.col("generator") == "mt", 1000).otherwise(0) + F.col("seed"), "generator", "seed").toDF("clip", "generator", "seed")
    return reports.dissertation_verdicts(predictors.checks(out, "bit", most=reports.training_size)).join(named, "clip").select("generator", "seed", "n_test", r6("delta_max").alias("delta_max"), r6("epsilon").alias("epsilon"), "is_violation", "verdict")


def _long_clips(spark, d):
    """Bits of fifty suppliers each, long enough for blocks of 32."""
    order = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.floor(F.col("l_suppkey") / 50).alias("g"), *order)
    return S.binarised(S.indexed(t, "g", order).select("clip", "i", F.col("l_extendedprice").alias("x")), "x", 160).select("clip", "i", "bit")


@query()
def legacy_report(spark, d):
    return reports.full_report(_long_clips(spark, d), "bit", windows=(8, 16)).select("clip", "n", F.to_json("report").alias("report"))


@query()
def legacy_verdicts(spark, d):
    b = _long_clips(spark, d)
    details = reports.network_details(b, "bit", reports.drawn_places(b).select("clip", "place"), (8, 16))
    out = reports.network_verdicts(details, b.groupBy("clip").agg(F.count(F.lit(1)).alias("n")))
    return out.select("clip", r6("delta_max").alias("delta_max"), r6("epsilon").alias("epsilon"), "strong", "verdict_accuracy", "verdict_threshold", F.transform_values("deltas", lambda k, v: F.round(v, 6)).alias("deltas"))


# detectors and evaluation


WEIGHTS = [round(math.sin(k), 6) for k in range(64)]


@query(f"SELECT vec_id, round(greatest(-{math.log((1 - 1e-7) / 1e-7)!r}, least({math.log((1 - 1e-7) / 1e-7)!r}, 0.25 + 2 * list_sum(list_transform(range(1, 65), lambda k: (CAST(embedding[k] AS DOUBLE) - CAST(0.01 AS DOUBLE)) * ({WEIGHTS})[k])))), 5) AS s1 FROM embeddings")
def d1_logit_fixed(spark, d):
    model = detector.Linear([0.01] * 64, [0.5] * 64, WEIGHTS, 0.25)
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select("vec_id", F.round(detector.logit(F.transform("embedding", lambda x: x.cast("double")), model), 5).alias("s1"))


def _d1_features(spark, d):
    clips = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("clip"), F.col("embedding").alias("samples"), (F.col("label") % 2).alias("y"))
    return clips.select("clip", "y").join(signal.lfcc_features(clips, 16, 8000), "clip")


@query()
def d1_logit(spark, d):
    rows = _d1_features(spark, d)
    model = detector.train(rows.where("clip % 10 < 7"))
    return rows.where("clip % 10 >= 7").select("clip", "y", r6(detector.logit(F.col("features"), model)).alias("s1"))


def _scores(spark, d):
    """Two scores of the orders as segments of customers' calls, and a class that they tell something of."""
    t = calls(spark, d).withColumnRenamed("i", "seg")
    y = (F.pmod(F.col("clip") * 7919, F.lit(101)) < 50).cast("int")
    return t.select("clip", "seg", y.alias("y"), (F.col("llr") + 0.8 * y).alias("s1"), (F.abs("llr") + 0.3 * y).alias("s2"), F.concat(F.lit("c"), F.col("clip") % 2).alias("channel"))


@query()
def stage0_report(spark, d):
    t = _scores(spark, d)
    out = evaluation.stage0(t.where("clip % 3 = 0"), t.where("clip % 3 > 0"), ["c0", "c1"])
    return out.select(*(r6(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query()
def calibration_passport(spark, d):
    t = _scores(spark, d)
    return decisions.passport(evaluation.calibration(t.where("clip % 3 = 0"), t.where("clip % 3 > 0"), 400, 60))


@query(f"""
WITH {SPRT_SQL}, f AS (SELECT clip, arg_max(verdict, k) AS v, CAST((clip * 7919) % 101 < 50 AS INTEGER) AS y FROM sp GROUP BY clip)
SELECT round(avg(CAST((y = 0 AND v = 'normal') OR (y = 1 AND v = 'suspicious') AS INTEGER)), 6) AS accuracy, round(avg(CAST(v = 'suspicious' AS INTEGER)) FILTER (y = 0), 6) AS fa_rate, round(avg(CAST(v = 'suspicious' AS INTEGER)) FILTER (y = 1), 6) AS detection_rate,
 count(*) FILTER (y = 0 AND v = 'normal') AS live_normal, count(*) FILTER (y = 1 AND v = 'suspicious') AS spoof_suspicious, count(*) AS total_clips FROM f
""")
def sprt_statistics(spark, d):
    t = decisions.sprt(calls(spark, d), "llr").groupBy("clip").agg(F.max_by("verdict", "k").alias("v")).withColumn("y", (F.pmod(F.col("clip") * 7919, F.lit(101)) < 50).cast("int"))
    out = evaluation.sprt_statistics(t, "v")
    return out.select(*(r6(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query(f"WITH {SCORED_SQL} SELECT y, s, round(0.7 * ln(1 + s) - 0.2 * len(source) - 3, 6) AS llr FROM q")
def calibrated_fixed(spark, d):
    t = scored(spark, d).select("y", "s", F.log1p("s").alias("s1"), F.length("source").alias("s2"))
    return decisions.calibrated(t, ["s1", "s2"], ([0.7, -0.2], -3.0)).select("y", "s", r6("llr").alias("llr"))


# channels


@query(f"""
WITH {E_SQL}, p AS (SELECT clip, i // 10 AS frame, sum(x * x) AS en, count(*) AS n FROM e GROUP BY ALL), q AS (SELECT *, CASE WHEN n = 10 THEN en / n END AS lv, max(CASE WHEN n = 10 THEN en / n END) OVER (PARTITION BY clip) AS top FROM p),
a AS (SELECT clip, coalesce(sum(en) FILTER (lv >= top * 0.001 AND top > 0) / sum(n) FILTER (lv >= top * 0.001 AND top > 0), sum(en) / sum(n)) AS power FROM q GROUP BY clip)
SELECT clip, i, round(x + (i % 7 - 3) / 2.0 * sqrt(CASE WHEN power > 0 THEN power ELSE 1 END / pow(10, 1.2)), 6) AS y FROM e JOIN a USING (clip)
""")
def noise_at_snr(spark, d):
    t = events(spark, d).withColumn("noise", (F.col("i") % 7 - 3) / 2.0)
    return channel.noisy(t, "x", "noise", 12.0, 10).select("clip", "i", r6("y").alias("y"))


@query(f"WITH {E_SQL}, n AS (SELECT clip, count(*) - 2 AS n FROM e GROUP BY clip), g AS (SELECT clip, CAST(unnest(range(0, n)) AS BIGINT) AS i FROM n) SELECT g.clip, g.i, coalesce(e.x, 0.0) AS x FROM g LEFT JOIN e ON e.clip = g.clip AND e.i = g.i + g.clip % 4")
def aligned_clips(spark, d):
    t = events(spark, d).select("clip", "i", "x")
    lags = t.select("clip", (F.col("clip") % 4).alias("lag")).distinct()
    return channel.aligned(t, lags, t.groupBy("clip").agg((F.count(F.lit(1)) - 2).alias("n")))


@query()
def channel_chain(spark, d):
    """Resampling, noise, companding, frame loss and concealment in a row."""
    t = predictors.dealt(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), "vec_id")
    t = t.select(F.col("vec_id").alias("clip"), F.lit(16000).alias("sr"), F.flatten(F.array_repeat("embedding", 20)).alias("samples"))
    out, rate = channel.simulated(t, "g711a", 16000, loss_pct=10.0, snr_db=15.0)
    return out.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), (F.avg("lost") * 100).alias("loss_pct"), r6(F.avg(F.col("y") * F.col("y"))).alias("power"))


# streams


@query(SPRT_SQL.strip().replace("ORDER BY o_orderdate, o_orderkey", "ORDER BY o_orderkey").join(["WITH ", ' SELECT clip, k, round("lambda", 9) AS "lambda", verdict FROM sp']))
def stream_sprt(spark, d):
    """The sequential test as a stream over all that is there; equal to the batch."""
    batch = spark.read.parquet(f"{d}/orders.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{d}/orders.parque[t]")  # a pattern may name a file or a folder
    rows = stream.select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("i"), ((F.col("o_totalprice") - 250000) / 144000).alias("llr"))
    place = f"{shared.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = scoring.finished(rows, f"{place}/out", f"{place}/state", lambda r: streaming_sprt(r, idle_ms=None))
    return out.select("clip", F.col("k").cast("long").alias("k"), F.round("lambda", 9).alias("lambda"), "verdict")


def _scorer(spark, d):
    rows = _d1_features(spark, d)
    checks = {f"A_{m}_w{w}_{x}": (0.0, 0.05) for m, w, x in evaluation.REDUCED}
    return scoring.Scorer(sr=800, model=detector.train(rows), profile=checks, fusion=(0.3, 0.1, -0.2), quota=40)


def _sessions(spark, d):
    """Each label's embeddings as one session of messages."""
    t = spark.read.parquet(f"{d}/embeddings.parquet").groupBy(F.col("label").cast("long").alias("clip")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])).alias("samples"))
    return scoring.messages_of(t, 100)


@query()
def session_scores(spark, d):
    """Whole sessions through the steps of live scoring: segments, both scores, ratio, verdict."""
    out = scoring.replayed(_sessions(spark, d), _scorer(spark, d))
    return out.select("clip", "seg", "t", *(r6(c).alias(c) for c in ("s1", "s2", "llr", "lambda")), "verdict")
