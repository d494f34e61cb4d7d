import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import channel_spec, g711, scalars


@pytest.mark.parametrize("law", ["alaw", "ulaw"])
def test_companding_over_the_whole_domain(spark, law):
    encode, decode = (g711.alaw_encode, g711.alaw_decode) if law == "alaw" else (g711.ulaw_encode, g711.ulaw_decode)
    t = spark.range(-32768, 32768).select(F.col("id").cast("int").alias("pcm")).withColumn("code", encode(F.col("pcm"))).withColumn("back", decode(F.col("code"))).withColumn("again", encode(F.col("back"))).toPandas()
    assert set(t["code"]) == set(range(256))
    loud = t[t["pcm"].abs() > 256]
    assert ((loud["back"] - loud["pcm"]).abs() <= loud["pcm"].abs() * 0.07 + 16).all()
    noise = ((t["back"] - t["pcm"]) ** 2).mean()
    assert 10 * math.log10((t["pcm"].astype(float) ** 2).mean() / noise) >= 30
    same = t["code"] == t["again"]
    assert same.mean() > 0.999


def test_specs(spark):
    specs = ["clean", "amrnb_12.2+loss10+snr20", "amrnb_12.2+snr20+loss10", "g711a+loss0", "amrwb_6.60", "amrnb", "clean_8", "clean+loss101", "x", "", None]
    rows = spark.createDataFrame([(s,) for s in specs], "s string").select("s", channel_spec.parse(F.col("s")).alias("p")).select("s", "p.valid", channel_spec.canonical(F.col("p")).alias("c")).collect()
    got = {r["s"]: (r["valid"], r["c"]) for r in rows}
    assert got["amrnb_12.2+loss10+snr20"] == got["amrnb_12.2+snr20+loss10"] == (True, "amrnb_12.2+loss10+snr20")
    assert got["g711a+loss0"] == (True, "g711a") and got["amrwb_6.60"] == (True, "amrwb_6.6")
    assert not any(got[s][0] for s in ("amrnb", "clean_8", "clean+loss101", "x", "", None))


def test_tails_and_thresholds(spark):
    assert abs(scalars.z_threshold(0.01, 12) - 3.34) < 0.01
    upper, lower = scalars.barriers(0.01, 0.05)
    assert abs(upper - math.log(95)) < 1e-12 and lower < 0
    row = spark.createDataFrame([(3.0,)], "x double").select(scalars.chi2_tail(F.col("x"), 4).alias("a"), scalars.chi2_tail(F.col("x"), 1).alias("b"), scalars.two_sided_p(F.col("x")).alias("c"), scalars.logit(F.lit(0.5)).alias("d")).first()
    assert abs(row["a"] - math.exp(-1.5) * 2.5) < 1e-12
    assert abs(row["b"] - math.erfc(math.sqrt(1.5))) < 1e-12 and abs(row["c"] - math.erfc(3 / math.sqrt(2))) < 1e-12 and row["d"] == 0


def test_identifiers(spark):
    t = spark.createDataFrame([(None, "abc"), ("s1", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in t.select(scalars.speaker_id([F.col("a")], [F.col("b")])).collect()] == ["90015098", "s1", "unknown"]
    one = spark.range(1).select(scalars.clip_id(F.lit("live"), F.lit(7)).alias("a"), scalars.listed(F.lit(" a, ,b")).alias("b"), scalars.parsed_check_id(F.lit("A_bit_w16_fwd"))["w"].alias("w"), scalars.file_name(F.lit("amrnb_12.2")).alias("f")).first()
    assert (one["a"], one["b"], one["w"], one["f"]) == ("live_0007", ["a", "b"], 16, "amrnb_12_2")


def test_resampling_and_noise():
    from seqloom.operators.signal import pink_noise, resampled

    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    y = resampled(x, 1, 2)
    assert len(y) == 8000
    peak = np.abs(np.fft.rfft(y)).argmax() * 8000 / len(y)
    assert abs(peak - 440) <= 5
    n = pink_noise(4096, 1)
    assert abs(n.mean()) < 1e-9 and abs(n.std() - 1) < 1e-9


def test_erfc(spark):
    import math

    xs = [0.0, 1e-9, 0.1, 0.7, 1.5, 2.4999, 2.5, 3.0, 6.0, 12.0, 26.0]
    t = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", scalars.erfc(F.col("x")).alias("y"), scalars.two_sided_p(-F.col("x")).alias("p"))
    for r in t.collect():
        if r["x"] is None:
            assert r["y"] is None and r["p"] is None
        else:
            assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-11) and r["p"] == pytest.approx(math.erfc(r["x"] / math.sqrt(2)), rel=1e-11)


def test_many_modifiers(spark):
    text = "g711a" + "+loss1" * 120
    got = spark.createDataFrame([(text + "+loss7",), (text + "+nonsense",)], "s string").select(channel_spec.parse(F.col("s")).alias("p")).collect()
    assert got[0]["p"]["loss_pct"] == 7.0 and not got[1]["p"]["valid"]


def test_functions_import_the_package_at_the_top_only():
    """Executors have no copy of the package: an import of it inside a function that travels to them would fail there."""
    import ast
    from pathlib import Path

    import seqloom

    root = Path(seqloom.__file__).parent
    for path in (p for folder in ("functions", "operators", "sources", "streaming") for p in (root / folder).glob("*.py")):
        inner = [n for f in ast.walk(ast.parse(path.read_text())) if isinstance(f, ast.FunctionDef) for n in ast.walk(f)]
        assert not [n.lineno for n in inner if isinstance(n, ast.ImportFrom) and (n.level or (n.module or "").startswith("seqloom"))], path
