"""Channel specifications: `codec[_bitrate][+lossX][+snrY]`, modifiers in any order, the last of a kind counting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codecs and the bit rates in kbit/s that AMR has.
PLAIN = ("clean", "g711a", "g711u")
AMR_NB = (4.75, 5.15, 5.9, 6.7, 7.4, 7.95, 10.2, 12.2)
AMR_WB = (6.6, 8.85, 12.65, 14.25, 15.85, 18.25, 19.85, 23.05, 23.85)
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def parse(spec: Column) -> Column:
    """struct<codec, bitrate_kbps, loss_pct, snr_db, valid>; the other fields are null where the text is no specification."""
    text = F.trim(spec)
    head = F.split(text, r"\+")[0]
    codec = F.regexp_extract(head, r"^([a-z0-9]+)", 1)
    written = F.regexp_extract(head, rf"^[a-z0-9]+_({NUMBER})$", 1)
    rate = F.when(written != "", written.cast("double"))
    snapped = F.when(codec == "amrnb", F.try_element_at(F.filter(F.array(*map(F.lit, AMR_NB)), lambda r: F.abs(r - rate) < 1e-4), F.lit(1))).when(codec == "amrwb", F.try_element_at(F.filter(F.array(*map(F.lit, AMR_WB)), lambda r: F.abs(r - rate) < 1e-4), F.lit(1)))
    parts = F.split(text, r"\+")
    mods = F.slice(parts, F.lit(2), F.size(parts))
    last = lambda kind, number: F.try_element_at(F.transform(F.filter(mods, lambda m: m.rlike(f"^{kind}{number}$")), lambda m: F.regexp_extract(m, f"^{kind}({number})$", 1).cast("double")), F.lit(-1))
    loss, snr = F.coalesce(last("loss", NUMBER), F.lit(0.0)), last("snr", rf"-?{NUMBER}")
    good = F.forall(mods, lambda m: m.rlike(rf"^(loss{NUMBER}|snr-?{NUMBER})$")) & loss.between(0, 100)
    plain = codec.isin(*PLAIN) & (head == codec)
    amr = codec.isin("amrnb", "amrwb") & snapped.isNotNull()
    ok = F.coalesce(good & (plain | amr), F.lit(False))
    return F.struct(F.when(ok, codec).alias("codec"), F.when(ok, snapped).alias("bitrate_kbps"), F.when(ok, loss).alias("loss_pct"), F.when(ok, snr).alias("snr_db"), ok.alias("valid"))


def number(x: Column) -> Column:
    """The shortest form: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")


def canonical(spec: Column) -> Column:
    """The text of a parsed specification; no loss is left out."""
    return F.concat(
        spec["codec"],
        F.when(spec["bitrate_kbps"].isNotNull(), F.concat(F.lit("_"), number(spec["bitrate_kbps"]))).otherwise(""),
        F.when(spec["loss_pct"] > 0, F.concat(F.lit("+loss"), number(spec["loss_pct"]))).otherwise(""),
        F.when(spec["snr_db"].isNotNull(), F.concat(F.lit("+snr"), number(spec["snr_db"]))).otherwise(""),
    )


def target_rate(codec: Column, sr: Column) -> Column:
    return F.when(codec.isin("g711a", "g711u", "amrnb"), 8000).when(codec == "amrwb", 16000).otherwise(sr)
