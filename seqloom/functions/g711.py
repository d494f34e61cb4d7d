"""G.711 companding as column expressions on 16-bit samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the G.711 laws.
ALAW_SEGMENTS = (32, 64, 128, 256, 512, 1024, 2048)
ULAW_SEGMENTS = (256, 512, 1024, 2048, 4096, 8192, 16384)
ULAW_BIAS = 132
PCM_MOST = 32767


def _segment(a: Column, edges: tuple[int, ...]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + F.when(a >= e, 1).otherwise(0)
    return out


def _shift_right(x: Column, n: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2), n)).cast("int")


def _shift_left(x: Column, n: Column) -> Column:
    return (x * F.pow(F.lit(2), n)).cast("int")


def alaw_encode(pcm: Column) -> Column:
    a = F.shiftright(F.least(F.abs(pcm), F.lit(PCM_MOST)).cast("int"), 3)
    s = _segment(a, ALAW_SEGMENTS)
    m = F.when(s == 0, _shift_right(a, F.lit(1))).otherwise(_shift_right(a, s)).bitwiseAND(F.lit(15))
    sign = F.when(pcm >= 0, 0x80).otherwise(0)
    return (sign + s * 16 + m).bitwiseXOR(F.lit(0x55)).cast("int")


def alaw_decode(code: Column) -> Column:
    c = code.bitwiseXOR(F.lit(0x55))
    s, m = F.shiftright(c, 4).bitwiseAND(F.lit(7)), c.bitwiseAND(F.lit(15))
    x = F.when(s == 0, m * 16 + 8).otherwise(_shift_left(m * 16 + 0x108, s - 1))
    return F.when(c.bitwiseAND(F.lit(0x80)) == 0, -x).otherwise(x).cast("int")


def ulaw_encode(pcm: Column) -> Column:
    a = F.least(F.abs(pcm) + ULAW_BIAS, F.lit(PCM_MOST)).cast("int")
    s = _segment(a, ULAW_SEGMENTS)
    m = _shift_right(a, s + 3).bitwiseAND(F.lit(15))
    sign = F.when(pcm < 0, 0x80).otherwise(0)
    return (255 - (sign + s * 16 + m)).cast("int")


def ulaw_decode(code: Column) -> Column:
    c = 255 - code
    s, m = F.shiftright(c, 4).bitwiseAND(F.lit(7)), c.bitwiseAND(F.lit(15))
    x = _shift_left(m * 8 + ULAW_BIAS, s) - ULAW_BIAS
    return F.when(c.bitwiseAND(F.lit(0x80)) != 0, -x).otherwise(x).cast("int")


def to_pcm(x: Column) -> Column:
    """Samples in [-1, 1] as 16-bit numbers, cut towards zero."""
    return F.greatest(F.lit(-32768), F.least(F.lit(PCM_MOST), (x * PCM_MOST).cast("int"))).cast("int")


def from_pcm(pcm: Column) -> Column:
    return pcm.cast("double") / PCM_MOST


def round_trip(x: Column, law: str) -> Column:
    encode, decode = {"alaw": (alaw_encode, alaw_decode), "ulaw": (ulaw_encode, ulaw_decode)}[law]
    return from_pcm(decode(encode(to_pcm(x))))
