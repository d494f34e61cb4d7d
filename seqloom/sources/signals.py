"""Sources of samples and bits: WAV files, PCM messages, bit strings, pseudorandom generators."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Fixed numbers of the RIFF format: whole numbers, floating point, and "see the extension".
WAV_PCM, WAV_FLOAT, WAV_EXTENSIBLE = 1, 3, 0xFFFE


def decoded_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples (-1 to 1) of a RIFF file: its chunks are walked, odd ones are padded, unknown ones are passed
    over. 8, 16, 24 and 32 bit, 32 and 64-bit floating point; a ValueError says why a file is none of these."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, head = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("short format chunk")
            kind, channels, rate, _, align, width = struct.unpack("<HHIIHH", body[:16])
            if kind == WAV_EXTENSIBLE:
                if len(body) < 26:
                    raise ValueError("short format extension")
                kind = int.from_bytes(body[24:26], "little")
            if not channels or not rate or align != channels * ((width + 7) // 8):
                raise ValueError("format makes no sense")
            head = kind, channels, rate, width
        elif name == b"data":
            if head is None:
                raise ValueError("samples before the format")
            kind, channels, rate, width = head
            # a file that was cut off, or a stream's unknown size, has what is there
            body = body[: len(body) // (channels * ((width + 7) // 8)) * channels * ((width + 7) // 8)]
            return rate, _samples(body, kind, width).reshape(-1, channels).mean(axis=1).astype(np.float32)
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _samples(body: bytes, kind: int, width: int) -> np.ndarray:
    if kind == WAV_FLOAT and width in (32, 64):
        x = np.frombuffer(body, f"<f{width // 8}").astype(float)
        return np.clip(np.where(np.isfinite(x), x, 0.0), -1, 1)
    if kind != WAV_PCM or width not in (8, 16, 24, 32):
        raise ValueError(f"format {kind} of {width} bits")
    if width == 8:
        return (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    if width == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        return wide.reshape(-1).view("<i4") / 2**31
    return np.frombuffer(body, f"<i{width // 8}") / 2 ** (width - 1)


def decoded(files: DataFrame, most_bytes: int = 50_000_000) -> DataFrame:
    """path, status, problem, sr, samples of each of files (path, content): 200, or 413 if it is larger than `most_bytes`
    (not decoded), or 400 with the reason if it is empty, null or no audio that is known here. No file is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if content is not None and len(content) > most_bytes:
                    out.append((path, 413, "too large", None, None))
                    continue
                try:
                    rate, x = decoded_wav(bytes(content or b""))
                    out.append((path, 200, None, rate, x))
                except ValueError as problem:
                    out.append((path, 400, str(problem), None, None))
            yield pd.DataFrame(out, columns=["path", "status", "problem", "sr", "samples"]).astype({"sr": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, status int, problem string, sr int, samples array<float>")


def wav_clips(spark: SparkSession, path: str) -> DataFrame:
    """path, sr, samples (mono, -1 to 1) of WAV files; a file that is none has null samples."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return decoded(files).select("path", "sr", "samples")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def pcm16(message: pd.Series) -> pd.Series:
    """Little-endian 16-bit samples as numbers in [-1, 1); an odd last byte is left out."""
    parts = [b"" if b is None else bytes(b)[: len(b) // 2 * 2] for b in message]
    x = (np.frombuffer(b"".join(parts), "<i2") / 32768).astype(np.float32)  # the batch at once
    ends = np.cumsum([len(p) // 2 for p in parts])
    return pd.Series([None if b is None else v for b, v in zip(message, np.split(x, ends[:-1]), strict=True)], index=message.index) if len(parts) else message


def bit_string(text: Column) -> Column:
    """The bits of a string of 0 and 1; null if it has anything else."""
    return F.when(text.rlike("^[01]*$"), F.filter(F.transform(F.split(text, ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int")), lambda x: x.isNotNull()))


#: Fixed taps of the 32-bit feedback register.
LFSR_TAPS = (31, 21, 1, 0)


def feedback_register(seed: int, n: int) -> np.ndarray:
    """n bits of the register: each is the sum modulo 2 of the bits tap + 1 places before it, the register's own 32
    being before the second. The same sum holds for places 2, 4, 8 ... times as far, so that ever longer runs are added at once."""
    state = seed & 0xFFFFFFFF or 1
    out = np.empty(max(n, 1) + 31, np.uint8)
    out[:32] = [state >> k & 1 for k in range(31, -1, -1)]
    at, step = 32, 1
    while at < len(out):
        while at >= 2 * step * (max(LFSR_TAPS) + 1):
            step *= 2
        end = min(at + step, len(out))
        out[at:end] = np.bitwise_xor.reduce([out[at - (t + 1) * step : end - (t + 1) * step] for t in LFSR_TAPS])
        at = end
    return out[31 : 31 + n]


def generated_bits(spark: SparkSession, kind: str, n: int, seeds: list[int] | DataFrame) -> DataFrame:
    """clip, i, bit: n bits from each seed (a list, or a table with a column clip). kind: urandom, mt (Mersenne Twister) or lfsr (32-bit feedback register)."""
    if kind not in ("urandom", "mt", "lfsr"):
        raise ValueError(f"unknown generator {kind!r}")

    def one(seed: int) -> np.ndarray:
        if kind == "urandom":
            return np.unpackbits(np.frombuffer(os.urandom(-(-n // 8)), np.uint8))[:n]
        if kind == "mt":
            return np.random.Generator(np.random.MT19937(seed)).integers(0, 2, n, dtype=np.uint8)
        return feedback_register(seed, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed in pdf["clip"].tolist():
                x = one(seed)
                for at in range(0, n, 100_000):
                    part = x[at : at + 100_000]
                    yield pd.DataFrame({"clip": seed, "i": np.arange(at, at + len(part)), "bit": part.astype(np.int32)})

    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(s,) for s in seeds], "clip long").repartition(max(1, len(seeds)))
    return seeds.select(F.col("clip").cast("long")).mapInPandas(run, "clip long, i long, bit int")


def vowel(spark: SparkSession, sr: int = 16000, seconds: float = 2.0, pitch: float = 140.0, gap: float = 0.25) -> DataFrame:
    """clip, i, x: a harmonic tone with formants at 500, 1500 and 2500 Hz; the last `gap` of each second is silent."""
    t = F.col("i") / sr
    wave_ = sum((F.sin(2 * np.pi * pitch * k * t) * float(sum(1 / (1 + ((pitch * k - f) / 150.0) ** 2) for f in (500, 1500, 2500))) for k in range(1, int(sr / 2 / pitch))), F.lit(0.0))
    return spark.range(int(sr * seconds)).select(F.lit("vowel").alias("clip"), F.col("id").alias("i")).withColumn("x", F.when((t % 1) < 1 - gap, wave_ / 4).otherwise(0.0))
