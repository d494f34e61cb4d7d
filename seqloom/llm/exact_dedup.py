"""Exact deduplication (operator 8).

Rows are grouped by the 128-bit MD5 of their text; rows of groups with several members then bring their text, which is
compared by grouping on (hash, text). Where the repeated hashes are few enough for Spark to broadcast them, no other text
leaves its task; beyond that size all texts are dealt by their hash once before those without a copy go. Equal hashes of different texts therefore make different groups. The
members of a hot hash, one with at least `hot_rows` rows and a thousandth of all rows, are dealt to salts in proportion to
its count, so that a task gets about `hot_rows / 10` of them, and each salt sends one row a text on. There are at most a thousand hot hashes, whatever the data:
that table alone is broadcast.

Null texts count as empty. Repeated rows count each; rows that repeat a doc_id share its verdict in `groups`. Of rows that repeat doc_id and
text `deduplicate` keeps one. A null doc_id loses against any other. Empty tables give empty results; other columns are
ignored by `groups` and kept by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import stored


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def groups(docs: DataFrame, keep: str = "max", hot_rows: int = 10_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    keep: "min" or "max" of doc_id is the row that stays. hot_rows: see above."""
    pick = {"min": F.min, "max": F.max}[keep]
    text = _text()
    hashed = docs.select("doc_id", F.unhex(F.md5(text)).alias("_h"), F.unhex(F.sha2(text, 256)).alias("_s"))
    several = stored(docs.select(F.unhex(F.md5(text)).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"))
    copies = several.agg(F.sum("_c")).first()[0] or 0
    # of keys with a thousandth of all copies or more there are a thousand at most
    hot = several.where(F.col("_c") >= max(hot_rows, -(-copies // 1000))).select("_h", F.ceil(F.col("_c") * 10 / hot_rows).cast("int").alias("_p"))
    parts = F.coalesce("_p", F.lit(1))
    salts = several.select("_h").join(F.broadcast(hot), "_h", "left").select("_h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_z"))
    members = docs.select("doc_id", text.alias("_t"), F.unhex(F.md5(text)).alias("_h")).join(F.broadcast(hot), "_h", "left")
    members = members.withColumn("_z", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).drop("_p").join(salts, ["_h", "_z"], "left_semi")
    part = members.groupBy("_h", "_z", "_t").agg(pick("doc_id").alias("_k"), F.count(F.lit(1)).alias("_n"))
    equal = part.groupBy("_h", "_t").agg(pick("_k").alias("_k"), F.sum("_n").alias("_n"))
    # A class is found again by both hashes; should two different texts share both, the query stops rather than err.
    known = (
        equal.select("_h", F.unhex(F.sha2("_t", 256)).alias("_s"), "_k", "_n")
        .groupBy("_h", "_s").agg(F.max("_k").alias("_k"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_c"))
        .select("_h", "_s", "_k", F.when(F.col("_c") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long")).otherwise(F.col("_n")).alias("_n"))
    )
    return hashed.join(known, ["_h", "_s"], "left").select(
        "doc_id",
        F.coalesce("_k", "doc_id").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("_k", "doc_id"), F.col("_k").isNull()).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row of docs for each text, with all columns; of rows that repeat doc_id and text any one."""
    verdicts = groups(docs, keep)
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_hash"))
    text = F.unhex(F.sha2(_text(), 256))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (text == gone["_hash"]), "left_anti")
    again = stored(docs.select("doc_id", text.alias("_hash")).groupBy("doc_id", "_hash").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col("doc_id").alias("_again"), "_hash"))
    if again.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(again["_again"]) & (text == again["_hash"])
    # a task sends one row of each repeated one on, however often it has it
    one = left.join(again, same, "left_semi").withColumn("_own_hash", text).dropDuplicates(["doc_id", "_own_hash"]).drop("_own_hash")
    return left.join(again, same, "left_anti").unionByName(one)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
