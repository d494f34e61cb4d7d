"""Best-fit packing of token sequences (operator 9).

Texts are tokenised once, cut into pieces of at most `capacity` tokens, and written to the shared folder. Pieces are
then dealt to groups of about `per_task` items; each group packs its own by best fit, largest first. Bins within
`slack` of full are done; the others go up the tree as items of their own, dealt to fewer groups, and so on until one
group is left or a round merges next to nothing. A group is bounded at every level.

Null texts are empty. A document with no token still has the end token. Repeated rows are packed each. Rows keep their
doc_id, null or repeated, and need no unique one. Empty tables give empty results.
"""

from __future__ import annotations

import math
import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small_batches, stored
from .text import LOWER, U, blocks, word_hashes, words

END = 0


PUNCTUATION, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of the parts of a block that the tokenizer takes for themselves, ASCII in lower case:
    words, and the punctuation that ends a word after an ASCII letter or digit. Words that may hold a special token's
    string (it has <|) stay as they are."""
    start, end, row = words(data, off)
    low = LOWER[data]
    special = np.zeros(len(start), bool)
    if len(data) > 1:
        special[np.searchsorted(start, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1] = True
    for i in np.flatnonzero(special):
        low[start[i] : end[i]] = data[start[i] : end[i]]
    core = end.copy()
    going = np.flatnonzero(~special)
    while len(going):
        going = going[(core[going] > start[going]) & PUNCTUATION[low[core[going] - 1]]]
        core[going] -= 1
    two = (core > start) & (core < end) & ~special
    two[two] = ALNUM[low[core[two] - 1]]
    core = np.where(two, core, end)
    parts = 1 + two
    first = np.cumsum(parts) - parts
    begin, stop = np.repeat(start, parts), np.repeat(end, parts)
    stop[first] = core
    begin[first[two] + 1] = core[two]
    return low, begin, stop, np.repeat(row, parts)


class Known:
    """Token ids of parts by hash, in sorted arrays of at most `most` bytes. When they are full, the parts that were
    asked for since the last time stay, if they fill at most half of the room."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.asked, self.flat = np.zeros(0, bool), np.zeros(0, np.uint32)

    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.size, self.asked, self.flat))

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[found] == keys
        self.asked[found[hit]] = True
        return ~hit

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """keys: sorted, none of them known."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        at = len(self.flat) + np.cumsum(size) - size
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.asked, self.flat = np.insert(self.asked, place, True), np.concatenate((self.flat, flat))

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of known keys begin in `flat`, and how many they are."""
        found = np.searchsorted(self.keys, keys)
        return self.at[found].astype(np.int64), self.size[found].astype(np.int64)

    def shrink(self) -> None:
        if self.bytes() <= self.most:
            return
        kept, size = self.asked, self.size[self.asked].astype(np.int64)
        before = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.at[kept] - before, size) + np.arange(int(size.sum()))]
        self.keys, self.at, self.size, self.asked = self.keys[kept], before.astype(np.int32), size.astype(np.int32), np.zeros(len(size), bool)
        if self.bytes() > self.most // 2:
            self.clear()


def _pieces(tokenizer_file: str, capacity: int, held: int = 24 << 20):
    """Token ids are those of whole texts: the tokenizer drops white space and never joins what it parts, so that each
    distinct part is tokenised once a block. A worker process keeps parts that it knows over its tasks, at most `held`
    bytes of them; a lost worker loses nothing but time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        shared = vars(sys.modules.setdefault("seqloom_worker", types.ModuleType("seqloom_worker")))
        if shared.get("file") != tokenizer_file:
            shared |= {"file": tokenizer_file, "tokenizer": Tokenizer.from_file(tokenizer_file), "known": Known(held)}
        tokenizer, known = shared["tokenizer"], shared["known"]
        for batch in batches:
            for a, b, data, off in blocks(batch.column("text")):
                data, start, end, row = units(data, off)
                distinct, first, inverse = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
                new = np.flatnonzero(known.missing(distinct))
                raw = data.tobytes()
                encoded = tokenizer.encode_batch_fast([raw[start[i] : end[i]].decode("utf-8", "replace") for i in first[new].tolist()], add_special_tokens=False)
                known.add(distinct[new], [x.ids for x in encoded])
                del encoded, raw
                at, size = known.slots(distinct)
                count = size[inverse]
                total = int(count.sum())
                before = np.cumsum(count) - count
                out = np.full(total + b - a, END, np.uint32)
                step = np.arange(total)
                out[step + np.repeat(row, count)] = known.flat[np.repeat(at[inverse] - before, count) + step]
                known.shrink()
                length = np.bincount(row, weights=count, minlength=b - a).astype(np.int64) + 1 if total else np.ones(b - a, np.int64)
                begin = np.cumsum(length) - length
                n = -(-length // capacity)
                owner = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                left = np.minimum(capacity, length[owner] - piece * capacity)
                crc = [zlib.crc32(out[s : s + k].astype("<u4").tobytes()) for s, k in zip(begin[owner] + piece * capacity, left, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(left, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, in the order given, and the fill of each bin.

    An item goes to the bin that it leaves the least room in; `open_` has a bit for every room that some bin has."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    to, offset, fill = [], [], []
    for n in sizes:
        fit = open_ >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, k = capacity, len(fill)
            fill.append(0)
        to.append(k)
        offset.append(fill[k])
        fill[k] += n
        if r - n:
            room[r - n].append(k)
            open_ |= 1 << (r - n)
    return to, offset, fill


def _pack(capacity: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "item"], ascending=[False, True], ignore_index=True)
        to, offset, fill = best_fit(pdf["fill"].tolist(), capacity)
        to = np.array(to, np.int64)
        name = (level << 58) + (int(pdf["bucket"].iloc[0]) << 26)
        return pd.DataFrame({"item": pdf["item"], "bin": name + to, "at": np.array(offset, np.int64), "bin_fill": np.array(fill, np.int64)[to]})

    return run


def pack(items: DataFrame, capacity: int, slack: int | None = None, per_task: int = 50_000) -> DataFrame:
    """items (item long, fill long) -> (item, sequence_id, offset)."""
    slack = capacity // 128 if slack is None else slack
    placed, level, count = None, 0, items.count()
    while True:
        groups = max(1, math.ceil(count / per_task))
        dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
        now = stored(dealt.groupBy("bucket").applyInPandas(_pack(capacity, level), "item long, bin long, at long, bin_fill long"))
        if placed is None:
            placed = now.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
        else:
            up = now.select(F.col("item").alias("sequence_id"), "bin", "at")
            placed = placed.join(up, "sequence_id", "left").select("item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
        items = now.where(F.col("bin_fill") < capacity - slack).groupBy("bin").agg(F.first("bin_fill").alias("fill")).withColumnRenamed("bin", "item")
        left = items.count()
        if groups == 1 or not left or left > 0.98 * count:
            return placed
        level, count = level + 1, left


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = 2048, per_task: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(str(tokenizer_file), capacity), schema).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(pieces.select("item", F.col("length").alias("fill")), capacity, per_task=per_task)
    return pieces.join(placed, "item").drop("item")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
