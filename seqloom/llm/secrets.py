"""Secret scans (operator 2), with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. A span is found by putting a mark around each match,
cutting at the marks, and adding up the lengths of the parts, so that positions are code points of the text.

The method adds spans. Two character Markov models, one of random strings and one of ordinary tokens, give each token of
`least_chars` or more characters a log-likelihood ratio, whatever its characters are; those above `least_ratio` are spans of
the kind `markov` unless they overlap a base span. The ratio is the lesser of two sums, over all pairs of neighbouring
characters and over the different ones: what repeats (lines of dashes, runs of one character) is no evidence. Pairs with
a separator say nothing, so that names of joined words are judged by their words.

The models are pair counts, smoothed, of labelled samples: random strings are the values that the base rules find and
strings made from digests in several alphabets; ordinary tokens, numbers among them, are those of documents that no rule
touches, but for long ones that mix letters and digits, whose label is unknown. Ordinary words count in either case.
Strings of digits alone are told apart by what the corpus' own numbers look like, which is little. The sample is the
documents of about `most_learned` rows by a hash of their id, a bound on the classifier's sample only; every document is
scanned whole. The models' table has a fixed size (an entry a pair of 65 symbols).

Null texts are empty. Repeated rows are scanned each; a null doc_id is scanned too. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run that fails is shorter throughout
TOKEN = r"[A-Za-z0-9+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYMBOLS = len(ALPHABET) + 1  # all others are one
LOWER_CASE = range(27, 53)
SEPARATORS = {0, 63, 64}  # what joins words: pairs with these say nothing
MARK = "\u0001"


CHUNK = 256


def running(values: Column, start: Column, combine) -> Column:
    """The running combination (sum or maximum) of an array: chunk by chunk, then over the chunks' last values, so that
    no array grows element by element beyond a chunk."""
    def scan(array, first):
        return F.aggregate(array, F.struct(first.alias("last"), F.slice(F.array(first), 1, 0).alias("all")), lambda a, x: F.struct(combine(a["last"], x).alias("last"), F.concat(a["all"], F.array(combine(a["last"], x))).alias("all")))["all"]

    # each step is evaluated once: as a field of a one-element array that the next step maps over
    chunks = F.transform(F.array(values), lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK)))
    inner = F.transform(chunks, lambda cs: F.transform(cs, lambda c: scan(c, start)))
    both = F.transform(inner, lambda cs: F.struct(cs.alias("inner"), scan(F.transform(cs, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), start)), start).alias("tops")))
    done = F.transform(both, lambda z: F.flatten(F.transform(z["inner"], lambda c, i: F.transform(c, lambda x: combine(F.when(i > 0, F.element_at(z["tops"], F.greatest(i, F.lit(1)))).otherwise(start), x)))))
    return F.element_at(done, 1)


def found(text: Column, pattern: str, keep) -> Column:
    """array<struct<s, e, m>>: start, end and string of the leftmost non-overlapping matches that `keep` accepts; text has no MARK."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    ends = F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), running(F.transform(p, lambda x: F.length(x)), F.lit(0), lambda x, y: x + y).alias("ends")))
    spans = F.flatten(
        F.transform(
            ends,
            lambda z: F.transform(
                F.sequence(F.lit(1), (F.size(z["parts"]) / 2).cast("int")),
                lambda i: F.struct(F.element_at(z["ends"], 2 * i - 1).alias("s"), F.element_at(z["ends"], 2 * i).alias("e"), F.element_at(z["parts"], 2 * i).alias("m")),
            ),
        )
    )
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(text.rlike(pattern), F.filter(spans, keep)).otherwise(none)


def apart(spans: Column, base: Column) -> Column:
    """The spans (s, e, m) that overlap none of `base` (s, k, e). All are sorted by place, a span by its end; those of
    base that begin before it count, and it is apart if the furthest end among them is not beyond its start."""
    starts = F.transform(base, lambda b: F.struct(b["s"].alias("p"), F.lit(1).alias("t"), b["e"].alias("v"), F.lit("").alias("m")))
    asked = F.transform(spans, lambda x: F.struct(x["e"].alias("p"), F.lit(0).alias("t"), x["s"].alias("v"), x["m"].alias("m")))
    sorted_ = F.transform(F.array(F.sort_array(F.concat(starts, asked))), lambda z: F.struct(z.alias("at"), running(F.transform(z, lambda x: F.when(x["t"] == 1, x["v"]).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y)).alias("reach")))
    kept = F.transform(sorted_, lambda z: F.filter(F.zip_with(z["at"], z["reach"], lambda x, r: F.struct(x["v"].alias("s"), x["p"].alias("e"), x["m"].alias("m"), ((x["t"] == 0) & (r <= x["v"])).alias("ok"))), lambda x: x["ok"]))
    return F.when((F.size(base) > 0) & (F.size(spans) > 0), F.transform(F.flatten(kept), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))).otherwise(spans)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text (without marks) and the base spans in columns assign, access, hex."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, "\u0002")
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        found(F.col("text"), ASSIGN, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6).alias("assign"),
        found(F.col("text"), ACCESS, lambda x: F.length(x["m"]) >= 20).alias("access"),
        found(F.col("text"), HEX, lambda x: x["e"] > x["s"]).alias("hex"),
    )


def pairs(token: Column) -> Column:
    """Numbers of the pairs of neighbouring symbols."""
    code = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return F.flatten(F.transform(F.array(code), lambda z: F.zip_with(F.slice(z, F.lit(1), F.greatest(F.size(z) - 1, F.lit(0))), F.slice(z, F.lit(2), F.greatest(F.size(z) - 1, F.lit(0))), lambda x, y: x * SYMBOLS + y)))


def made_strings(digest: Column) -> Column:
    """Random strings that a SHA-256 digest (hexadecimal) gives: hexadecimal, base 64 and 62, base 36 and letters of either case."""
    number = lambda k, base: F.conv(F.substring(digest, k, 15), 16, base)
    letters = F.translate(F.lower(number(31, 26)), "0123456789", "qrstuvwxyz")
    return F.array(digest, F.base64(F.unhex(digest)), F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 256))), "[+/=]", ""), F.upper(number(1, 36)), F.lower(number(16, 36)), letters, F.upper(letters))


def learn(docs: DataFrame, most_learned: int, made: int, seed: int, least_chars: int) -> list[float]:
    """The log ratio of the two models for each pair of symbols."""
    spark = docs.sparkSession
    n = docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    sample = scanned(docs.where(F.coalesce(place < min(1.0, most_learned / max(n, 1)), F.lit(False))))
    values = F.concat(F.transform("assign", lambda x: F.regexp_extract(x["m"], ASSIGN, 2)), F.transform("access", lambda x: x["m"]), F.transform("hex", lambda x: x["m"]))
    clean = (F.size("assign") + F.size("access") + F.size("hex")) == 0
    tokens = sample.select(F.when(clean, F.lit(0)).otherwise(F.lit(1)).alias("random"), F.when(clean, F.filter(F.regexp_extract_all("text", F.lit(f"({TOKEN}{{4,}})"), F.lit(1)), lambda x: (F.length(x) < least_chars) | ~x.rlike("[A-Za-z]"))).otherwise(values).alias("tokens"))
    # apart from the arrays, so that an exploded row carries a number and a token only
    rows = tokens.select("random", F.explode("tokens").alias("token"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    strings = spark.range(0, made, 1, 4).select(F.lit(1).alias("random"), F.explode(made_strings(digest)).alias("token"))
    counted = rows.unionByName(strings).select("random", F.explode(pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").count().collect()
    table = [[0] * SYMBOLS**2 for _ in range(2)]
    for r in counted:
        table[r["random"]][r["pair"]] += r["count"]

    # an ordinary token is as ordinary in capitals, and with a capital first
    for a in LOWER_CASE:
        for b in LOWER_CASE:
            c = table[0][a * SYMBOLS + b]
            table[0][(a - 26) * SYMBOLS + b - 26] += c
            table[0][(a - 26) * SYMBOLS + b] += c

    def likelihood(counts: list[int]) -> list[float]:
        """Pairs' chances given the first symbol, mixed with the second symbol's own chance, as not all pairs were seen."""
        alone = [0.5 + sum(counts[b::SYMBOLS]) for b in range(SYMBOLS)]
        alone = [c / sum(alone) for c in alone]
        out, alpha, share = [], 0.5 * SYMBOLS, 0.1
        for a in range(SYMBOLS):
            row = counts[a * SYMBOLS : (a + 1) * SYMBOLS]
            out += [math.log((1 - share) * (c + alpha * p) / (sum(row) + alpha) + share * p) for c, p in zip(row, alone, strict=True)]
        return out

    ordinary, random = map(likelihood, table)
    part = lambda i: not {i // SYMBOLS, i % SYMBOLS} & SEPARATORS
    return [round(r - o, 6) if part(i) else 0.0 for i, (o, r) in enumerate(zip(ordinary, random, strict=True))]


def scan(docs: DataFrame, least_ratio: float = 18.0, least_chars: int = 12, most_learned: int = 10_000, made: int = 2_000, seed: int = 17) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    ratio = F.lit(learn(docs, most_learned, made, seed, least_chars))
    base = scanned(docs)
    long = found(F.col("text"), f"{TOKEN}{{{least_chars},}}", lambda x: x["e"] > x["s"])
    of = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(c)).alias("k"), x["e"].alias("e")))
    spans = base.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), F.concat(of("assign"), of("access"), of("hex")).alias("base"), long.alias("long"))
    total = lambda found_pairs: F.aggregate(found_pairs, F.lit(0.0), lambda acc, i: acc + F.element_at(ratio, i + 1))
    # a one-element array, so that the pairs are made once
    lesser = lambda m: F.element_at(F.transform(F.array(pairs(m)), lambda p: F.least(total(p), total(F.array_distinct(p)))), 1)
    fresh = F.filter(apart(F.col("long"), F.col("base")), lambda x: lesser(x["m"]) > least_ratio)
    spans = spans.withColumn("extra", F.transform(fresh, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.size("extra").cast("long").alias("n_markov"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
