"""Personal data (operator 13).

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges and digit counts
for the rest), and words nearby raise or lower a span's score. Base kinds (email, ip, card, phone) stay whatever their
score, one leftmost match after the other. The method adds spans of further kinds that reach `least`: `iban`,
`card_part` (a card number that stands in a longer chain of digits, or has dots between its groups), `phone_local`
(no country code) and `national_id` (three, two and four digits). An added span overlaps no base span and no added span of a
higher score.

Patterns take time in proportion to the text: none can start again inside a run that it has just failed on.

Each row is judged alone. Null texts are empty and have no spans; repeated rows and rows with a null doc_id are
judged each; empty tables give empty results; other columns of docs are not read. Positions are code points.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small_batches

BASE = ("email", "ip", "card", "phone")
FOUND = "array<struct<kind:string,start:int,end:int,score:double>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
Spans = Iterator[tuple[int, int]]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
DOTTED = re.compile(r"(?<![0-9.])[3-6][0-9]{3}(?:\.[0-9]{4}){2}\.[0-9]{1,7}(?![0-9]|\.[0-9])")
LOCAL_PHONE = re.compile(r"(?<![\w+.@/-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,4}(?![\w@/-])")
NATIONAL = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """An IBAN's check: the first four characters last, letters as 10 to 35, rest 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Spans:
    """Leftmost matches of a local part, @ and a domain with a dot. An @ ends the only run that can stand before it, so that
    each run is walked once."""
    before = 0
    for m in DOMAIN.finditer(text):
        s = at = m.start()
        while s > before and text[s - 1] in LOCAL:
            s -= 1
        if s < at:
            yield s, (before := m.end())


def addresses(text: str) -> Spans:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Spans:
    for m in CHAIN.finditer(text):
        if 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Spans:
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Spans:
    """The longest part of a match, by whole groups, that passes mod-97."""
    for m in IBAN.finditer(text):
        groups = m[0].split(" ")
        for n in range(len(groups), 0, -1):
            if len(code := "".join(groups[:n])) >= 15 and mod97(code):
                yield m.start(), m.start() + len(" ".join(groups[:n]))
                break


def card_parts(text: str) -> Spans:
    """Whole groups of 13 to 19 digits, within chains that are no card as a whole, and groups with dots."""
    for m in CHAIN.finditer(text):
        if 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            continue
        chain, k = m[0], 0
        groups = [g.span() for g in re.finditer(r"[0-9]+", chain)]
        while k < len(groups):
            n, last, hit = 0, k, None
            while last < len(groups) and (n := n + groups[last][1] - groups[last][0]) <= 19:
                part = chain[groups[k][0] : groups[last][1]]
                if n >= 13 and part[0] in "3456" and luhn(NOT_DIGIT.sub("", part)):
                    hit = last
                last += 1
            if hit is not None:
                yield m.start() + groups[k][0], m.start() + groups[hit][1]
                k = hit
            k += 1
    for m in DOTTED.finditer(text):
        if 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def local_phones(text: str) -> Spans:
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(NOT_DIGIT.sub("", m[0])) <= 12:
            yield m.span()


def national_ids(text: str) -> Spans:
    for m in NATIONAL.finditer(text):
        yield m.span()


@dataclass(frozen=True)
class Rule:
    """kind; propose: confirmed spans of a text; needs: a character that every match has; score without context, and the
    words that raise it by `rise` or lower it by `fall`: the nearest within `before` characters decides, and
    where there is none a word that raises it within `after` characters."""

    kind: str
    propose: Callable[[str], Spans]
    score: float
    near: str
    against: str = r"order|invoice|version|isbn|serial|part no|article|tracking|artikel|rechnung|factura|commande|pedido"
    needs: str = ""
    rise: float = 0.35
    fall: float = 0.35
    before: int = 48
    after: int = 24


#: Words of context in English, German, French and Spanish: fixed values of the rules.
RULES = (
    Rule("email", emails, 0.8, r"e-?mail|mail|contact|write|kontakt|correo|courriel", needs="@"),
    Rule("ip", addresses, 0.5, r"ip|address|host|server|login|client|adresse|dirección", needs="."),
    Rule("card", cards, 0.6, r"card|visa|mastercard|amex|credit|debit|payment|karte|kreditkarte|carte|tarjeta"),
    Rule("phone", phones, 0.7, r"phone|tel|telephone|call|mobile|cell|fax|telefon|handy|téléphone|teléfono|móvil", needs="+"),
    Rule("iban", ibans, 0.9, r"iban|account|bank|transfer|konto|compte|cuenta"),
    Rule("card_part", card_parts, 0.3, r"card|visa|mastercard|amex|credit|debit|payment|karte|kreditkarte|carte|tarjeta"),
    Rule("phone_local", local_phones, 0.25, r"phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|téléphone|teléfono|móvil"),
    Rule("national_id", national_ids, 0.5, r"ssn|social security|national id|tax id|taxpayer", needs="-"),
)


def _words(alternatives: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{alternatives})(?!\w)", re.IGNORECASE)


def context(before: str, after: str, near: re.Pattern, against: re.Pattern, rule: Rule) -> float:
    last = lambda pattern: max((m.end() for m in pattern.finditer(before)), default=-1)
    for_, contrary = last(near), last(against)
    if for_ == contrary:  # neither stands before
        return rule.rise if near.search(after) else 0.0
    return rule.rise if for_ > contrary else -rule.fall


def spans_of(text: str, rules: tuple[Rule, ...], words: list[tuple[re.Pattern, re.Pattern]], least: float) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as the rules are listed, then start."""
    kept: list[list[tuple[str, int, int, float]]] = [[] for _ in rules]
    added = []
    for k, (rule, (near, against)) in enumerate(zip(rules, words, strict=True)):
        if rule.needs and rule.needs not in text:
            continue
        for s, e in rule.propose(text):
            score = rule.score + context(text[max(0, s - rule.before) : s], text[e : e + rule.after], near, against, rule)
            score = round(min(1.0, max(0.0, score)), 6)
            if rule.kind in BASE:
                kept[k].append((rule.kind, s, e, score))
            elif score >= least:
                added.append((-score, s, e, k))
    # both sides are sorted by place; base spans of different kinds may overlap each other, added ones nothing
    for k, s, e, score in _apart(sorted((s, e) for own in kept for _, s, e, _ in own), added):
        kept[k].append((rules[k].kind, s, e, score))
    return [x for own in kept for x in sorted(own, key=lambda x: x[1])]


def _apart(base: list[tuple[int, int]], added: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(rule, start, end, score) of the added spans that overlap none of base and none of a higher score; the one that starts first on ties."""
    free, at, reach = [], 0, 0
    for x in sorted(added, key=lambda x: x[2]):  # by end: base spans that start before it reach as far as `reach`
        while at < len(base) and base[at][0] < x[2]:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= x[1]:
            free.append(x)
    out, run, end = [], [], -1
    for x in [*sorted(free, key=lambda x: x[1:3]), None]:
        if run and (x is None or x[1] >= end):  # a run of spans that touch each other; most hold one
            chosen: list[tuple[int, int]] = []  # sorted by place, apart from each other
            for score, s, e, k in sorted(run):
                i = bisect(chosen, (s, e))
                if (i == 0 or chosen[i - 1][1] <= s) and (i == len(chosen) or e <= chosen[i][0]):
                    chosen.insert(i, (s, e))
                    out.append((k, s, e, -score))
            run, end = [], -1
        if x is not None:
            run.append(x)
            end = max(end, x[2])
    return out


def _mapped(column: str, cell: Callable[[str], object], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array((cell(t.as_py() or "") for t in batch.column("text")), kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", column])

    return run


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """doc_id and found, an array of (kind, start, end, score), for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    words = [(_words(r.near), _words(r.against)) for r in rules]
    of = lambda t: [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans_of(t, rules, words, least)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mapped("found", of, pa.list_(SPAN)), f"doc_id long, found {FOUND}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """doc_id and text, in which each span, or run of spans that overlap, stands as its first kind in brackets, as in [email]."""
    small_batches(docs.sparkSession)
    words = [(_words(r.near), _words(r.against)) for r in rules]

    def masked(text: str) -> str:
        out, at = [], 0
        for kind, s, e, _ in sorted(spans_of(text, rules, words, least), key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [text[at:s], f"[{kind}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mapped("text", masked, pa.string()), "doc_id long, text string")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    extra = F.size(F.filter("found", lambda x: ~x["kind"].isin(*BASE))).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), extra)
