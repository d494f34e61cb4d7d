"""Scalar functions: logits, likelihood ratios, thresholds, tail probabilities, decibels, identifiers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(p: Column, eps: float) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def logit(p: Column) -> Column:
    p = clipped(p, 1e-7)
    return F.ln(p / (1 - p))


def log_ratio(spoof: Column, live: Column) -> Column:
    return F.ln(clipped(spoof, 1e-9) / clipped(live, 1e-9))


def barriers(alpha: float, beta: float) -> tuple[float, float]:
    """Upper and lower barrier of the sequential probability ratio test."""
    return math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))


def z_threshold(alpha: float, checks: int) -> float:
    """Two-sided normal quantile for `checks` tests at a joint level alpha."""
    return NormalDist().inv_cdf(1 - alpha / (2 * checks))


def epsilon(z: float, n: Column) -> Column:
    return z / (2 * F.sqrt(n))


def two_sided_p_rough(z: Column) -> Column:
    """2 exp(-z^2 / 2), the bound that online scoring reports; it may exceed 1."""
    return 2 * F.exp(-z * z / 2)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: one less a series of positive terms below 2.5, a continued fraction beyond."""
    square = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("sum"), x.alias("term")),
        lambda a, k: F.struct((a["sum"] + a["term"] * 2 * square / (2 * k + 1)).alias("sum"), (a["term"] * 2 * square / (2 * k + 1)).alias("term")),
    )["sum"]
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.lit(1.0), lambda a, k: 1 + k / (2 * square * a))
    small = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * series
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < 2.5, small).otherwise(F.exp(-square) / (x * math.sqrt(math.pi) * fraction))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi2_tail(x: Column, df: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom, in closed form; one degree through erfc."""
    if df == 1:
        return two_sided_p(F.sqrt(x))
    if df % 2:
        raise ValueError("degrees of freedom must be even or 1")
    half = x / 2
    # the k-th term from the one before it
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(df // 2)), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")), lambda a, k: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * half / k).alias("term")))
    return F.exp(-half) * terms["sum"]


def ratio_from_db(db: Column | float, power: bool = False) -> Column:
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / (10 if power else 20))


def db_from_ratio(x: Column, power: bool = False) -> Column:
    return (10 if power else 20) * F.log10(x)


def check_id(variant: Column, mode: Column, w: Column, direction: Column) -> Column:
    return F.format_string("%s_%s_w%d_%s", variant, mode, w, direction)


def parsed_check_id(name: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(name, r"^([^_]+)_([^_]+)_w([0-9]+)_([^_]+)$", i)
    return {"variant": part(1), "mode": part(2), "w": part(3).cast("int"), "dir": part(4)}


def clip_id(label: Column, n: Column) -> Column:
    return F.format_string("%s_%04d", label, n)


def speaker_id(named: list[Column], described: list[Column]) -> Column:
    """The first name that is there; else eight hex digits of the first description's MD5; else `unknown`."""
    hashed = F.substring(F.md5(F.coalesce(*described).cast("string")), 1, 8)
    return F.coalesce(*(c.cast("string") for c in named), hashed, F.lit("unknown"))


def file_name(channel: Column) -> Column:
    return F.replace(channel, F.lit("."), F.lit("_"))


def listed(text: Column) -> Column:
    """A comma-separated list without blanks and empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


#: Fixed coefficients of Lanczos' approximation of the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x >= 1."""
    x = x.cast("double") - 1
    total = sum((F.lit(c) / (x + k) for k, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.ln(t) - t + F.ln(total)


def _beta_fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, from its end: 1 + d1 / (1 + d2 / (1 + ...))."""

    def d(n: Column) -> Column:
        m = F.floor(n / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(n % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(1.0), lambda acc, n: 1 + d(n) / acc)


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """The regularised incomplete beta function, for a, b >= 1 and 0 <= x <= 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = x < (a + 1) / (a + b + 2)  # where the fraction converges fast; else of the other tail
    value = F.when(low, front / a / _beta_fraction(a, b, x, terms)).otherwise(1 - front / b / _beta_fraction(b, a, 1 - x, terms))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def beta_quantile(p: float, a: Column, b: Column, steps: int = 60) -> Column:
    """x with incomplete_beta(a, b, x) = p, by halving."""

    def halved(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = incomplete_beta(a, b, mid) < p
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halved)
    return (end["lo"] + end["hi"]) / 2


def rate_bound(k: Column, n: Column, level: float = 0.95) -> Column:
    """The one-sided upper bound of Clopper and Pearson for a rate of which k of n were seen; 1 if all or none were looked at."""
    k, n = k.cast("double"), n.cast("double")
    return F.when((n <= 0) | (k >= n), 1.0).otherwise(beta_quantile(level, k + 1, F.greatest(n - k, F.lit(1.0))))
