"""Column functions of the racing domain: codes, bands, positions, odds, packed strings."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends of the distance bands of each consumer, in metres, and names.
BANDS = {
    "cells": ((1400, "sprint"), (1800, "mile"), (2200, "middle"), (2800, "long"), (None, "extended")),
    "similar": ((1300, "short"), (1700, "mile"), (2200, "middle"), (None, "long")),
    "field": ((3, "small"), (6, "middle"), (None, "large")),
    "pedigree": ((1399, "short"), (1799, "mile"), (2199, "middle"), (None, "long")),
}
# Odds strings: stride, widths of the fields.
PACKED = {"quinella": (13, (2, 2, 5, 4)), "wide": (17, (2, 2, 5, 5, 3)), "trio": (15, (2, 2, 2, 5, 4))}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def code_number(col: str | Column, missing: Sequence[str] = ("", "00", "000", "0000"), scale: float = 1.0) -> Column:
    """A text code as a number: digits only, sentinels null, divided by scale."""
    text = F.trim(_c(col))
    number = F.when(text.rlike("^[0-9]+$") & ~text.isin(list(missing)), text.try_cast("double"))
    return number / scale


def rounded(col: str | Column, digits: int) -> Column:
    """col times 10^digits to the nearest whole number (halves away from zero), over 10^digits: DuckDB's round. F.round goes by the shortest decimal that stands for col, which differs next to a half."""
    x, scale = _c(col), F.lit(float(10**digits))
    y = F.round(x * scale) / scale
    return F.when(F.abs(y) < float("inf"), y).otherwise(x)


def norm_position(pos: str | Column, n: str | Column) -> Column:
    """(pos - 1) / (n - 1), null for a field of one."""
    return F.when(_c(n) > 1, (_c(pos) - 1) / F.nullif(_c(n) - 1, F.lit(0)))


def clean_text(*cols: str | Column) -> Column:
    """The first of the texts that is not blank, full-width blanks and leading zeros removed."""
    clean = lambda c: F.nullif(F.regexp_replace(F.trim(F.regexp_replace(_c(c), "　", " ")), "^0+", ""), F.lit(""))
    return F.coalesce(*(clean(c) for c in cols))


def fold_name(col: str | Column) -> Column:
    """Names for matching (P5): compatibility composition, case folded, punctuation and legal suffixes dropped. NFKC has no JVM function, so an Arrow UDF does that part."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC").str.casefold()

    return F.trim(F.regexp_replace(F.regexp_replace(nfkc(_c(col)), r"[\p{P}\p{S}]+", " "), r"\s*\b(co|ltd|inc|llc|kk)\b\s*", " "))


def band(col: str | Column, scheme: str = "cells") -> Column:
    """Name of the distance band (P7); the upper ends belong to the band."""
    steps = BANDS[scheme]
    out = F.when(_c(col) <= steps[0][0], steps[0][1])
    for top, name in steps[1:-1]:
        out = out.when(_c(col) <= top, name)
    return out.when(_c(col).isNotNull(), steps[-1][1])


def season(date: str | Column) -> Column:
    """0 spring (from March) to 3 winter."""
    return F.floor((F.month(_c(date)) + 9) % 12 / 3).cast("int")


def code_set(col: str | Column, sets: dict[str, Sequence]) -> Column:
    """Name of the set that holds the code (P8); null for none."""
    names = list(sets)
    out = F.when(_c(col).isin(list(sets[names[0]])), names[0])
    for n in names[1:]:
        out = out.when(_c(col).isin(list(sets[n])), n)
    return out


def code_level(col: str | Column, levels: dict[str, int]) -> Column:
    """Ordinal of a code."""
    pairs = [F.lit(x) for kv in levels.items() for x in kv]
    return F.create_map(*pairs)[_c(col)]


def condition_key(label: str | Column, text: str | Column) -> Column:
    """The label, else the first word of the text (P10)."""
    return F.coalesce(F.nullif(F.trim(_c(label)), F.lit("")), F.nullif(F.split_part(F.trim(_c(text)), F.lit(" "), F.lit(1)), F.lit("")))


def weight_class(col: str | Column, limits: dict[str, float], rest: str) -> Column:
    """Name of the first class whose limit is above the weight."""
    out = None
    for name, top in limits.items():
        out = F.when(_c(col) < top, name) if out is None else out.when(_c(col) < top, name)
    return out.when(_c(col).isNotNull(), rest)


def hex_number(col: str | Column, missing: str = "FFF") -> Column:
    """A hexadecimal text as an int; the sentinel and anything else null."""
    text = F.upper(F.trim(_c(col)))
    return F.when(text.rlike("^[0-9A-F]+$") & (text != missing), F.conv(text, 16, 10).cast("int"))


def frame(number: str | Column, n: str | Column) -> Column:
    """Frame of a horse number in a field of n, eight frames, larger ones last (P13); null outside 1..n or beyond 18."""
    no, size = _c(number), _c(n)
    base = F.floor(size / 8)
    turn = (8 - (size - 8 * base)) * base
    low = F.floor((no - 1) / F.greatest(base, F.lit(1))) + 1
    high = 8 - (size - 8 * base) + F.floor((no - turn - 1) / (base + 1)) + 1
    return F.when((no < 1) | (no > size) | (size > 18), None).when(size <= 8, no).when(no <= turn, low).otherwise(high).cast("int")


def running_style(corner: str | Column, n: str | Column, front: float = 0.3, back: float = 0.7) -> Column:
    """Style from the first known corner (P14): nige if exactly first, then senkou, sashi, oikomi by normalised place."""
    at = norm_position(corner, n)
    return F.when(_c(corner) == 1, "nige").when(at <= front, "senkou").when(at <= back, "sashi").when(at.isNotNull(), "oikomi")


def race_key(*parts: str | Column) -> Column:
    return F.concat_ws(":", *parts)


def parse_race_key(col: str | Column, names: Sequence[str]) -> list[Column]:
    return [F.split_part(_c(col), F.lit(":"), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def odds_score(odds: str | Column, top: float = 300.0) -> Column:
    """ln(odds) over ln(top), within 0 and 1."""
    import math

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(F.greatest(_c(odds), F.lit(1.0))) / math.log(top)))


def interp(col: str | Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear between knots, flat beyond them."""
    x = _c(col)
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for i in range(1, len(xs)):
        out = out.when(x <= xs[i], ys[i - 1] + (x - xs[i - 1]) * ((ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])))
    return out.when(x.isNotNull(), F.lit(float(ys[-1])))


def entropy(*ps: str | Column) -> Column:
    """-sum p ln(p + 1e-9)."""
    return -sum((_c(p) * F.log(_c(p) + 1e-9) for p in ps[1:]), _c(ps[0]) * F.log(_c(ps[0]) + 1e-9))


def softmax_of(scores: Sequence[Column]) -> Column:
    """An array of the scores' softmax."""
    powers = [F.exp(x) for x in scores]
    return F.array(*(p / sum(powers[1:], powers[0]) for p in powers))


def distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def set_hash(names: str | Column) -> Column:
    """Order-free hash of a set of names: 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(F.array_join(F.array_sort(_c(names)), ","), 256), 1, 16)


def unpack(col: str | Column, stride: int, widths: Sequence[int]) -> Column:
    """A packed string as an array of arrays of field texts, whole slots only."""
    text = _c(col)
    slots = F.floor(F.length(text) / stride).cast("int")
    begins, at = [], 1
    for w in widths:
        begins.append((at, w))
        at += w
    return F.when(slots > 0, F.transform(F.sequence(F.lit(0), F.greatest(slots - 1, F.lit(0))), lambda i: F.array(*(F.substr(text, i * stride + b, F.lit(w)) for b, w in begins)))).otherwise(F.array().cast("array<array<string>>"))
