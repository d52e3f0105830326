"""Coarser forms of values that identify a person only in combination."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

REDACTED = "[REDACTED]"
SUPPORTED = ("birthdate", "date", "address", "zip", "age")


class GeneralizeError(ValueError):
    """The kind has no coarser form."""


def _or_redacted(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(REDACTED))


def year(c: Column) -> Column:
    return _or_redacted(F.regexp_extract(strip(c), r"(?U)^(\d{4})", 1))


def month(c: Column) -> Column:
    """Year and month as they stand, not checked against the calendar."""
    form, v = r"(?U)^(\d{4})[-./]?(\d{1,2})", strip(c)
    m = F.regexp_extract(v, form, 2)
    return F.when(m == "", F.lit(REDACTED)).otherwise(F.concat(F.regexp_extract(v, form, 1), F.lit("-"), F.format_string("%02d", m.cast("int"))))


def district(c: Column) -> Column:
    """Korean addresses up to the city, county or ward; others without the first part and without numbers."""
    v = strip(c)
    words = F.split(v, r"(?U)\s+")
    one, two, three = (F.get(words, F.lit(i)) for i in range(3))
    second = F.coalesce(two.rlike("[시군구]$"), F.lit(False))
    third = second & two.endswith("시") & F.coalesce(three.rlike("[시군구]$"), F.lit(False))
    korean = F.concat_ws(" ", one, F.when(second, two), F.when(third, three))
    parts = F.transform(F.slice(F.split(v, ",", -1), 2, 1_000_000), lambda p: strip(F.regexp_replace(strip(p), r"(?U)\s*\d[\d-]*\s*", " ")))
    other = F.array_join(F.filter(parts, lambda p: p != ""), ", ")
    return F.when(v.rlike("[가-힣]"), korean).otherwise(_or_redacted(other))


def zip3(c: Column) -> Column:
    v = strip(c)
    return F.when(F.length(v) > 3, F.concat(F.substring(v, 1, 3), F.lit("**"))).otherwise(F.lit(REDACTED))


def age_band(c: Column) -> Column:
    """Bands of five years of any decimal number; what is negative, not finite or no number is redacted."""
    v = strip(c)
    n = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double"))
    whole = F.floor(F.greatest(n, F.lit(0.0)))
    low = whole - whole % 5
    return F.when((n > -1) & (n < 9e18), F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))).otherwise(F.lit(REDACTED))


_BY_KIND: dict[str, Callable[[Column], Column]] = {"birthdate": year, "date": month, "address": district, "zip": zip3, "age": age_band}


def generalize(kind: str | None, c: Column) -> Column:
    """The coarser form of a column of this kind; null stays null."""
    if kind not in _BY_KIND:
        raise GeneralizeError(f"cannot generalize a '{kind}' column; supported: {', '.join(SUPPORTED)}")
    return F.when(c.isNotNull(), _BY_KIND[kind](c))


def _value(kind: str, value: str) -> str:
    """One value on the driver or in a Python worker; the rules above in Python."""
    v = value.strip()
    if kind == "birthdate":
        return v[:4] if re.match(r"\d{4}", v) else REDACTED
    if kind == "date":
        m = re.match(r"(\d{4})[-./]?(\d{1,2})", v)
        return f"{m[1]}-{int(m[2]):02d}" if m else REDACTED
    if kind == "zip":
        return f"{v[:3]}**" if len(v) > 3 else REDACTED
    if kind == "age":
        n = float(v) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) else math.nan
        if not -1 < n < 9e18:
            return REDACTED
        low = int(n) // 5 * 5
        return f"{low}-{low + 4}"
    if re.search("[가-힣]", v):
        words = v.split()
        more = next((i for i, w in enumerate(words[1:3], 1) if w[-1] not in "시군구"), min(len(words), 3))
        return " ".join(words[: min(more, 2 if len(words) > 1 and words[1][-1] != "시" else more)])
    rest = (re.sub(r"\s*\d[\d-]*\s*", " ", p.strip()).strip() for p in v.split(",")[1:])
    return ", ".join(p for p in rest if p) or REDACTED


def generalize_value(kind: str | None, value: str) -> str:
    if kind not in _BY_KIND:
        raise GeneralizeError(f"cannot generalize a '{kind}' column; supported: {', '.join(SUPPORTED)}")
    return _value(kind, value)


def python_of(kind: str) -> Callable[[pd.Series], pd.Series]:
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _value(kind, v), na_action="ignore")

    apply.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return apply
