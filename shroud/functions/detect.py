"""Detectors of personal data that need no judgement.

Each detector is a row of ``DETECTORS``. Where one kind is enough, ``extract`` runs on the JVM. Where several detectors
compete for a place in the text, ``find`` decides: detectors in order, each from left to right; what overlaps something
already found is dropped. It runs in Python workers, only on texts with a digit or an at sign, which every match has.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import digits, strip

MANDATORY = ("RRN", "PHONE", "EMAIL", "CARD", "SSN", "DRIVER", "PASSPORT", "ACCOUNT")

# The detectors' patterns, first those with a context word. LEFT and RIGHT: no word character or hyphen there.
LEFT, RIGHT = r"(?<![\w-])", r"(?![\w-])"
PATTERNS = (
    ("PASSPORT", r"(?i)(?:여권|passport)[^\n]{0,12}?([A-Z]\d{8}|[A-Z]\d{3}[A-Z]\d{4})" + RIGHT),
    ("ACCOUNT", r"(?i)(?:계좌|통장|예금|account|acct)[^\n\d]{0,12}?(\d{2,6}-\d{2,6}-\d{2,8}(?:-\d{1,3})?)" + RIGHT),
    ("EMAIL", r"(?<![\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})" + RIGHT),
    ("RRN", LEFT + r"(\d{6}\s?-\s?[1-8]\d{6})" + RIGHT),
    ("RRN", LEFT + r"(\d{6}[1-8]\d{6})" + RIGHT),
    ("DRIVER", LEFT + r"((?:1[1-9]|2[0-8])-\d{2}-\d{6}-\d{2})" + RIGHT),
    ("CARD", LEFT + r"(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7})" + RIGHT),
    ("SSN", LEFT + r"((?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4})" + RIGHT),
    ("PHONE", r"(?<![\w+-])((?:\+82[-.\s]?0?1[016789]|01[016789])[-.\s]?\d{3,4}[-.\s]?\d{4})" + RIGHT),
    ("PHONE", LEFT + r"(0(?:2|[3-6][1-5]|70)[-.)\s]\s?\d{3,4}[-.\s]\d{4})" + RIGHT),
    ("PHONE", r"(?<![\w+-])((?:\+1[-.\s]?)?(?:\([2-9]\d{2}\)\s?|[2-9]\d{2}[-.\s])\d{3}[-.\s]\d{4})" + RIGHT),
)
GATE = r"[\p{Nd}@]"


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    value: str
    norm: str


def only_digits(value: str) -> str:
    return "".join(c for c in value if c.isdecimal())


def luhn(number: str) -> bool:
    """The check sum of card numbers: every second digit from the right doubled, digits of the products summed."""
    doubled = (sum(divmod(2 * int(c), 10)) for c in number[-2::-2])
    return (sum(map(int, number[-1::-2])) + sum(doubled)) % 10 == 0


def _passes(kind: str, value: str) -> bool:
    number = only_digits(value)
    if kind == "RRN":
        return 1 <= int(number[2:4]) <= 12 and 1 <= int(number[4:6]) <= 31
    if kind == "CARD":
        return 13 <= len(number) <= 19 and number != number[0] * len(number) and luhn(number)
    return True


def normal(kind: str, value: str) -> str:
    """The form in which equal data of a kind compare equal."""
    if kind == "EMAIL":
        return value.lower()
    if kind == "PASSPORT":
        return value.upper()
    number = only_digits(value)
    if kind == "PHONE" and value.startswith("+82"):
        return "0" + number[2:]
    if kind == "PHONE" and value.startswith("+1") and len(number) == 11:
        return number[1:]
    return number


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: re.Pattern


DETECTORS = tuple(Detector(kind, re.compile(p)) for kind, p in PATTERNS)


def find(text: str) -> list[Found]:
    """All personal data in a text, without overlaps, in text order."""
    out: list[Found] = []  # in text order all the time, so only the neighbours of a place can overlap it
    for d in DETECTORS:
        for m in d.pattern.finditer(text):
            start, end = m.span(1)
            at = bisect_right(out, start, key=lambda f: f.start)
            free = (at == 0 or out[at - 1].end <= start) and (at == len(out) or end <= out[at].start)
            if free and _passes(d.kind, m[1]):
                out.insert(at, Found(d.kind, start, end, m[1], normal(d.kind, m[1])))
    return out


def kind_of(value: str) -> str | None:
    """The kind of a value that is one match from end to end."""
    value = value.strip()
    found = find(value)
    return found[0].kind if len(found) == 1 and (found[0].start, found[0].end) == (0, len(value)) else None


def norm_of(kind: str | None, value: str) -> str:
    """The key of a value of a column: the norm of its only match if the kind is mandatory, else the trimmed value."""
    found = find(value) if kind in MANDATORY else []
    return found[0].norm if len(found) == 1 else value.strip()


def may_have_kind(v: Column) -> Column:
    """True for every value that ``kind_of`` gives a kind: an address has an at sign, and what else is a match from end to end
    has nine digits at least and no letter (a match after a context word begins behind it)."""
    return v.contains("@") | (~v.rlike(r"\p{L}") & (F.length(F.regexp_replace(v, r"\P{Nd}+", "")) >= 9))


def kinds_of(values: pd.Series) -> pd.Series:
    return values.map(kind_of, na_action="ignore")


MATCHES = "array<struct<kind:string,start:int,end:int,value:string,norm:string>>"


def matches_udf():
    @F.pandas_udf(MATCHES)
    def pii_matches(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [f._asdict() for f in find(t)] if isinstance(t, str) else None)

    return pii_matches


def rows_udtf():
    """Table function: the matches of a text as rows."""

    @F.udtf(returnType="kind string, start int, `end` int, value string, norm string")
    class PiiRows:
        def eval(self, text: str) -> Iterator[tuple]:
            yield from find(text or "")

    return PiiRows


def with_matches(df: DataFrame, column: str, into: str = "matches") -> DataFrame:
    """``df`` with an array of matches. Only texts that pass the gate go to Python; the two parts are united, as a condition
    around a Python function would not keep texts from it."""
    gate = F.coalesce(F.col(column).rlike(GATE), F.lit(False))
    yes = df.where(gate).withColumn(into, matches_udf()(F.col(column)))
    no = df.where(~gate).withColumn(into, F.array().cast(MATCHES))
    return yes.unionByName(no)


def find_pii(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row for each match in texts that pass the gate: the kept columns, kind, start, end, value, norm."""
    hits = df.where(F.col(column).rlike(GATE)).select(*keep, F.explode(matches_udf()(F.col(column))).alias("m"))
    return hits.select(*keep, "m.*")


# ---- one kind at a time, on the JVM ----


def extract(c: Column, *which: int) -> Column:
    """Matches of the patterns with these places in ``PATTERNS``, checked, without regard to other detectors."""
    return F.flatten(F.array(*[_checked(PATTERNS[i][0], F.regexp_extract_all(c, F.lit(_java(PATTERNS[i][1])), F.lit(1))) for i in which]))


def places(kind: str) -> list[int]:
    return [i for i, (k, _) in enumerate(PATTERNS) if k == kind]


def _java(pattern: str) -> str:
    return "(?iuU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def _checked(kind: str, values: Column) -> Column:
    if kind == "RRN":
        return F.filter(values, lambda v: F.substring(digits(v), 3, 2).cast("int").between(1, 12) & F.substring(digits(v), 5, 2).cast("int").between(1, 31))
    if kind == "CARD":
        return F.filter(values, lambda v: F.length(digits(v)).between(13, 19) & ~digits(v).rlike(r"^(\d)\1+$") & F.call_function("luhn_check", digits(v)))
    return values


def norm_column(kind: str, v: Column) -> Column:
    if kind == "EMAIL":
        return F.lower(v)
    if kind == "PASSPORT":
        return F.upper(v)
    d = digits(v)
    if kind == "PHONE":
        return F.when(strip(v).startswith("+82"), F.concat(F.lit("0"), F.substring(d, 3, 64))).when(strip(v).startswith("+1") & (F.length(d) == 11), F.substring(d, 2, 64)).otherwise(d)
    return d


