"""Scalar text functions as Column expressions. Patterns use Unicode classes, as Python's do."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Surname syllables, and last syllables of words that are not names.
SURNAMES = (
    "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민류나진지엄채원천방공"
    "현함변염여추도소석선설마길연위표명기반라왕금옥육인맹제모탁국어은편용예경봉사부"
)
NOT_NAME_ENDINGS = "명일값자비과처량액율률별형료금간류번호도계표부실팀장소"

SHAPE_LENGTH = 24


#: All signs that ``(?U)\\s`` fits.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (strip(c) != "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D+", "")


def shape(c: Column) -> Column:
    """The first 24 characters with digits, Latin letters, Hangul and white space each shown as one sign."""
    s = F.translate(F.substring(c, 1, SHAPE_LENGTH), string.digits + string.ascii_uppercase + string.ascii_lowercase, "#" * 10 + "A" * 26 + "a" * 26)
    other = s
    for pattern, sign in ((r"\p{Nd}", "#"), ("[가-힣]", "가"), (r"(?U)\s", " ")):
        other = F.regexp_replace(other, pattern, sign)
    s = F.when(s.rlike(r"[^\x20-\x7e]"), other).otherwise(s)
    return F.concat(s, F.when(F.length(c) > SHAPE_LENGTH, F.lit("…")).otherwise(F.lit("")))


_SIGNS = [(re.compile(p), s) for p, s in ((r"\d", "#"), ("[A-Z]", "A"), ("[a-z]", "a"), ("[가-힣]", "가"), (r"\s", " "))]


def shape_of(value: str) -> str:
    """The same for a value on the driver."""
    s = value[:SHAPE_LENGTH]
    for pattern, sign in _SIGNS:
        s = pattern.sub(sign, s)
    return s + "…" * (len(value) > SHAPE_LENGTH)


def shapes_of(values: pd.Series) -> pd.Series:
    return values.map(shape_of, na_action="ignore")


def name_like(c: Column) -> Column:
    """Two to four Hangul syllables that begin with a surname and do not end like a category."""
    v = strip(c)
    return v.rlike(f"^[{SURNAMES}][가-힣]{{0,2}}[가-힣&&[^{NOT_NAME_ENDINGS}]]$")


def name_like_value(value: str) -> bool:
    v = value.strip()
    return bool(re.fullmatch("[가-힣]{2,4}", v)) and v[0] in SURNAMES and v[-1] not in NOT_NAME_ENDINGS


def maskable(c: Column, kind: Column) -> Column:
    """Whether a value is distinctive enough to be replaced wherever it stands."""
    v = strip(c)
    hangul_name = (kind == "name") & v.rlike("^[가-힣]+$")
    return F.when(F.coalesce(hangul_name, F.lit(False)), F.length(v) >= 2).when(v.rlike(r"^\p{Nd}+$"), F.length(v) >= 5).otherwise(F.length(v) >= 3)


def maskable_value(value: str, kind: str | None) -> bool:
    v = value.strip()
    least = 2 if kind == "name" and re.fullmatch("[가-힣]+", v) else 5 if v.isdigit() else 3
    return len(v) >= least


def is_date(c: Column) -> Column:
    """Year, month and day with separators and perhaps a time, or eight digits; month up to 12, day up to 31."""
    apart, compact = r"(?U)^(\d{4})[-./](\d{1,2})[-./](\d{1,2})([ T].*)?$", r"(?U)^(\d{4})(\d{2})(\d{2})$"
    pattern = F.when(c.rlike(apart), F.lit(1)).when(c.rlike(compact), F.lit(2))

    def part(group: int) -> Column:
        return F.when(pattern == 1, F.regexp_extract(c, apart, group)).when(pattern == 2, F.regexp_extract(c, compact, group)).cast("int")

    long_enough = (F.length(c) >= 8) & c.rlike(r"^\p{Nd}{4}")  # most values end here
    return F.when(long_enough, F.coalesce(part(2).between(1, 12) & part(3).between(1, 31), F.lit(False))).otherwise(F.lit(False))


def entity_name(column: str, fallback: str = "ID") -> str:
    """A column name as the word before a pseudonym's number."""
    name = "_".join(re.findall("[A-Z0-9]+", column.upper()))
    return f"C_{name}" if name[:1].isdigit() else name or fallback


def normal_column(name: str) -> str:
    return re.sub(r"[\s\-]+", "_", name.strip().lower())
