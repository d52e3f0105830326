"""Document fingerprints by prefix polynomial hashes.

For code points c and a base B, the prefix array S[i] = sum of c[k] * B^k for k < i, modulo a prime, is built once for a
text. The hash of any span follows from two of its entries, so any two spans compare in constant time, and the longest
common extension of two places is found by binary search. A fingerprint is taken from the prefix array: the length,
the hash of the whole text under two primes, and hashes of prefixes and of suffixes at multiples of a step, the smallest
power of two that gives at most 32 of each. It also holds the length and hash of every span of the text, cut where the hash of the
next 8 code points is less than at all 32 places before and after it; so the cuts follow from what stands around them, and texts
that differ in some places have the same spans in between, however these are shifted. The likeness of two fingerprints binary-searches
the longest common extensions from both ends over the samples, adds the equal spans between them (each as often as both texts have
it, in any order), and returns the shared part of the longer text; equal fingerprints give 1. A difference costs the spans it
touches, about 65 code points each; a stretch that repeats itself within 32 places has no cuts and is one span.

The next document (descending id; after the last, the first) is found without a global sort in one task: ids are dealt into
ranges by quantiles (an id that many rows have, by the hash of the text as well), and the one row that follows each range is sent there too.

Defined results: null text is empty; two empty texts are alike (1), an empty and a full one are not (0); equal ids are
ordered by the hash of their text, descending; a single document is its own next; a null id counts as the smallest id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, quoted

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SAMPLES = 32
GRAM, REACH = 8, 32  # code points whose hash decides on a cut, and places on each side that it is compared with
NO_ID = -(2**63)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """B^0 to B^n for both primes; the table doubles as longer texts come."""
    global _powers
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        tables = []
        for p, b in zip(PRIMES, BASES):
            t = np.ones(size + 1, "uint64")
            have, step = 1, b
            while have <= size:  # B^(have + k) = B^k * B^have
                take = min(have, size + 1 - have)
                t[have : have + take] = t[:take] * np.uint64(step) % np.uint64(p)
                have, step = have * 2, step * step % p
            tables.append(t)
        _powers = tables
    return _powers


class Prefix:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64") + np.uint64(1)
        self.sums = []
        for p, power in zip(PRIMES, powers(self.n)):
            s = np.zeros(self.n + 1, "uint64")
            # Terms are below 2^31, so the sum of up to 2^33 of them fits.
            np.cumsum(codes * power[: self.n] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))

    def span(self, i: int, j: int, shift: int) -> tuple[int, int]:
        """Hash of text[i:j] as if it began at ``shift``, which is i at least."""
        return tuple(int((int(s[j]) - int(s[i])) % p * int(w[shift - i]) % p) for s, p, w in zip(self.sums, PRIMES, powers(shift - i)))


def span_equal(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    shift = max(i, j)
    return a.span(i, i + length, shift) == b.span(j, j + length, shift)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """The longest l for which text a from i and text b from j agree, by binary search."""
    lo, hi = 0, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if span_equal(a, i, b, j, mid) else (lo, mid - 1)
    return lo


def _step(n: int) -> int:
    return 1 << max(0, (max(n, 1) - 1) // SAMPLES).bit_length() if n > SAMPLES else 1


def _spans(sums: np.ndarray) -> str:
    """Text form of all spans of a text, from its prefix array: length (hexadecimal) and hash of each."""
    p, n = np.uint64(PRIMES[0]), len(sums) - 1
    at = np.zeros(1, "int64")
    if n >= GRAM:
        grams = (sums[GRAM:] + p - sums[:-GRAM]) % p * _inverse_power(np.arange(n - GRAM + 1)) % p
        beyond = np.full(REACH, p)
        least, width = np.concatenate([beyond, grams, beyond]), 1
        while width < REACH:
            step = min(width, REACH - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        cuts = np.flatnonzero((grams < least[: len(grams)]) & (grams < least[REACH + 1 : REACH + 1 + len(grams)]))
        at = np.concatenate([at, cuts[cuts > 0]])
    stop = np.append(at[1:], n)
    hashes = (sums[stop] + p - sums[at]) % p * _inverse_power(at) % p
    return ",".join(f"{size:x}{h:08x}" for size, h in zip((stop - at).tolist(), hashes.tolist()))


def _between(spans: str, lo: int, hi: int) -> Counter:
    """The spans that lie between two places, and how often each does."""
    out, at = Counter(), 0
    for span in spans.split(","):
        size = int(span[:-8], 16)
        if lo <= at and at + size <= hi:
            out[span] += 1
        at += size
    return out


def _sampled(whole: list[int], at: np.ndarray, prefix: np.ndarray, n: int, spans: str) -> str:
    """Text form: length, whole hashes, hashes of prefixes, hashes of suffixes, spans."""
    p, power = np.uint64(PRIMES[0]), powers(n)[0]
    # Hash of the last m code points as if they ended at a fixed place: suffixes of texts of any length compare.
    at_tail = n - at
    tails = (np.uint64(whole[0]) + p - prefix[1]) % p
    tails = tails * _inverse_power(at_tail) % p
    return f"{n}:{whole[0]:08x}{whole[1]:08x}:" + "".join(f"{x:08x}" for x in prefix[0].tolist()) + ":" + "".join(f"{x:08x}" for x in tails.tolist()) + f":{spans}"


_inverse: list[np.ndarray] = []


def _inverse_power(at: np.ndarray) -> np.ndarray:
    """B^-k modulo the first prime."""
    global _inverse
    top = int(at.max(initial=0))
    if not _inverse or len(_inverse[0]) <= top:
        size, p = 1 << max(12, top.bit_length()), PRIMES[0]
        t = np.ones(size + 1, "uint64")
        have, step = 1, pow(BASES[0], -1, p)
        while have <= size:
            take = min(have, size + 1 - have)
            t[have : have + take] = t[:take] * np.uint64(step) % np.uint64(p)
            have, step = have * 2, step * step % p
        _inverse = [t]
    return _inverse[0][at]


def fingerprint(a: Prefix, kept: int | None = None, b: Prefix | None = None, taken: int = 0) -> str:
    """Fingerprint of a text, or of its first ``kept`` code points followed by the first ``taken`` of another text.

    The prefix array of a concatenation follows from the two texts' arrays: S[kept + j] = Sa[kept] + B^kept * Sb[j].
    """
    kept = a.n if kept is None else kept
    n = kept + taken
    step = _step(n)
    lengths = np.arange(step, n + 1, step)

    def sums(k: int, at: np.ndarray) -> np.ndarray:
        p, out = np.uint64(PRIMES[k]), a.sums[k][np.minimum(at, kept)]
        if taken:
            out = (out + b.sums[k][np.clip(at - kept, 0, taken)] * powers(max(n, 1))[k][kept]) % p
        return out

    whole = [int(sums(k, np.array([n]))[0]) for k in (0, 1)]
    return _sampled(whole, lengths, np.stack([sums(0, lengths), sums(0, n - lengths)]), n, _spans(sums(0, np.arange(n + 1))))


def likeness(x: str, y: str) -> float:
    """Share of the longer text that lies in the common extensions from both ends, as far as the samples tell, and in equal spans between."""
    if x == y:
        return 1.0
    (n, _, hx, tx, px), (m, _, hy, ty, py) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    if not n or not m:
        return 0.0
    sx, sy = _step(n), _step(m)
    step = max(sx, sy)
    most = min(n, m) // step

    def common(u: str, v: str) -> int:
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            i, j = (mid * step // sx - 1) * 8, (mid * step // sy - 1) * 8
            lo, hi = (mid, hi) if u[i : i + 8] == v[j : j + 8] else (lo, mid - 1)
        return lo * step

    start, end = common(hx, hy), common(tx, ty)
    inside = _between(px, start, n - end) & _between(py, start, m - end)
    inside = sum(int(span[:-8], 16) * k for span, k in inside.items())
    return min(start + end + inside, max(n, m) - 1, min(n, m)) / max(n, m)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start_next long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _row(doc_id: int, a: Prefix, fa: str, b: Prefix, fb: str) -> tuple:
    half = a.n // 2
    kept, taken = a.n - half, min(half, b.n)
    edited = a.text[:kept] + b.text[:taken]
    fe = fingerprint(a, kept, b, taken)
    return (None if doc_id == NO_ID else doc_id, a.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fa, fe, likeness(fa, fe), likeness(fa, fb), common_extension(a, 0, b, 0))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by range and descending id; each row meets the row after it. A row sent only to be met is not a row."""
    held, out = None, []
    for batch in batches:
        for bucket, doc_id, guest, text in zip(*(batch[c].to_pylist() for c in ("bucket", "doc_id", "guest", "text"))):
            a = Prefix(text)
            f = fingerprint(a)
            if held and held[0] == bucket and not held[2]:
                out.append(_row(held[1], held[3], held[4], a, f))
                if len(out) >= 500:
                    yield pa.record_batch([pa.array(c) for c in zip(*out)], schema=_SCHEMA)
                    out = []
            held = (bucket, doc_id, guest, a, f)
    if out:
        yield pa.record_batch([pa.array(c) for c in zip(*out)], schema=_SCHEMA)


_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in _OUT.split(", ")])


def _count_above(marks: list[int], value: Column) -> Column:
    """How many of the marks (descending) are above a value; coarse marks first, then those between two of them."""

    def above(values: Column) -> Column:
        return F.size(F.filter(values, lambda m: m > value))

    if not marks:
        return F.lit(0)
    every, step = F.lit(marks).cast("array<long>"), 64
    if len(marks) <= 4 * step:
        return above(every)
    coarse = above(F.lit(marks[step - 1 :: step]).cast("array<long>")) * step
    return (coarse + above(F.slice(every, coarse + 1, F.lit(step)))).cast("int")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the contract for each document, and the length of its common start with the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    n = partitions(spark)
    times = Counter(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [])
    # Ranges in descending order of id: one number for each partition comes to the driver. An id that holds several has its hashes dealt as well.
    marks = sorted(times, reverse=True)
    rows = rows.withColumn("h", F.xxhash64("text"))
    deal = F.lit(0).cast("long")
    for mark, k in times.items():
        if k > 1:
            bits = k.bit_length()
            deal = F.when(F.col("doc_id") == mark, F.shiftright(F.bitwise_not("h"), 64 - bits) + (1 << bits - 1)).otherwise(deal)
    rows = rows.withColumn("bucket", _count_above(marks, F.col("doc_id")).cast("long") * (1 << 32) + deal)
    tops = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("t")).orderBy("bucket").collect()
    if not tops:
        return spark.createDataFrame([], _OUT)
    # The first row of each range is also a guest, after the last row, in the range before it (the first range's in the last).
    guests = [(t.bucket, t.t.doc_id, t.t.h, tops[i - 1].bucket) for i, t in enumerate(tops)]
    guests = F.broadcast(spark.createDataFrame(guests, "bucket long, doc_id long, h long, host long"))
    sent = rows.join(guests, ["bucket", "doc_id", "h"], "left")
    places = F.filter(F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))), lambda x: x.bucket.isNotNull())
    sent = sent.select("doc_id", "h", "text", F.explode(places).alias("p")).select("p.bucket", "p.guest", "doc_id", "h", "text")
    sent = sent.repartitionByRange(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col("doc_id").desc(), F.col("h").desc())
    return sent.select("bucket", "doc_id", "guest", "text").mapInArrow(_pairs, _OUT)
