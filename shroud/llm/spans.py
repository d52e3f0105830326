"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences at line feeds and after ``.``, ``!`` and ``?``; a sentence of more than 16 words is cut again after
the word of least hash in each window of nine words, so that its pieces follow from the words around them and not from where the
sentence began. Every run of consecutive sentences that has at least two sentences and 15 words, and no more than it needs for
that, seen from its first or from its last sentence, is hashed to 128 bits. Equal runs of the whole corpus meet in one sort,
which tells the smallest id; the runs of all documents with a larger one, and those that stand a second time
in their own text, are marked, and the sentences that they cover are removed. Text between the removed sentences stays as it was, byte for byte.

A passage of more than 50 words that stands in two texts with the same line feeds loses at most 17 words at either end to sentences
that go on beyond it (16 of a sentence left whole; in a longer one the cuts agree from the ninth word on, and the next follows within
nine). The 17 words or more between are at least two sentences or pieces, so they hold a run and are removed, wherever the passage begins.

Documents are dealt into parts by their identifier and text. Equal runs of one part travel as one row with the least and the largest id,
so a run that very many documents share is a row for each part (or a few, where the part's runs are many), not for each document. The marked
runs go back to their part, where they meet its documents, whose runs are hashed again; so no places are kept or moved.

Defined results: null text stays null, empty stays empty; a text whose sentences are all covered becomes empty; a repeated
row (same id and text) counts once, and each copy gets the same result; rows with equal ids (or none) and
different texts are different places, in the order of a hash of their texts; a null id comes first; a text may have any length, its sentences are held
by one task; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, free_names, partitions, quoted, release

SENTENCES, WORDS, PIECE, WINDOW = 2, 15, 16, 9
NO_ID = -(2**63)
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")
_B = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both odd bases modulo 2^64, and of their inverses."""
    global _tables
    if not _tables or len(_tables[0][0]) <= n:
        size = 1 << max(10, n.bit_length())
        _tables = [tuple(np.concatenate([np.ones(1, "uint64"), np.multiply.accumulate(np.full(size, x, "uint64"))]) for x in (b, pow(b, -1, 1 << 64))) for b in _B]
    return _tables


def cuts(words: list[str]) -> list[int]:
    """After how many words a long sentence is cut: behind the least hash (the last of equal ones) of each window, and at its end."""
    n = len(words)
    order = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), "int64", n) << 31 | np.arange(n, 0, -1)
    least, width = order, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.unique(n - (least & 0x7FFFFFFF)) + 1
    return at.tolist() if at[-1] == n else [*at.tolist(), n]


def sentences(text: str) -> tuple[list[int], list[int], list[str]]:
    """Where each sentence ends (with the white space after it), its number of words, and its words joined by spaces."""
    ends, sizes, texts, at = [], [], [], 0
    for stop in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if stop <= at:
            continue
        words = text[at:stop].split()
        if len(words) <= PIECE:
            if words or not ends:
                ends.append(stop)
                sizes.append(len(words))
                texts.append(" ".join(words))
            else:
                ends[-1] = stop
        else:
            pieces, lo = [m.end() for m in _WORD.finditer(text, at, stop)], 0
            for hi in cuts(words):
                ends.append(stop if hi == len(words) else pieces[hi - 1])
                sizes.append(hi - lo)
                texts.append(" ".join(words[lo:hi]))
                lo = hi
        at = stop
    return ends, sizes, texts


def runs(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of each run to hash."""
    n = len(sizes)
    if n < SENTENCES:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    total = np.concatenate([[0], np.cumsum(sizes)])
    i = np.arange(n)
    last = np.maximum(i + SENTENCES - 1, np.searchsorted(total, total[:-1] + WORDS, "left") - 1)
    first = np.minimum(i - SENTENCES + 1, np.searchsorted(total, total[1:] - WORDS, "right") - 1)
    pairs = np.concatenate([np.column_stack([i, last])[last < n], np.column_stack([first, i])[first >= 0]])
    pairs = np.unique(pairs[:, 0] * n + pairs[:, 1])
    return pairs // n, pairs % n


def run_hashes(texts: list[str], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), "<u8").reshape(-1, 2)
    out = []
    for k, (power, inverse) in enumerate(_powers(len(texts))):
        sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(raw[:, k] * power[: len(texts)])])
        h = (sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype("uint64")
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h ^ (h >> np.uint64(29))).view("int64"))
    return out[0], out[1]


SPANS = "h1 long, h2 long, p int, low long, high long"
_SPANS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("p", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
MARKS = "p int, h1 long, h2 long, one long"
_MARKS = pa.schema([("p", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("one", pa.int64())])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where rows with equal keys begin, in sorted rows."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _combined(parts: list[tuple]) -> pa.RecordBatch:
    """Runs that are equal and of one part, brought together: one row with the least and the largest id."""
    h1, h2, p, key = (np.concatenate([x[i] for x in parts]) for i in range(4))
    order = np.lexsort((p, h2, h1))
    h1, h2, p, key = h1[order], h2[order], p[order], key[order]
    at = _groups(h1, h2, p)
    return pa.record_batch([pa.array(x) for x in (h1[at], h2[at], p[at], np.minimum.reduceat(key, at), np.maximum.reduceat(key, at))], schema=_SPANS)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for batch in batches:
        for p, key, text in zip(*(batch[c].to_pylist() for c in ("p", "key", "text"))):
            _, sizes, texts = sentences(text or "")
            first, last = runs(sizes)
            if len(first):
                parts.append((*run_hashes(texts, first, last), np.full(len(first), p, "int32"), np.full(len(first), key)))
                rows += len(first)
            if rows > 500_000:  # bounds the memory; equal runs in two rows do no harm
                yield _combined(parts)
                parts, rows = [], 0
    if rows:
        yield _combined(parts)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by run: the parts where a text with a larger id than the run's least one holds it, and that least one."""
    held = None  # the rows of the latest run, which may go on in the next batch
    for batch in chain(batches, [None]):
        rows = held or [np.zeros(0, f.type.to_pandas_dtype()) for f in _SPANS]
        if batch is not None:
            rows = [np.concatenate([x, batch[f.name].to_numpy()]) for x, f in zip(rows, _SPANS)]
        if not len(rows[0]):
            continue
        at = _groups(*rows[:2])
        done = len(rows[0]) if batch is None else at[-1]
        held = [x[done:] for x in rows]
        h1, h2, p, low, high = (x[:done] for x in rows)
        if done:
            at = at[at < done]
            one = np.repeat(np.minimum.reduceat(low, at), np.diff([*at, done]))
            later = high > one
            yield pa.record_batch([pa.array(x[later]) for x in (p, h1, h2, one)], schema=_MARKS)


def _marked(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marks of a part, sorted by run."""
    h1, h2, one = (np.concatenate([x[i] for x in held] or [np.zeros(0, "int64")]) for i in range(3))
    order = np.lexsort((h2, h1))
    return h1[order], h2[order], one[order]


def _clean(text: str | None, key: int, marked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[str | None, int]:
    """The text without its runs that stand in a text of a smaller id, or earlier in itself."""
    if text is None:
        return None, 0
    ends, sizes, texts = sentences(text)
    first, last = runs(sizes)
    if not len(first):
        return text, 0
    h1, h2 = run_hashes(texts, first, last)
    gone = np.ones(len(first), bool)
    gone[np.unique(h1 ^ (h2 * np.int64(3)), return_index=True)[1]] = False
    if len(marked[0]):
        i = np.minimum(np.searchsorted(marked[0], h1), len(marked[0]) - 1)
        gone |= (marked[0][i] == h1) & (marked[1][i] == h2) & (marked[2][i] < key)
    return remove_runs(text, first[gone], last[gone], ends)


def remove_runs(text: str, first, last, ends: list[int] | None = None) -> tuple[str, int]:
    """The text without the sentences of the runs, from the first to the last of each, and the number of removed ones."""
    if not len(first):
        return text, 0
    ends = ends or sentences(text)[0]
    gone = np.zeros(len(ends) + 1, "int64")
    np.add.at(gone, first, 1)
    np.add.at(gone, np.asarray(last) + 1, -1)
    gone = np.cumsum(gone)[:-1] > 0
    kept = [text[lo:hi] for lo, hi, g in zip([0, *ends[:-1]], ends, gone.tolist()) if not g]
    return "".join(kept), int(gone.sum())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated sentences gone from the text, and one more column: n_removed, the number of these sentences.

    Where the table has an n_removed of its own, the number's column is the last one, called _n_removed (with further underscores if need be).
    """
    spark = docs.sparkSession
    n = partitions(spark)
    counted = "n_removed" if "n_removed" not in [c.lower() for c in docs.columns] else free_names(docs, "n_removed")[0]
    packed = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"), packed.alias("row"))
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        # Ids that aren't unique: places are numbered in the order of id and hash; numbers of later ranges are larger.
        places = rows.select("key", "h").distinct().repartitionByRange("key", "h").sortWithinPartitions("key", "h")
        places = cut(places.select("key", "h", F.monotonically_increasing_id().alias("place")))
        rows = rows.join(places, ["key", "h"]).select(F.col("place").alias("key"), "h", "text", "row")
    rows = rows.select(F.pmod(F.xxhash64("key", "h"), F.lit(n)).cast("int").alias("p"), "key", "text", "row")
    spans = rows.select("p", "key", "text").repartition(n, "p").mapInArrow(_spans, SPANS)
    # A run has a row for each part at most, or a few, so that no task gets one run's places.
    marks = cut(spans.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(_repeated, MARKS))
    del spans
    release(spark)
    # The marks of a part, then its documents.
    none = F.lit(None).cast(rows.schema["row"].dataType)
    both = marks.select("p", F.lit(0).alias("order"), "h1", "h2", "one", none.alias("row"))
    both = both.unionByName(rows.select("p", F.lit(1).alias("order"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.col("key").alias("one"), "row"))
    both = both.repartition(n, "p").sortWithinPartitions("p", "order")
    names = docs.columns
    slot = names.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, marked = None, [], None
        for batch in batches:
            ps, order, h1, h2, key = (batch[c].to_numpy() for c in ("p", "order", "h1", "h2", "one"))
            cols = batch["row"].filter(pa.array(order == 1)).flatten()
            texts, done = iter(cols[slot].cast(pa.string()).to_pylist()), []
            starts = _groups(ps, order).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(ps)]):
                if ps[lo] != part:
                    part, held, marked = ps[lo], [], None
                if order[lo] == 0:
                    held.append((h1[lo:hi], h2[lo:hi], key[lo:hi]))
                    continue
                marked = marked or _marked(held)
                done += [_clean(next(texts), k, marked) for k in key[lo:hi].tolist()]
            if done:
                cols[slot] = pa.array([d[0] for d in done], pa.string())
                yield pa.record_batch([*cols, pa.array([d[1] for d in done], pa.int64())], names=[*names, counted])

    fields = [f if f.name != text_col else StructField(f.name, StringType()) for f in docs.schema.fields]
    return both.mapInArrow(clean, StructType([*fields, StructField(counted, LongType())]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated sentences gone and the number of characters brought up to date; all rows stay."""
    out = substring_dedup(docs)
    return out.select(*[F.length("text").cast(f.dataType).alias(f.name) if f.name == "n_chars" else F.col(quoted(f.name)) for f in docs.schema.fields])
