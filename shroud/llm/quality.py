"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time are boosted in cycles; their sum is one lookup table over the bins of each feature.
Pairs of features whose residual a four-leaf tree explains best get a small two-dimensional table, boosted likewise. A
text's score is the logistic of the sum of its table entries.

Features come from the whole text alone. The model is fitted on the driver on a bounded sample of labelled rows,
``SAMPLE`` of them at most, chosen by the hash of their id; every text is scored.

Defined results: null and empty texts are scored like any other (their features are zeros); rows whose labels contradict
one another and null labels are not learned from; with one class or no label in the sample the score is that class (1 or 0),
or one half; repeated rows each get a result; texts of any length go through
in bounded chunks of bytes (words are held whole); an empty table gives an empty result; other columns are ignored, or passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, quoted, slices

SAMPLE = 20_000  # labelled rows that the fit uses at most
BINS, PAIR_BINS = 32, 8
CYCLES, PAIR_CYCLES, PAIRS = 120, 40, 6
RATE, RIDGE = 0.1, 1.0
ACCEPT = 0.7
FEATURES = (
    "log_bytes", "upper", "symbol", "bang", "digit", "comma", "stop", "pipe", "word_bytes", "distinct", "top_word",
    "repeat", "short", "line_words", "stop_words", "non_ascii", "symbol_end", "long_word",
)

_CLASS = np.zeros(256, "uint8")  # 1 lower, 2 upper, 3 symbol, 4 !, 5 digit, 6 comma, 7 stop, 8 pipe, 9 line feed, 10 other white space
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[[ord(c) for c in "*#$%&@^~=+<>{}[]\\_/"]] = 3
_CLASS[ord("!")] = 4
_CLASS[ord("0") : ord("9") + 1] = 5
_CLASS[[ord(c) for c in ",;:"]] = 6
_CLASS[[ord(c) for c in ".?"]] = 7
_CLASS[ord("|")] = 8
_CLASS[10] = 9
_CLASS[[9, 11, 12, 13, 32]] = 10


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", "uint8")[at[0] : at[-1]]
    at = at - at[0]
    sizes = np.diff(at)
    count, wide = np.zeros((n, 11)), np.zeros(n)
    for lo in range(0, len(raw), CHUNK):  # a chunk of bytes at a time, however long a text is
        part = raw[lo : lo + CHUNK]
        first, last = np.searchsorted(at, [lo, lo + len(part) - 1], "right") - 1
        doc = np.repeat(np.arange(first, last + 1), np.diff(np.clip(at[first : last + 2], lo, lo + len(part)))) - first
        kind = _CLASS[part]
        # The capitals among U+00C0 to U+00DE: lead byte 0xC3, then 0x80 to 0x9E.
        lead = raw[lo - 1 : lo + len(part) - 1] if lo else np.concatenate([[0], part[:-1]])
        kind[(lead == 0xC3) & (part >= 0x80) & (part <= 0x9E)] = 2
        count[first : last + 1] += np.bincount(doc * 11 + kind, minlength=11 * (last + 1 - first)).reshape(-1, 11)
        wide[first : last + 1] += np.bincount(doc[part >= 128], minlength=last + 1 - first)
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    ends = np.asarray(words.offsets)[1:] - np.asarray(words.offsets)[0]
    n_words = np.diff(np.concatenate([[0], ends]))
    owner = np.repeat(np.arange(n), n_words)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype("int64")
    length = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype("int64")
    tail = pc.match_substring_regex(coded.dictionary, r"[*#$%&!|]$").to_numpy(zero_copy_only=False)
    filled = length[codes] > 0 if len(codes) else np.zeros(0, bool)  # Arrow makes an empty word of white space at an end
    codes, owner = codes[filled], owner[filled]
    n_words = np.bincount(owner, minlength=n)
    size = length[codes] if len(codes) else codes

    def by_doc(x) -> np.ndarray:
        return np.bincount(owner, weights=x, minlength=n) if len(owner) else np.zeros(n)

    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    kinds, times = np.unique(owner << 32 | codes, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, kinds >> 32, times)
    b, w, letters = np.maximum(sizes, 1), np.maximum(n_words, 1), np.maximum(count[:, 1] + count[:, 2], 1)
    return np.column_stack([
        np.log1p(sizes), count[:, 2] / letters, count[:, 3] / b, count[:, 4] / w, count[:, 5] / b, count[:, 6] / w, count[:, 7] / w, count[:, 8] / w, sizes / w,
        np.bincount(kinds >> 32, minlength=n) / w, top / w, by_doc(again) / w, by_doc(size <= 3) / w, n_words / (count[:, 9] + 1), n_words / (count[:, 7] + 1),
        wide / b, by_doc(tail[codes] if len(codes) else codes) / w, by_doc(size > 20) / w,
    ])


@dataclass
class Additive:
    """edges, tables: by feature; pairs: (i, j, edges of i, edges of j, table)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, ei, ej, t in self.pairs:
            total += t[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins: quantiles of the distinct values, so that rare values keep bins of their own."""
    values = np.unique(x)
    q = np.concatenate([np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:-1])]) if len(values) > bins else values[1:]
    return np.unique(q)


def _leaf(g, h):
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins, as a table: greedy splits by Newton gain."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]

    def split(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        m = np.arange(lo + 1, hi)
        gl, hl, gt, ht = cg[m] - cg[lo], ch[m] - ch[lo], cg[hi] - cg[lo], ch[hi] - ch[lo]
        gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
        k = int(np.argmax(gain))
        return float(gain[k]), int(m[k])

    while len(parts) < leaves:
        (gain, m), p = max(((split(*p), p) for p in parts), key=lambda x: x[0][0])
        if gain <= 1e-9:
            break
        parts.remove(p)
        parts += [(p[0], m), (m, p[1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(cg[hi] - cg[lo], ch[hi] - ch[lo])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis of a two-dimensional histogram: its gain and its table."""
    cg, ch = (np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h))
    a, b = g.shape
    best, cut = -1.0, None
    for i in range(1, a):
        for j in range(1, b):
            gain = sum(G**2 / (H + RIDGE) for G, H in ((c[i, j], d[i, j]) for c, d in ((cg, ch),)))
            for G, H in (
                (cg[i, b] - cg[i, j], ch[i, b] - ch[i, j]),
                (cg[a, j] - cg[i, j], ch[a, j] - ch[i, j]),
                (cg[a, b] - cg[i, b] - cg[a, j] + cg[i, j], ch[a, b] - ch[i, b] - ch[a, j] + ch[i, j]),
            ):
                gain += G**2 / (H + RIDGE)
            if gain > best:
                best, cut = gain, (i, j)
    out = np.zeros((a, b))
    if cut:
        i, j = cut
        for s in ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, b)), (slice(i, a), slice(0, j)), (slice(i, a), slice(j, b))):
            out[s] = _leaf(g[s].sum(), h[s].sum())
    return best - cg[a, b] ** 2 / (ch[a, b] + RIDGE), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Newton boosting of the logistic loss, cyclic over features, then over pairs."""
    if len(set(y.tolist())) < 2:
        return Additive(0.0 if not len(y) else (30.0 if y[0] else -30.0), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [_edges(c, BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for j, b in enumerate(bins):
            g, h = slopes()
            k = len(tables[j])
            t = RATE * _tree(np.bincount(b, g, k), np.bincount(b, h, k))
            tables[j] += t
            total += t[b]
    coarse = [_edges(c, PAIR_BINS) for c in x.T]
    cb = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cb[i] * b + cb[j], v, a * b).reshape(a, b)

    g, h = slopes()
    gains = {(i, j): _quadrants(grid(i, j, g), grid(i, j, h))[0] for i in range(len(cb)) for j in range(i)}
    chosen = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(PAIR_CYCLES):
        for t, (i, j) in zip(pair_tables, chosen):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            t += step
            total += step[cb[i], cb[j]]
    return Additive(base, edges, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, pair_tables)])


SLICE, BYTES = 2000, 4 << 20  # rows and bytes of text whose features are made at a time
CHUNK = 1 << 20


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on labelled rows that are not held out; the driver gets ``sample`` rows of features at most."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", F.col("y").cast("int").alias("y"))
    # Twice the sample of labels, as some have no text; both are bounds, not shares.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE, BYTES):
                x = features(part["text"])
                yield pa.record_batch([part["doc_id"], part["y"], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(make, "doc_id long, y int, x array<double>")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toArrow()
    x = np.array(got["x"].to_pylist(), "float64").reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype("float64"))


def _scored(rows: DataFrame, text_col: str, model: Additive, drop_text: bool = False) -> DataFrame:
    """``rows`` and, last, the score of each text; without the text if that is no more needed."""
    told = rows.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    fields = [f for f in rows.schema.fields if not (drop_text and f.name == text_col)]
    names = [f.name for f in fields]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE, BYTES):
                yield pa.record_batch([*[part[c] for c in names], pa.array(told.value.score(features(part[text_col])))], names=[*names, "score"])

    return rows.mapInArrow(make, StructType([*fields, StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every text."""
    return _scored(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")), "text", model, True)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(docs, train(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, whatever their names."""
    names, text = docs.columns, f"c{docs.columns.index('text')}"
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    out = _scored(rows, text, train(docs, labels, sample)).where(F.col("score") >= ACCEPT)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
