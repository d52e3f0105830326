"""Order-preserving packing by dynamic programming.

Documents in ascending order of id form a stream of ids in each range. Cuts may fall at the ends of documents (free) and
at the ends of sentences (a small penalty); only a sentence longer than a whole window may be cut inside (a larger one). A sequence costs
its padding: what it lacks to 1024, or nothing at a power of two. With P the place and D the least cost of a cut,

    D(i) = penalty(i) + min( min over P(j) >= P(i) - 1024 of [D(j) + P(j)] + 1024 - P(i),  D(j) where P(i) - P(j) is a power of two )

and the inner minimum is kept by a monotone queue. The programme runs on as documents come; every ``BLOCK`` ids the cuts that
all continuations share (the way back from every cut that may still be continued has met in one) are final and leave the memory. So the result is the
optimum of the whole range, and only the end of a range is short. Ranges are Spark's partitions by id.

Defined results: null text is empty and has only the end id; a null id comes first; equal ids are ordered by a hash of the text, then by text, and
packed as documents of their own, so are repeated rows; a text of any length goes on over as many sequences as it needs; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices
from .tokens import BYTES, SLICE, encoder, release_unused

LENGTH = 1024
POWERS = (128, 256, 512)  # shorter sequences that need no padding
SENTENCE, INSIDE = 2.0, 12.0  # penalties, in ids of padding
GAP = 64  # a sentence longer than a window may be cut every so many ids
BLOCK = 200_000  # ids after which settled cuts are looked for; the cuts don't depend on it
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_marks: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _sentence_marks(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id: whether its text ends a sentence, and whether it begins with white space."""
    if path not in _marks:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        text = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        space = ("Ġ", "Ċ", "ĉ", "č")  # how the vocabulary writes space, line feed, tab, return
        _marks[path] = np.array([t.endswith((".", "!", "?", "Ċ")) for t in text]), np.array([t.startswith(space) for t in text])
    return _marks[path]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, marks, longest: int = LENGTH, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may fall, ascending from 0 to the end, and the penalty of each."""
    ends, spaces = marks
    n = len(ids)
    price = np.full(n + 1, np.inf)
    price[1:-1][ends[ids[:-1]] & spaces[ids[1:]]] = SENTENCE
    price[doc_ends] = 0
    price[0] = price[n] = 0
    at = np.flatnonzero(np.isfinite(price))
    wide = np.flatnonzero(np.diff(at) > longest)
    inner = [np.arange(at[i] + gap, at[i + 1], gap) for i in wide]
    if inner:
        inner = np.concatenate(inner)
        price[inner] = INSIDE
        at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


class Cuts:
    """The dynamic programme over places that come in ascending order, from 0 on."""

    def __init__(self, length: int = LENGTH, powers=POWERS):
        self.length, self.powers = length, powers
        self.place, self.cost, self.back = [0], [0.0], [0]
        self.queue = deque([(0.0, 0)])  # cost + place, and index, both ascending
        self.gone = 0  # nodes that have left the memory

    def add(self, at: np.ndarray, price: np.ndarray) -> None:
        place, cost, back, queue, length, gone = self.place, self.cost, self.back, self.queue, self.length, self.gone
        begin = len(place)
        place.extend(at.tolist())
        low = int(np.searchsorted(place, place[begin - 1] - max(self.powers, default=0)))
        near = np.array(place[low:])
        exact: dict[int, list[int]] = {}  # cuts that stand a power of two before a cut
        for k in self.powers:
            at_k = np.searchsorted(near, at - k)
            for i in np.flatnonzero(near[np.minimum(at_k, len(near) - 1)] == at - k).tolist():
                exact.setdefault(begin + i, []).append(low + int(at_k[i]))
        for i, penalty in enumerate(price.tolist(), begin):
            p = place[i]
            while place[queue[0][1] - gone] < p - length:
                queue.popleft()
            score, j = queue[0]
            best, least = j - gone, score + length - p
            for j in exact.get(i, ()):
                if cost[j] < least:
                    best, least = j, cost[j]
            cost.append(least + penalty)
            back.append(best + gone)
            s = cost[i] + p
            while queue and queue[-1][0] >= s:
                queue.pop()
            queue.append((s, i + gone))

    def way(self, i: int) -> list[int]:
        """The places on the way to node i, the first one that is in the memory too."""
        out = [self.place[i]]
        while i:
            i = self.back[i] - self.gone
            out.append(self.place[i])
        return out[::-1]

    def settled(self) -> list[int]:
        """The places of the cuts that every continuation shares; what lies before the last of them is forgotten."""
        live = [-i for i in range(int(np.searchsorted(self.place, self.place[-1] - self.length)), len(self.place))]
        heapify(live)
        while len(live) > 1:
            last = -heappop(live)
            if live and -live[0] == last:
                continue
            if live:
                heappush(live, -(self.back[last] - self.gone))
        i = -live[0]
        out = self.way(i)
        self.place, self.cost, self.back = self.place[i:], self.cost[i:], self.back[i:]
        self.gone += i
        self.back[0] = self.gone
        while self.queue[0][1] < self.gone:
            self.queue.popleft()
        return out

    def finish(self) -> list[int]:
        return self.way(len(self.place) - 1)


def best_cuts(at: np.ndarray, price: np.ndarray, length: int = LENGTH, powers=POWERS) -> list[int]:
    """Cut places, from 0 to the last of ``at``, of least total cost."""
    cuts = Cuts(length, powers)
    cuts.add(at[1:], price[1:])
    return cuts.finish()


class _Stream:
    """The ids of one range that wait to be packed, and the documents that they belong to."""

    def __init__(self, pid: int, marks):
        self.marks, self.next_id, self.cuts = marks, pid << 32, Cuts()
        self.fresh, self.kept = [], np.zeros(0, "<u4")  # not yet in the programme; in it, but not yet packed
        self.docs = deque()  # id, place of its first and behind its last id
        self.begin = self.end = self.n = 0  # places of the first id that is kept, and of the end; fresh ids

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.fresh.append(ids)
        self.docs.append((doc_id, self.end, self.end + len(ids)))
        self.end += len(ids)
        self.n += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch:
        if self.n:
            base = self.end - self.n
            at, price = cut_points(np.concatenate(self.fresh), np.array([e - base for _, _, e in self.docs if e > base]), self.marks)
            self.cuts.add(at[1:] + base, price[1:])
            self.kept = np.concatenate([self.kept, *self.fresh]).astype("<u4", copy=False)
            self.fresh, self.n = [], 0
        cuts = self.cuts.finish() if last else self.cuts.settled()
        raw, rows = memoryview(self.kept).cast("B"), []
        for lo, hi in zip(cuts, cuts[1:]):
            at = lo
            while at < hi:
                doc_id, begin, end = self.docs[0]
                stop = min(hi, end)
                rows.append((doc_id, at - begin, stop - at, zlib.crc32(raw[4 * (at - self.begin) : 4 * (stop - self.begin)]), end - begin, self.next_id, at - lo))
                at = stop
                if stop == end:
                    self.docs.popleft()
            self.next_id += 1
        self.kept, self.begin = self.kept[cuts[-1] - self.begin :].copy(), cuts[-1]
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=_NAMES)


def _packer(vocabulary: str, end_id: int, special: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, False, special).encode
        stream = _Stream(TaskContext.get().partitionId(), _sentence_marks(vocabulary))
        for batch in batches:
            for part in slices(batch, "text", SLICE, BYTES):
                ids, ends = encode(part["text"])
                ids = np.insert(ids, ends, end_id).astype("uint32")
                ends = ends + np.arange(1, len(ends) + 1)
                for doc_id, a, b in zip(part["doc_id"].to_pylist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                    stream.add(doc_id, ids[a:b])
                    if stream.n >= BLOCK:
                        yield stream.pack(False)
        if stream.docs:
            yield stream.pack(True)
        release_unused()

    return pack


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.xxhash64(F.col(quoted(text_col))).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return rows.mapInArrow(_packer(vocabulary, end_id, special), PIECES)
