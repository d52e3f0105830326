"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct words of a batch (each with the mark of the space before it) are concatenated and indexed by a suffix array, sorted
as far as the longest piece reaches. Binary search finds for every piece of the vocabulary the range of suffixes that begin
with it, so all its occurrences. These edges, sorted by position, are relaxed from left to right.

For a vocabulary of merges the relaxation keeps one edge for each position: the last piece of the encoding of the text up to
there. An edge is that piece if the encoding up to its start ends with a piece that is compatible with it, which holds if the
two together are encoded as just these two. Merges never cross a place where the encoding of the whole is cut, so a text's
encoding is the only chain of pairwise compatible pieces. Compatibility is decided by the merge rule itself (lowest rank
first, then leftmost) on the two pieces' characters, and remembered. Characters that no piece covers become their bytes' pieces.

Defined results: null counts as empty; the empty text has no ids and decodes to the empty text; very long words take
memory in proportion to their length only; repeated rows each get a result; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import WordTable, with_whole

MARK = "▁"  # stands for a space
SLICE = 3000
#: Marks in a row belong to the word that follows them.
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_models: dict[str, "Pieces"] = {}


def model(path: str) -> "Pieces":
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` codes from each on. Codes are small and 0 stands for the end of a word."""
    width = max(1, int(codes.max(initial=1)).bit_length())
    per = 63 // width
    n, key, have = len(codes), codes.astype("int64"), 1
    while have < min(per, depth):  # doubles while the codes fit into one number
        step = min(have, per - have)
        tail = np.zeros(n, "int64")
        tail[: n - have] = key[have:] >> (width * (have - step)) if step < have else key[have:]
        key = key << (width * step) | tail
        have += step
    while True:
        order = np.argsort(key, kind="stable")
        if have >= depth:
            return order
        rank = np.zeros(n, "int64")
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) + 1
        tail = np.zeros(n, "int64")
        tail[: max(n - have, 0)] = rank[have:]
        key, have = rank * (n + 2) + tail, have * 2


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte = {}
        self.piece: dict[str, int] = {}
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[sp.id_to_piece(i)] = i
        self.value = {i: b for b, i in self.byte.items()}
        self.rank = {t: -sp.get_score(i) for t, i in self.piece.items()}
        self.text = {i: t for t, i in self.piece.items()}
        # Pieces with a mark inside would tie words together; then a word is not a unit.
        self.by_word = all(MARK not in t[1:] or not t.strip(MARK) for t in self.piece)
        self.depth = max(map(len, self.piece))
        self.none = size  # a character that no piece covers
        self.whole = np.zeros(size + 1, bool)  # pieces whose own text is encoded as that piece
        for t, i in self.piece.items():
            self.whole[i] = len(t) == 1 or self.merge(t) == [t]
        self.pairs, self.fit = np.zeros(0, "int64"), np.zeros(0, bool)  # remembered pairs in order, and whether they fit
        self.more: dict[int, bool] = {}  # pairs that are not in order yet
        self.table = WordTable(self.encode_words)

    def merge(self, text: str) -> list[str]:
        """The merge rule on a short text: the pair with the lowest rank first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (t := parts[i] + parts[j]) in self.rank:
                heapq.heappush(heap, (self.rank[t], i, j, t))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, t = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != t:
                continue
            parts[i], parts[j] = t, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether the text of both pieces is encoded as these two, for many pairs."""
        keys = before << 20 | after
        good = (before == self.none) | (after == self.none)
        at = np.minimum(np.searchsorted(self.pairs, keys), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
        good[known] |= self.fit[at[known]]
        ask = np.flatnonzero(~known & ~good)
        if len(ask):
            new, place = np.unique(keys[ask], return_inverse=True)
            said = []
            for k in new.tolist():
                if k not in self.more:
                    a, b = self.text[k >> 20], self.text[k & 0xFFFFF]
                    self.more[k] = self.merge(a + b) == [a, b]
                said.append(self.more[k])
            good[ask] = np.array(said)[place]
        return good

    def remember(self) -> None:
        if len(self.pairs) + len(self.more) > 6_000_000:
            self.pairs, self.fit = np.zeros(0, "int64"), np.zeros(0, bool)
        pairs = np.concatenate([self.pairs, np.fromiter(self.more.keys(), "int64", len(self.more))])
        fit = np.concatenate([self.fit, np.fromiter(self.more.values(), bool, len(self.more))])
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.fit, self.more = pairs[order], fit[order], {}

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence in the concatenated words, by place in the word; and where each word begins."""
        # A null character in a word becomes another one that no piece covers; its byte comes from the word itself.
        safe = [w.replace("\0", "\U0010ffff") if "\0" in w else w for w in words]
        raw = np.frombuffer("\0".join(safe).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", "<u4")
        alphabet = np.unique(raw)
        codes = np.searchsorted(alphabet, raw).astype("int64")
        if alphabet[0] != 0 or len(words) == 0:
            codes = codes + 1
        pieces = [(t, i) for t, i in self.piece.items() if len(t) > 1]
        depth = min(self.depth, max(map(len, words)) + 1)
        pieces = [(t, i) for t, i in pieces if len(t) <= depth]
        order = suffix_order(codes, depth)
        flat = np.frombuffer("".join(t for t, _ in pieces).encode("utf-32-le"), "<u4")
        size = np.array([len(t) for t, _ in pieces], "int64")
        at = np.minimum(np.searchsorted(alphabet, flat), len(alphabet) - 1)
        known = np.logical_and.reduceat(alphabet[at] == flat, np.cumsum(size) - size)
        begin = (np.cumsum(size) - size)[known]
        size, ids = size[known], np.array([i for _, i in pieces], "int64")[known]
        padded = np.concatenate([codes, np.zeros(depth, "int64")])
        # All pieces are searched together, one code of the comparison at a time.
        lo, hi = np.zeros(len(ids), "int64"), np.full(len(ids), len(order), "int64")
        for k in range(int(size.max(initial=0))):
            who = np.flatnonzero(size > k)
            want = at[begin[who] + k]
            lo[who], hi[who] = _narrow(order, padded, k, want, lo[who], hi[who], False), _narrow(order, padded, k, want, lo[who], hi[who], True)
        found = hi - lo
        starts = order[np.arange(found.sum()) + np.repeat(lo - (np.cumsum(found) - found), found)]
        which = np.repeat(np.arange(len(ids)), found)
        keep = self.whole[ids[which]]
        starts, stops, which = starts[keep], (starts + size[which])[keep], ids[which][keep]
        one = np.array([self.piece.get(chr(c), self.none) if c else -1 for c in alphabet.tolist()], "int64")[np.searchsorted(alphabet, raw)]
        single = np.flatnonzero(one >= 0)
        starts, stops, which = np.concatenate([starts, single]), np.concatenate([stops, single + 1]), np.concatenate([which, one[single]])
        breaks = np.flatnonzero(raw == 0)
        first = np.concatenate([[0], breaks[:-1] + 1])
        place = starts - first[np.searchsorted(breaks, starts)]
        by = np.argsort(place, kind="stable")
        return starts[by], stops[by], which[by], place[by], first, breaks

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with its mark, in a row, and where each word's end. All words advance together."""
        start, end, piece, place, first, breaks = self.edges(words)
        last, size = np.full(int(breaks[-1]) + 1, -1), np.zeros(int(breaks[-1]) + 1, "int64")
        cuts = np.searchsorted(place, np.arange(int(place.max(initial=0)) + 2))
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            if i:
                live = (last[s] >= 0) & (last[e] < 0)
                s, e, p = s[live], e[live], p[live]
                good = self.compatible(last[s], p)
                s, e, p = s[good], e[good], p[good]
            last[e], size[e] = p, e - s
        self.remember()
        at, who, found, owner = breaks.copy(), np.arange(len(words)), [], []
        while len(who := who[at[who] > first[who]]):
            here = at[who]
            found.append(last[here])
            owner.append(who)
            at[who] = here - size[here]
        if not found:
            return np.zeros(0, "uint32"), np.zeros(len(words), "int64")
        step = np.repeat(np.arange(len(found)), [len(f) for f in found])
        ids, owner = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((-step, owner))
        ids, counts = ids[order], np.bincount(owner, minlength=len(words))
        if (ids == self.none).any():
            return self._with_bytes(words, ids, counts)
        return ids.astype("uint32"), np.cumsum(counts)

    def _with_bytes(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, ends, at = [], [], 0
        for word, n in zip(words, counts.tolist()):
            i = 0
            for p in ids[at : at + n].tolist():
                if p == self.none:
                    out += [self.byte.get(b, self.sp.unk_id()) for b in word[i].encode("utf-8", "replace")]
                    i += 1
                else:
                    out.append(p)
                    i += len(self.text[p])
            at += n
            ends.append(len(out))
        return np.array(out, "uint32"), np.array(ends, "int64")

    def normal(self, texts: list[str]) -> list[str]:
        """As the model prescribes, with spaces written as marks."""
        return [self.sp.normalize(t) for t in texts]

    def encode(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts in a row, and where each text's end."""
        texts = pa.array(normal, pa.large_string())
        # One mark before each word and none elsewhere: then words are units. Other texts are units as a whole.
        odd = pc.or_(pc.match_substring(texts, MARK * 2), pc.or_(pc.invert(pc.starts_with(texts, MARK)), pc.ends_with(texts, MARK))).to_numpy(zero_copy_only=False) | (not self.by_word)
        words = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), MARK)
        coded = words.flatten().dictionary_encode()
        ends = np.asarray(words.offsets)[1:] - np.asarray(words.offsets)[0]
        marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # The part before the first mark is empty.
        keep = np.ones(len(codes), bool)
        keep[np.concatenate([[0], ends[:-1]])] = False
        ids, total = self.table.gather(marked, codes[keep], np.concatenate([[0], np.cumsum(keep)])[ends])
        if not odd.any():
            return ids, total
        units, owner = [], []
        for k, t in enumerate(t for t, o in zip(normal, odd) if o):
            for u in _UNIT.findall(t) if self.by_word else [t]:
                units.append(u)
                owner.append(k)
        flat, stops = self.encode_words(units) if units else (np.zeros(0, "uint32"), np.zeros(0, "int64"))
        last = np.searchsorted(np.array(owner, "int64"), np.arange(int(odd.sum())), "right")
        return with_whole(odd, ids, total, flat, np.concatenate([[0], stops])[last])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, runs of byte pieces as UTF-8, marks as spaces, the first space dropped."""
        out, raw = [], bytearray()
        value = self.value
        for i in ids.tolist():
            if i in value:
                raw.append(value[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.text.get(i, ""))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def _narrow(order: np.ndarray, codes: np.ndarray, k: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search in each range of suffixes, which agree in their first k codes, for where code k reaches ``want``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = codes[order[np.minimum(mid, len(order) - 1)] + k]
        up = open_ & ((at <= want) if right else (at < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array) of every text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = m.encode(m.normal([t or "" for t in part["text"].to_pylist()]))
                ends = np.concatenate([[0], ends]).astype("int32")
                yield pa.record_batch([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype("int32")))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(np.array(x if x is not None else [], "int64")) for x in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(make, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit), n_chars and round_trip (decoding gives the normalised text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [t or "" for t in part["text"].to_pylist()]
                normal = m.normal(texts)
                flat, ends = m.encode(normal)
                ids = np.split(flat, ends[:-1])
                back = [m.decode(x) == n.replace(MARK, " ").removeprefix(" ") for x, n in zip(ids, normal)]
                yield pa.record_batch(
                    [part["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(back, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean")
