"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its affixes of one to three letters, its letter bigrams and trigrams, its identity and the entry of
a learned lexicon; each hashes to a row of weights, one for each language. Learned transition weights link neighbouring
words. Forward-backward gives every word a distribution over the languages, also where a text switches between them; a
document's language is the one with the largest mean over its words.

Long texts are cut into chunks for speed alone: the transfer matrices of all chunks are multiplied up in step, the
messages between chunks follow in a scan, and the result is that of one pass over the whole text.

The field is fitted on the driver on a bounded sample: up to ``SAMPLE`` documents by the hash of their id, and of each language
that has fewer than ``LEAST`` among these up to ``LEAST`` of its own, so that a rare language is learned at every size; from each up to
``SEGMENTS`` runs of ``RUN`` words spread over the text. Some training sequences join runs of two languages, from which the
transitions learn that texts switch. All documents are labelled, whole.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where no language was learned; ties go to
the language first in order; repeated rows each get a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out, slices

SAMPLE, LEAST, SEGMENTS, RUN = 4000, 500, 3, 16
DIM = 1 << 17  # rows of hashed weights; the last are the lexicon's
LEXICON = 4096  # words that the lexicon holds at most
EPOCHS, BATCH, RATE, DECAY = 4, 256, 0.1, 1e-4
SWITCHED = 0.2  # share of training sequences that switch language
CHUNK = 128
SLICE = 2000
UND = "und"


def clean(words: pa.Array) -> pa.Array:
    """Lower-case letters of each word."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}]+", ""))


def word_features(words: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights of all words in a row, and where each word's end. Words are clean and not empty."""
    n = len(words)
    if not n:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    texts = words.to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("uint64")
    size = np.array([len(t) for t in texts], "int64")
    end = np.cumsum(size)
    begin = end - size
    mod = np.uint64(DIM - LEXICON - 16)
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

    def row(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * m3
        return ((h ^ (h >> np.uint64(29))) * m1 >> np.uint64(11)) % mod

    own = np.repeat(np.arange(n), size)
    place = np.arange(len(codes)) - begin[own]
    grams, owners = [], []

    def add(rows: np.ndarray, who: np.ndarray) -> None:
        grams.append(rows.astype("int64"))
        owners.append(who)

    two = codes[:-1] * m1 + codes[1:] * m2
    ok2 = place[1:] > 0
    add(row(two[ok2], 2), own[1:][ok2])
    three = two[:-1] * m3 + codes[2:] * m1
    ok3 = place[2:] > 1
    add(row(three[ok3], 3), own[2:][ok3])
    whole = np.add.reduceat(codes * (place.astype("uint64") * np.uint64(2) + np.uint64(1)) * m2, begin)
    add(row(whole, 9), np.arange(n))
    for k in (1, 2, 3):
        who = np.flatnonzero(size >= k)
        front, back = np.zeros(len(who), "uint64"), np.zeros(len(who), "uint64")
        for i in range(k):
            front = front * m2 + codes[begin[who] + i]
            back = back * m2 + codes[end[who] - k + i]
        add(row(front, 10 + k), who)
        add(row(back, 20 + k), who)
    known = [(i, lexicon[t]) for i, t in enumerate(texts) if t in lexicon]
    if known:
        who, at = np.array(known, "int64").T
        add(DIM - LEXICON + at, who)
    rows, who = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return rows[order], np.cumsum(np.bincount(who, minlength=n))


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # DIM x languages
    moves: np.ndarray  # languages x languages, log
    lexicon: dict[str, int]
    table: dict[str, int] = field(default_factory=dict)  # a worker's distinct raw words
    scores: np.ndarray | None = None

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "moves": self.moves, "lexicon": self.lexicon, "table": {}, "scores": None}

    def emit(self, raw: list[str]) -> np.ndarray:
        """Scores of raw words; nan for words without a letter."""
        out = np.full((len(raw), len(self.langs)), np.nan, "float32")
        words = clean(pa.array(raw, pa.large_string()))
        has = np.flatnonzero(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
        if len(has):
            rows, ends = word_features(words.take(pa.array(has)), self.lexicon)
            out[has] = np.add.reduceat(self.weights[rows], np.concatenate([[0], ends[:-1]]))
        return out

    def look_up(self, raw: list[str]) -> np.ndarray:
        if self.scores is None or len(self.table) > 400_000:
            self.table, self.scores = {}, np.zeros((0, len(self.langs)), "float32")
        if new := [w for w in raw if w not in self.table]:
            self.table.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.scores = np.concatenate([self.scores, self.emit(new)])
        return self.scores[np.array([self.table[w] for w in raw], "int64")] if raw else self.scores[:0]

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distribution over the languages of every word with a letter, and where each text's words end."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.asarray(words.offsets)[1:] - np.asarray(words.offsets)[0]
        coded = words.flatten().dictionary_encode()
        score = self.look_up(coded.dictionary.to_pylist())
        lettered = ~np.isnan(score[:, 0]) if len(score) else np.zeros(0, bool)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        has = lettered[codes] if len(codes) else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(has)])[ends]
        if not has.any():
            return np.zeros((0, len(self.langs))), ends
        e = score[codes[has]]
        return forward_backward(np.exp(e - e.max(1, keepdims=True)), ends, np.exp(self.moves)), ends


def forward_backward(e: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of every word. e: emission weights of all texts' words in a row; moves: transition weights."""
    k = moves.shape[0]
    moves = moves.astype("float32")
    begins = np.concatenate([[0], ends[:-1]])
    lens = ends - begins
    n_chunks = -(-lens // CHUNK)
    first = np.cumsum(n_chunks) - n_chunks
    owner = np.repeat(np.arange(len(ends)), n_chunks)
    nth = np.arange(len(owner)) - first[owner]
    lo = begins[owner] + nth * CHUNK
    size = np.minimum(ends[owner] - lo, CHUNK)
    order = np.argsort(-size, kind="stable")
    lo_s, size_s = lo[order], size[order]
    active = np.searchsorted(-size_s, -np.arange(CHUNK), "left")  # how many chunks are longer than t

    matrix = np.broadcast_to(np.eye(k, dtype="float32"), (len(lo), k, k)).copy()
    if n_chunks.max(initial=0) > 1:
        for t in range(int(size_s[0])):
            a = active[t]
            x = (matrix[:a] @ moves) * e[lo_s[:a] + t][:, None, :]
            matrix[:a] = x / x.max((1, 2), keepdims=True)
    transfer = np.empty_like(matrix)
    transfer[order] = matrix
    front = np.full((len(lo), k), 1 / k, "float32")
    back = np.full((len(lo), k), 1.0, "float32")
    for c in range(1, int(n_chunks.max(initial=0))):
        who = first[n_chunks > c] + c
        x = np.einsum("ni,nij->nj", front[who - 1], transfer[who - 1])
        front[who] = x / x.sum(1, keepdims=True)
    for c in range(int(n_chunks.max(initial=0)) - 2, -1, -1):
        who = first[n_chunks > c + 1] + c
        x = np.einsum("nij,nj->ni", transfer[who + 1], back[who + 1])
        back[who] = x / x.max(1, keepdims=True)
    alpha = np.empty_like(e)
    a = front[order]
    top = int(size_s[0]) if len(size_s) else 0
    for t in range(top):
        m = active[t]
        x = (a[:m] @ moves) * e[lo_s[:m] + t]
        a = x / x.sum(1, keepdims=True)
        alpha[lo_s[:m] + t] = a
    b = back[order]  # weight of all that follows the word, for each language of the word
    for t in range(top - 1, -1, -1):
        m = active[t]
        at = lo_s[:m] + t
        x = alpha[at] * b[:m]
        emitted = e[at] * b[:m]
        alpha[at] = x / x.sum(1, keepdims=True)
        y = emitted @ moves.T
        b[:m] = y / y.max(1, keepdims=True)
    return alpha


def fit(sequences: list[list[str]], langs_of: list[str], seed: int = 7) -> Field:
    """Maximum likelihood by stochastic gradients over runs of words, each run in one language."""
    langs = sorted(set(langs_of))
    k = len(langs)
    rng = np.random.default_rng(seed)
    code = {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for words, lang in zip(sequences, langs_of):
        for w in words:
            counts.setdefault(w, np.zeros(k))[code[lang]] += 1
    telling = {w: c for w, c in counts.items() if c.sum() >= 5}
    lexicon = {w: i for i, w in enumerate(sorted(telling, key=lambda w: (-telling[w].sum(), w))[:LEXICON])}
    model = Field(langs, np.zeros((DIM, k), "float32"), np.log(np.full((k, k), 0.05) + np.eye(k) * (1 - 0.05 * k)), lexicon)
    if k < 2 or not sequences:
        return model
    vocab = {w: i for i, w in enumerate(counts)}
    rows, ends = word_features(pa.array(list(vocab), pa.large_string()), lexicon)
    begins = np.concatenate([[0], ends[:-1]])
    runs, marks = [], []
    picks = rng.integers(0, len(sequences), len(sequences))
    for i, (words, lang) in enumerate(zip(sequences, langs_of)):
        run, mark = [vocab[w] for w in words], [code[lang]] * len(words)
        if rng.random() < SWITCHED:
            j = int(picks[i])
            at, to = int(rng.integers(1, len(run) + 1)), int(rng.integers(0, len(sequences[j])))
            other = [vocab[w] for w in sequences[j][to:]]
            run, mark = run[:at] + other, mark[:at] + [code[langs_of[j]]] * len(other)
        runs.append(np.array(run))
        marks.append(np.array(mark))
    w, moves = model.weights.astype("float64"), model.moves.copy()
    gw2, gm2 = np.full(w.shape, 1e-6), np.full(moves.shape, 1e-6)
    for _ in range(EPOCHS):
        for lot in np.array_split(rng.permutation(len(runs)), max(1, len(runs) // BATCH)):
            words, truth = np.concatenate([runs[i] for i in lot]), np.concatenate([marks[i] for i in lot])
            stops = np.cumsum([len(runs[i]) for i in lot])
            uniq, place = np.unique(words, return_inverse=True)
            feats = np.concatenate([rows[begins[u] : ends[u]] for u in uniq])
            lens = ends[uniq] - begins[uniq]
            at = np.cumsum(lens) - lens
            score = np.add.reduceat(w[feats], at)[place]
            e = np.exp(score - score.max(1, keepdims=True)).astype("float32")
            marg = forward_backward(e, stops, np.exp(moves))
            delta = np.eye(k)[truth] - marg
            # Pairs of neighbours: expected counts from the marginals of a window of two with its surroundings.
            inner = np.ones(len(words), bool)
            inner[stops - 1] = False
            p = np.flatnonzero(inner)
            pair = _pair_marginals(e, stops, np.exp(moves))
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[p], truth[p + 1]), 1)
            gm = (seen - pair) / len(words)
            gm2 += gm**2
            moves += RATE * gm / np.sqrt(gm2)
            per_word = np.zeros((len(uniq), k))
            np.add.at(per_word, place, delta)
            touched, where = np.unique(feats, return_inverse=True)
            g = np.zeros((len(touched), k))
            np.add.at(g, where, np.repeat(per_word, lens, axis=0))
            g = g / len(lot) - DECAY * w[touched]
            gw2[touched] += g**2
            w[touched] += RATE * g / np.sqrt(gw2[touched])
    moves -= moves.max()
    return Field(langs, w.astype("float32"), moves, lexicon)


def _pair_marginals(e: np.ndarray, stops: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected number of each transition over short sequences."""
    k, total = moves.shape[0], np.zeros(moves.shape)
    starts = np.concatenate([[0], stops[:-1]])
    lens = stops - starts
    top = int(lens.max(initial=0))
    pad = np.ones((len(lens), top, k))
    keep = np.arange(top)[None, :] < lens[:, None]
    pad[keep] = e
    alpha, beta = np.zeros_like(pad), np.ones_like(pad)
    a = np.full((len(lens), k), 1 / k)
    for t in range(top):
        a = (a @ moves) * pad[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[:, t] = a
    for t in range(top - 2, -1, -1):
        b = (pad[:, t + 1] * beta[:, t + 1]) @ moves.T
        b /= b.max(1, keepdims=True)
        beta[:, t] = np.where(keep[:, t + 1][:, None], b, 1.0)
    for t in range(top - 1):
        x = alpha[:, t][:, :, None] * moves[None] * (pad[:, t + 1] * beta[:, t + 1])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        total += x[keep[:, t + 1]].sum(0)
    return total


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    order, least = [F.xxhash64("doc_id"), F.col("doc_id")], min(LEAST, sample)
    first = cut(rows.select("doc_id", "lang").orderBy(*order).limit(sample))
    enough = [r.lang for r in first.groupBy("lang").count().where(F.col("count") >= least).collect()]
    rare = rows.select("doc_id", "lang").where(~F.col("lang").isin(enough)).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    chosen = first.select(F.col("doc_id").alias("chosen")).union(rare.where(F.col("r") <= least).select(F.col("doc_id").alias("chosen"))).distinct()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                words = [w for w in clean(pa.array((text or "").split(), pa.large_string())).to_pylist() if w]
                places = range(0, len(words), max(RUN, len(words) // SEGMENTS))
                for at in list(places)[:SEGMENTS]:
                    langs.append(lang)
                    out.append(words[at : at + RUN])
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])

    got = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi").select("lang", "text").mapInArrow(runs, "lang string, words array<string>")
    # Binds only where ids repeat.
    got = got.withColumn("h", F.xxhash64("words", "lang")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    got = got.where(F.col("r") <= SEGMENTS * sample).orderBy("h", "lang").select("lang", "words").toArrow()
    return fit(got["words"].to_pylist(), got["lang"].to_pylist())


def predict(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches (neighbouring words labelled with different languages)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    told = docs.sparkSession.sparkContext.broadcast(model)  # DIM rows of weights, whatever the corpus

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                if not m.langs:
                    yield pa.record_batch([part["doc_id"], pa.array([UND] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, "int64")), pa.array(np.zeros(n, "int64"))], names=names)
                    continue
                dist, ends = m.label(part["text"])
                begins = np.concatenate([[0], ends[:-1]])
                count = ends - begins
                run = np.concatenate([np.zeros((1, len(m.langs))), np.cumsum(dist, 0, dtype="float64")])
                mean = (run[ends] - run[begins]) / np.maximum(count, 1)[:, None]
                best = mean.argmax(1)
                lang = np.where(count > 0, np.array(m.langs, object)[best], UND)
                p = np.where(count > 0, mean[np.arange(n), best], 0.0)
                tags = dist.argmax(1)
                change = np.concatenate([[0, 0], np.cumsum(tags[1:] != tags[:-1])]) if len(tags) else np.zeros(1, "int64")
                switches = np.where(count > 0, change[ends] - change[np.minimum(begins + 1, len(tags))], 0)
                yield pa.record_batch([part["doc_id"], pa.array(lang.tolist(), pa.string()), pa.array(np.clip(p, 0, 1)), pa.array(count), pa.array(switches.astype("int64"))], names=names)

    names = ["doc_id", "lang_pred", "score", "n_words", "n_switches"]
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    kinds = [rows.schema["doc_id"].dataType, StringType(), DoubleType(), LongType(), LongType()]
    return rows.mapInArrow(make, StructType([StructField(n, t) for n, t in zip(names, kinds)]))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and counts for every document."""
    out = predict(docs, train(docs, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
