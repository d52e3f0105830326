"""Token ids of whole texts by the tokenizers library, with every distinct word encoded once a worker.

Both vocabularies split a text at white space before they merge, so the ids of a text are the ids of its words in
a row. A batch is split by Arrow, its distinct words are looked up in a table that the worker keeps, missing words
go through the library, and the ids are gathered by numpy. Texts whose white space is not regular (for the
byte-level vocabulary, where white space has ids of its own) are encoded whole by the library.

A special token's string in a text is ordinary text, as the description beside the vocabulary files has it
(``encode_special_tokens = True``), so that no document can forge an end of text; with ``special=True`` it becomes the special id, as the library does when
nothing is set. Texts that hold such a string are then encoded whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that the table of a worker holds at most; further words are encoded each time.
TABLE_WORDS = 700_000
SLICE, BYTES = 4000, 8 << 20  # texts and bytes of text that are encoded at a time
#: White space at an end, or two white-space characters in a row.
_ODD = r"^[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]{2}|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]$"
_encoders: dict[tuple[str, bool, bool], "WordEncoder"] = {}


def encoder(path: str, drops_space: bool, special: bool = False) -> "WordEncoder":
    """The worker's encoder for a vocabulary file; ``drops_space``: white space has no ids."""
    key = path, drops_space, special
    if key not in _encoders:
        _encoders.clear()  # a worker holds one table of words
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


class WordTable:
    """Ids of the distinct words that a worker has met, as Arrow strings and flat arrays."""

    def __init__(self, encode_words):
        self.encode_words = encode_words  # a list of words to their ids in a row and where each word's end
        self.known = pa.array([], pa.large_string())
        self.flat, self.ends = np.zeros(0, "uint32"), np.zeros(0, "int64")

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a table, and where each word's begin and end in it."""
        at = pc.index_in(words, value_set=self.known)
        lacks = pc.is_null(at)
        rows = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype("int64")
        lacking = np.flatnonzero(lacks.to_numpy(zero_copy_only=False))
        flat, ends = self.flat, self.ends
        if len(lacking):
            new = words.take(pa.array(lacking))
            ids, stops = self.encode_words(new.to_pylist())
            rows[lacking] = len(ends) + np.arange(len(lacking))
            if room := min(TABLE_WORDS - len(ends), len(lacking)):
                self.known = pa.concat_arrays([self.known, new[:room]])
                self.flat, self.ends = np.concatenate([flat, ids[: stops[room - 1]]]), np.concatenate([ends, stops[:room] + len(flat)])
            ends = np.concatenate([ends, stops + len(flat)])
            flat = np.concatenate([flat, ids])
        return flat, np.concatenate([[0], ends])[rows], ends[rows] if len(ends) else rows

    def gather(self, words: pa.Array, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose words are ``words[codes]``, up to ``ends`` for each text."""
        flat, starts, stops = self.look_up(words)
        total = np.concatenate([[0], np.cumsum((stops - starts)[codes])]) if len(codes) else np.zeros(1, "int64")
        shift = starts[codes] - total[:-1]
        return flat[np.arange(total[-1]) + np.repeat(shift, np.diff(total))], total[ends]


def release_unused() -> None:
    """Give back what Arrow holds for later batches, at the end of a task: an idle worker stays in its executor's memory."""
    pa.default_memory_pool().release_unused()


def with_whole(odd: np.ndarray, ids: np.ndarray, ends: np.ndarray, whole: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts the ids of the texts marked ``odd``, encoded by themselves, into their places."""
    parts = iter(np.split(whole, stops[:-1]))
    pieces = [next(parts) if o else ids[lo:hi] for o, lo, hi in zip(odd, np.concatenate([[0], ends[:-1]]), ends)]
    return np.concatenate(pieces), np.cumsum([len(p) for p in pieces])


class WordEncoder:
    def __init__(self, path: str, drops_space: bool, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.whole = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.drops_space = drops_space
        self.table = WordTable(self._library)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end."""
        flat, ends = array("I"), []
        for lo in range(0, len(texts), 20_000):
            for e in self.library.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False):
                flat.extend(e.ids)
                ends.append(len(flat))
        return np.frombuffer(flat, "uint32") if len(flat) else np.zeros(0, "uint32"), np.array(ends, "int64")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and, for each text, where its ids end. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd = np.zeros(n, bool) if self.drops_space else pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for token in self.whole:
            odd = odd | pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        if self.drops_space:
            words = pc.ascii_split_whitespace(plain)
        else:
            # A word takes the one space before it; a line feed starts a word of its own that takes none.
            words = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        ends = np.asarray(words.offsets)[1:] - np.asarray(words.offsets)[0]
        distinct = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if not self.drops_space and len(codes):
            begins = np.concatenate([[0], ends[:-1]])
            begins = begins[begins < ends]  # the first word of a text has no space before it
            at_start, place = np.unique(codes[begins], return_inverse=True)
            codes = codes.copy()
            codes[begins] = len(distinct) + place
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), distinct, pa.scalar("", pa.large_string()))
            distinct = pa.concat_arrays([pc.if_else(pc.starts_with(distinct, "\n"), distinct, spaced), distinct.take(pa.array(at_start))])
        ids, total = self.table.gather(distinct, codes, ends)
        if not odd.any():
            return ids, total
        return with_whole(odd, ids, total, *self._library([texts[int(i)].as_py() for i in np.flatnonzero(odd)]))
