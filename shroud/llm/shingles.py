"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_WEIGHTS = _MIX  # odd, one for each place in a shingle


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def lower_words(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space, A-Z lower-cased; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", "uint8")[at[0] : at[-1]].copy()
    raw[(raw >= 65) & (raw <= 90)] += 32  # bytes of other characters are 128 or more
    lowered = pa.LargeStringArray.from_buffers(n, pa.py_buffer((at - at[0]).astype("int64")), pa.py_buffer(raw))
    return pc.ascii_split_whitespace(lowered)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of all its words where it has fewer."""
    words = lower_words(texts)
    ends = np.asarray(words.offsets)[1:] - np.asarray(words.offsets)[0]
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    blank = np.array([not w for w in distinct], bool)
    if blank.any():  # a text of white space alone
        keep = ~blank[codes]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    seen = mix(np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], "uint64"))
    h = seen[codes] if len(codes) else np.zeros(0, "uint64")
    runs = np.zeros(max(len(h) - k + 1, 0), "uint64")
    for i in range(k):
        runs += h[i : i + len(runs)] * _WEIGHTS[i]
    runs = mix(runs)
    out = []
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        n = hi - lo
        if n >= k:
            out.append(np.unique(runs[lo : hi - k + 1]))
        elif n:
            short = np.full(1, n, "uint64")
            for i in range(n):
                short += h[lo + i : lo + i + 1] * _WEIGHTS[i]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, "uint64"))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
