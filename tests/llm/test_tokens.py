"""Ids, files, packing and pieces against the libraries."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from shroud.llm.arrow_store import read_documents, sequence, write_tokens
from shroud.llm.common import scratch_dir
from shroud.llm.packing import SENTENCE, Cuts, best_cuts, cut_points, pack
from shroud.llm.queries import vocabulary
from shroud.llm.suffix_pieces import decode_documents, encode_documents, model, suffix_order
from shroud.llm.tokens import encoder


def library(name, end=None, special=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = not special  # the library's own default is False
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + ([end] if end is not None else []), "<u4")


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_word_encoder_equals_the_library(texts, name, drops):
    odd = ["", " ", "a  b", " a", "a ", "a\n\nb", "a \nb", "a\n b", "it's. I'll, they've", "<|endoftext|> x", "a\u0301 \u0301b", "1,234.50!!", "x\ty", "ﬁ ½", "\u2028line", "a\x1cb", "a\x85b"]
    all_texts = [*odd, *(t or "" for t in texts.values())]
    all_texts += ["a <|endoftext|> b", "a<|endoftext|>b c", "<|startoftext|><|ENDOFTEXT|>x", "<|endoftext|>"]
    for special in (False, True):
        exact = library(name, special=special)
        for _ in range(2):  # the second time from the table
            ids, ends = encoder(vocabulary(name), drops, special).encode(pa.array(all_texts))
            for t, got in zip(all_texts, np.split(ids, ends[:-1])):
                assert got.tolist() == exact(t).tolist(), repr(t[:40])


def test_arrow_store(spark, docs, texts, empty):
    folder = scratch_dir(spark)
    manifest = write_tokens(docs, folder, vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in read_documents(manifest).collect()}
    exact, start = library("word_bpe_49k.json", 2), 0
    stream = []
    for i, t in sorted(texts.items()):
        ids = exact(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        stream.append(ids)
    first = manifest.orderBy("part").first()
    ids, mask = sequence(first.seq_uri, 0)
    assert mask.all() and ids.tolist() == np.concatenate(stream)[:1024].tolist()
    assert ids.base is not None and mask.base is not None  # views, not copies
    assert not ids.flags.owndata and not mask.flags.owndata and mask.dtype == np.uint8
    assert read_documents(write_tokens(empty, scratch_dir(spark), vocabulary("word_bpe_49k.json"))).count() == 0


def test_masks_of_a_file_of_several_batches(spark, texts):
    long = " ".join(t for t in texts.values() if t) * 40
    docs = spark.createDataFrame([(1, long), (2, "a b"), (3, None)], "doc_id long, text string")
    file = write_tokens(docs.coalesce(1), scratch_dir(spark), vocabulary("word_bpe_49k.json")).collect()
    for f in file:
        rows = -(-f.n_tokens // 1024)
        got = [sequence(f.seq_uri, i) for i in range(rows)]
        assert [int(mask.sum()) for _, mask in got] == [1024] * (f.n_tokens // 1024) + [f.n_tokens % 1024] * (f.n_tokens % 1024 > 0)
        assert all(mask[: mask.sum()].all() and not ids[mask.sum() :].any() for ids, mask in got)
    assert any(f.n_tokens > 64 * 1024 for f in file)  # the partial mask joins those of earlier batches


def test_arrow_store_of_null_and_repeated_ids(spark, repeated):
    rows = list(read_documents(write_tokens(repeated, scratch_dir(spark), vocabulary("word_bpe_49k.json"))).collect())
    exact = library("word_bpe_49k.json", 2)
    want = sorted([(r.doc_id, len(ids := exact(r.text)), zlib.crc32(ids.tobytes())) for r in repeated.collect()], key=repr)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=repr) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):  # without gaps, null ids first, then ascending
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_stores_are_opened_by_the_names_that_spark_gives_them():
    from pyarrow import fs

    from shroud.llm.arrow_store import _open

    assert _open("file:///tmp/x")[1] == "/tmp/x"
    for scheme in ("s3a", "s3n", "s3"):
        try:
            store, path = _open(f"{scheme}://bucket/folder")
        except OSError:  # no network to tell the region
            continue
        assert isinstance(store, fs.S3FileSystem) and path == "bucket/folder"


def check_packing(rows, texts):
    exact = library("byte_bpe_50k.json", 0)
    by_sequence, done = {}, {}
    for r in rows:
        ids = exact(texts[r.doc_id])
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        by_sequence.setdefault(r.sequence_id, []).append(r)
        done.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in texts.items():
        at = 0
        for start, length in sorted(done[i]):
            assert start == at
            at += length
        assert at == len(exact(t))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return {k: sum(p.length for p in v) for k, v in by_sequence.items()}


def test_packing(docs, texts, empty, repeated):
    vocab = vocabulary("byte_bpe_50k.json")
    sizes = check_packing(pack(docs, vocab).collect(), texts)
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes.values())
    assert padding <= 0.03 * sum(sizes.values()) + 4 * 1024  # and what the ends of four ranges lack
    assert pack(empty, vocab).count() == 0
    assert pack(repeated, vocab).agg({"length": "sum"}).first()[0] > 2 * sum(sizes.values())
    ids = [r.doc_id for r in sorted(pack(repeated, vocab).collect(), key=lambda r: (r.sequence_id, r.offset))]
    assert ids[0] is None and [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)


def test_settled_cuts_are_the_optimum_of_the_whole():
    """However the places are dealt out, the cuts cost what one programme over all of them costs."""
    rng = np.random.default_rng(5)
    for _ in range(100):
        at = np.unique(np.concatenate([[0], rng.integers(1, 400, 60), np.arange(0, 400, 13)]))
        price = rng.choice([0.0, SENTENCE, 7.0], len(at))
        whole, part, cuts, i = Cuts(20, (4, 8, 16)), Cuts(20, (4, 8, 16)), [0], 1
        whole.add(at[1:], price[1:])
        while i < len(at):
            k = int(rng.integers(1, 15))
            part.add(at[i : i + k], price[i : i + k])
            i += k
            cuts += part.settled()[1:]
        cuts += part.finish()[1:]
        paid = dict(zip(at.tolist(), price.tolist()))
        assert abs(sum((0 if b - a in (4, 8, 16) else 20 - b + a) + paid[b] for a, b in zip(cuts, cuts[1:])) - whole.cost[-1]) < 1e-9
        assert cuts[-1] == at[-1] and max(np.diff(cuts)) <= 20


def test_only_sentences_longer_than_a_window_are_cut_inside():
    rng = np.random.default_rng(6)
    ends, spaces = np.zeros(10, bool), np.ones(10, bool)
    ends[1] = True
    ids = rng.choice([2, 3, 1], 3000, p=[0.499, 0.499, 0.002])
    ids[1000:2500] = 2
    at, price = cut_points(ids, np.array([3000]), (ends, spaces), longest=600, gap=50)
    said = [0, *[i for i in range(1, 3000) if ids[i - 1] == 1], 3000]
    for a, b in zip(said, said[1:]):
        inside = [p for p in at.tolist() if a < p < b]
        assert inside == (list(range(a + 50, b, 50)) if b - a > 600 else [])


def test_best_cuts_are_best():
    def cost(at, price, cuts, length, powers):
        return sum((0 if b - a in powers else length - (b - a)) + price[at.index(b)] for a, b in zip(cuts, cuts[1:]))

    rng = np.random.default_rng(3)
    for _ in range(30):
        at = np.unique(np.concatenate([[0], rng.integers(1, 60, 12)]))
        at = np.unique(np.concatenate([at, np.arange(0, at[-1], 9)]))
        price = rng.choice([0.0, SENTENCE, 7.0], len(at))
        length, powers = 20, (4, 8, 16)
        best = {0: 0.0}
        for i, b in enumerate(at[1:].tolist(), 1):
            best[b] = min(best[a] + (0 if b - a in powers else length - (b - a)) for a in at[:i].tolist() if b - a <= length) + price[i]
        cuts = best_cuts(at, price, length, powers)
        assert cuts[0] == 0 and cuts[-1] == at[-1]
        assert abs(cost(at.tolist(), price, cuts, length, powers) - best[int(at[-1])]) < 1e-9


def test_pieces_equal_the_library(spark, docs, texts, empty):
    path = vocabulary("piece_bpe_32k.model")
    m = model(path)
    odd = ["", "  ", " a  b ", "a▁b", "x" * 500, "日本語😀", "\t\n", "!!!!", "́ ½ ﬁ", "\U0010ffff end"]
    normal = m.normal(odd)
    flat, ends = m.encode(normal)
    for t, got in zip(odd, np.split(flat, ends[:-1])):
        assert got.tolist() == m.sp.encode(t), repr(t)
    encoded = encode_documents(docs, path)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: m.sp.encode(t or "") for i, t in texts.items()}
    back = {r.doc_id: r.text for r in decode_documents(encoded, path).collect()}
    assert back == {i: m.sp.decode(got[i]) for i in texts}
    assert encode_documents(empty, path).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(2)
    for top, depth in ((3, 5), (200, 7), (5000, 4), (2, 40)):
        codes = np.concatenate([rng.integers(0, top, 300), [0]])
        padded = np.concatenate([codes, np.zeros(depth, "int64")])
        keys = [tuple(padded[i : i + depth]) for i in range(len(codes))]
        order = suffix_order(codes, depth)
        assert [keys[i] for i in order] == sorted(keys)
