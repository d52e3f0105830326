import difflib
import hashlib
import os

import numpy as np

from shroud.llm.fingerprints import Prefix, common_extension, fingerprint, fingerprint_documents, likeness, span_equal


def test_spans_and_extensions():
    rng = np.random.default_rng(1)
    a, b = ("".join(rng.choice(list("ab"), 300)) for _ in range(2))
    b = b[:40] + a[100:200] + b[40:]
    x, y = Prefix(a), Prefix(b)
    for _ in range(300):
        i, j = int(rng.integers(0, len(a))), int(rng.integers(0, len(b)))
        n = int(rng.integers(0, min(len(a) - i, len(b) - j) + 1))
        assert span_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        assert common_extension(x, i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))


def test_fingerprint_of_a_concatenation():
    a, b = Prefix("häßlich " * 30), Prefix("other text 😀 " * 20)
    for kept, taken in ((0, 0), (0, 5), (10, 0), (100, 70), (240, 260)):
        assert fingerprint(a, kept, b, taken) == fingerprint(Prefix(a.text[:kept] + b.text[:taken]))


def test_likeness():
    text = "".join(chr(97 + i * i % 26) for i in range(1000))
    f = fingerprint(Prefix(text))
    assert likeness(f, f) == 1
    assert 0.9 < likeness(f, fingerprint(Prefix(text[:500] + "#" + text[501:]))) < 1
    assert 0.9 < likeness(f, fingerprint(Prefix(text[:500] + "###" + text[500:]))) < 1
    assert likeness(f, fingerprint(Prefix(text[::-1] + "!"))) < 0.1
    assert likeness(fingerprint(Prefix("")), f) == 0 and likeness(fingerprint(Prefix("")), fingerprint(Prefix(""))) == 1


def test_likeness_of_near_copies_with_scattered_edits():
    """Against the blocks that a full comparison finds: each edit costs a few spans, never what lies between two edits."""
    rng = np.random.default_rng(3)
    said = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10))) for _ in range(n)]
    for edits in (2, 3, 5, 8):
        words = said(700)
        text = " ".join(words)
        for place in np.linspace(10, 680, edits).astype(int).tolist():
            words[place] = ("", "other", words[place] + " and more")[int(rng.integers(3))]
        edited = " ".join(words)
        f, g = fingerprint(Prefix(text)), fingerprint(Prefix(edited))
        longest = max(len(text), len(edited))
        equal = sum(b.size for b in difflib.SequenceMatcher(None, text, edited, False).get_matching_blocks()) / longest
        assert equal - 250 * edits / longest <= likeness(f, g) <= equal + 0.01
        assert likeness(f, g) == likeness(g, f)
    assert likeness(f, fingerprint(Prefix(" ".join(said(700))))) < 0.05


def test_documents(docs, texts, empty, repeated):
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    order = sorted(texts, reverse=True)
    seen = {}
    for i, j in zip(order, order[1:] + order[:1]):
        t, u, r = texts[i] or "", texts[j] or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint(Prefix(t)) and r.edited_fingerprint == fingerprint(Prefix(edited))
        assert (r.near_edited, r.near_next) == (likeness(r.fingerprint, r.edited_fingerprint), likeness(r.fingerprint, fingerprint(Prefix(u))))
        assert r.same_start_next == len(os.path.commonprefix([t, u]))
        assert seen.setdefault(r.fingerprint, t) == t
    assert fingerprint_documents(empty).count() == 0
    assert fingerprint_documents(repeated).count() == repeated.count()
    one = fingerprint_documents(docs.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_hot_ids_are_dealt_by_their_texts(spark):
    """A third of the rows without an id, a third with one id: same results as in one range, and several ranges for each."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * (i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint_documents(df).collect()
    assert len(got) == 600
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashes[r[1]]), reverse=True)
    want = sorted(((i, len(t), len(os.path.commonprefix([t, u]))) for (i, t), (_, u) in zip(order, order[1:] + order[:1])), key=repr)
    assert sorted(((r.doc_id, r.n_chars, r.same_start_next) for r in got), key=repr) == want
