"""Models on held-out rows, and forward-backward against enumeration."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shroud.llm.language import CHUNK, fit as fit_field
from shroud.llm.language import forward_backward, identify
from shroud.llm.quality import classify, features, fit, keep_good

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 1").count()


def test_quality_odd_tables(spark, docs, empty, repeated, texts):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in texts] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert classify(docs, labels).count() == len(texts)
    assert classify(repeated, labels).count() == repeated.count()
    assert classify(empty, labels).count() == 0
    assert {r.score for r in classify(docs, labels.where("false")).collect()} == {0.5}
    assert {r.predicted for r in classify(docs, labels.where("quality = 1 and doc_id > 2")).collect()} == {1}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype("float64")
    model = fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_features_of_slices_are_the_same(texts):
    column = pa.array(list(texts.values()))
    whole = features(column)
    parts = np.concatenate([features(column.slice(i, 7)) for i in range(0, len(column), 7)])
    assert np.allclose(whole, parts) and np.isfinite(whole).all()


def enumerate_marginals(e, moves):
    k, n = moves.shape[0], len(e)
    total = np.zeros((n, k))
    for tags in itertools.product(range(k), repeat=n):
        p = (moves.sum(0) / k)[tags[0]] * e[0, tags[0]]
        for t in range(1, n):
            p *= moves[tags[t - 1], tags[t]] * e[t, tags[t]]
        for t, tag in enumerate(tags):
            total[t, tag] += p
    return total / total.sum(1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(4)
    moves = rng.random((3, 3)) + 0.1
    sizes = [4, 0, 1, 6]
    e = rng.random((sum(sizes), 3)).astype("float32") + 0.05
    ends = np.cumsum(sizes)
    got = forward_backward(e, ends, moves)
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
        if hi > lo:
            assert np.allclose(got[lo:hi], enumerate_marginals(e[lo:hi], moves), atol=1e-4)


def test_chunks_change_nothing():
    rng = np.random.default_rng(6)
    moves = rng.random((4, 4)) + 0.05
    n = 5 * CHUNK + 17
    e = rng.random((n, 4)).astype("float32") + 0.01
    got = forward_backward(e, np.array([n]), moves)
    a, b, alpha, beta = np.full(4, 0.25), np.ones(4), [], []
    for t in range(n):
        a = (a @ moves) * e[t]
        a = a / a.sum()
        alpha.append(a)
    for t in range(n - 1, -1, -1):
        beta.append(b)
        b = (e[t] * b) @ moves.T
        b = b / b.max()
    want = np.array(alpha) * np.array(beta[::-1])
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_words_of_a_mixed_text():
    a, b = "the and of to in is that with".split(), "der und die das nicht ist von mit".split()
    rng = np.random.default_rng(8)
    runs = [list(rng.choice(a, 12)) for _ in range(150)] + [list(rng.choice(b, 12)) for _ in range(150)]
    model = fit_field(runs, ["en"] * 150 + ["de"] * 150)
    dist, ends = model.label(pa.array([" ".join(a * 3 + b * 3), None, "123"]))
    tags = np.array(model.langs)[dist.argmax(1)]
    assert (tags[:22] == "en").all() and (tags[26:] == "de").all()
    assert ends.tolist() == [48, 48, 48]


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.95


def test_a_rare_language_is_learned_beside_frequent_ones(spark):
    rng = np.random.default_rng(4)
    words = {"aa": "anna abba alla arra", "bb": "bobo bubu bibi bebe", "cc": "xyxy zyzz xzyx zzxy"}
    rows = [(i, lang, " ".join(rng.choice(words[lang].split(), 30))) for i in range(1200) for lang in ["cc" if i % 100 == 7 else "ab"[i % 2] * 2]]
    got = identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 20).collect()
    said = {i: lang for i, lang, _ in rows}
    assert [r.doc_id for r in got if r.lang_pred != said[r.doc_id]] == []


def test_language_odd_tables(docs, empty, repeated, texts):
    got = {r.doc_id: r for r in identify(docs).collect()}
    for i in (4, 5, 6, 19):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1].lang_pred == "en" and got[20].lang_pred == "en"
    assert identify(empty).count() == 0
    assert identify(repeated).count() == repeated.count()
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_features(text):
    """The features of a text, byte by byte and word by word."""
    raw, words = (text or "").encode(), (text or "").split()
    kind = [0] * 11
    for i, x in enumerate(raw):
        c = chr(x)
        if i and raw[i - 1] == 0xC3 and 0x80 <= x <= 0x9E:
            kind[2] += 1
            continue
        named = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "*#$%&@^~=+<>{}[]\\_/", "!", "0123456789", ",;:", ".?", "|", "\n", "\t\x0b\x0c\r ")
        kind[next((k for k, chars in enumerate(named, 1) if c in chars), 0)] += 1
    b, w, letters = max(len(raw), 1), max(len(words), 1), max(kind[1] + kind[2], 1)
    sizes = [len(x.encode()) for x in words]
    return [
        np.log1p(len(raw)), kind[2] / letters, kind[3] / b, kind[4] / w, kind[5] / b, kind[6] / w, kind[7] / w, kind[8] / w, len(raw) / w,
        len(set(words)) / w, max([words.count(x) for x in set(words)], default=0) / w, sum(x == y for x, y in zip(words, words[1:])) / w, sum(s <= 3 for s in sizes) / w,
        len(words) / (kind[9] + 1), len(words) / (kind[7] + 1), sum(x >= 128 for x in raw) / b, sum(x[-1] in "*#$%&!|" for x in words) / w, sum(s > 20 for s in sizes) / w,
    ]


def test_features_equal_a_plain_count(texts, monkeypatch):
    from shroud.llm import quality

    said = [t for t in texts.values() if t is None or (len(t) < 5000 and not set(t) & {"\u00a0", "\u2003"})] + ["É à ÀÉ Ü.", "AB!! 12|3 * x*", "Ö" * 30]
    want = np.array([plain_features(t) for t in said])
    for chunk in (quality.CHUNK, 7):  # a chunk's border may part a letter's bytes
        monkeypatch.setattr(quality, "CHUNK", chunk)
        got = quality.features(pa.array(said, pa.string()))
        assert np.allclose(got, want), np.argwhere(~np.isclose(got, want))


def test_tables_score_as_sums_and_trees_split_best():
    from shroud.llm import quality

    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y)
    for row, s in zip(x, model.score(x)):
        total = model.base + sum(t[sum(v >= c for c in e)] for v, e, t in zip(row, model.edges, model.tables))
        total += sum(t[sum(row[i] >= c for c in ei), sum(row[j] >= c for c in ej)] for i, j, ei, ej, t in model.pairs)
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95  # an exclusive or needs the pairs
    for _ in range(30):
        g, h = rng.normal(size=8), rng.random(8)
        gain = lambda lo, hi: g[lo:hi].sum() ** 2 / (h[lo:hi].sum() + quality.RIDGE)
        best = max(range(1, 8), key=lambda m: gain(0, m) + gain(m, 8))
        table = quality._tree(g, h, 2)
        if gain(0, best) + gain(best, 8) > gain(0, 8) + 1e-9:
            assert np.allclose(table[:best], g[:best].sum() / (h[:best].sum() + quality.RIDGE)) and np.allclose(table[best:], g[best:].sum() / (h[best:].sum() + quality.RIDGE))
