"""Spans of texts: on the JVM and with their places, against the plain rule."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from shroud import queries as own
from shroud.functions import detect, text
from shroud.operators import scrub as scrubbing
from shroud.operators.dictionary import SPAN

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "-a-", "a.", "..", "a....b", "a-_b 가나@x.kr", "12.0 12.00", "x\ny\r\n", "é가é", "😀a😀b", "\x00a\x00", "ａ１", "_a__b_", "a" * 5000 + "." * 5000]


def odd_texts() -> list[str | None]:
    draw = random.Random(3)
    return [*ODD, None, *("".join(draw.choices("ab1가 .-_@+\té😀", k=draw.randrange(40))) for _ in range(300))]


def test_spans_on_the_jvm_equal_the_plain_rule(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.s for r in df.select("k", scrubbing.span_texts(F.col("text")).alias("s")).collect()}
    assert got == {k: None if t is None else re.findall(SPAN, t) for k, t in enumerate(texts)}


def test_places_equal_the_plain_rule_in_any_slices(monkeypatch):
    texts = odd_texts()
    want = [None if t is None else [{"start": m.start(), "stop": m.end(), "span": m[0]} for m in re.finditer(SPAN, t)] for t in texts]
    for n in (1, 7, 1000):
        monkeypatch.setattr(scrubbing, "SLICE", n)
        assert scrubbing.places_in(re.compile(SPAN), pa.array(texts, "string")).to_pylist() == want
    assert scrubbing.places_in(re.compile(SPAN), pa.array([], "string")).to_pylist() == []


def test_distinct_spans_need_no_python(spark, monkeypatch):
    """Places are not looked for where only the spans are needed, so no Python worker holds them."""

    def refused(*_):
        raise AssertionError("spans of a Python worker")

    monkeypatch.setattr(scrubbing, "occurrences", refused)
    assert own.QUERIES["scrub_dictionary"](spark, SF).count() > 0


def test_spans_are_replaced_alike_however_many_there_are(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b-c 가 a"), (2, ""), (3, None), (4, "nothing")], "k int, text string").withColumn("hits", F.lit(0))
    resolved = spark.createDataFrame([("a", "X_1", 1), ("b-c", "Y", 2)], "span string, replacement string, hits int")
    want = [(1, "X_1 Y 가 X_1", 4), (2, "", 0), (3, None, 0), (4, "nothing", 0)]
    for most in (scrubbing.SPANS, 0):
        monkeypatch.setattr(scrubbing, "SPANS", most)
        out = scrubbing.replace_spans(df, "text", ["k"], resolved)
        assert sorted((r.k, r.text, r.hits) for r in out.collect()) == want


def test_many_surfaces_are_replaced_as_each_in_turn(spark, monkeypatch):
    """Surfaces joined with texts, also those that only a replacement makes, against all of them in turn."""
    draw = random.Random(5)
    fixed = [("Customer#01", "P_1"), ("Customer#012", "P_2"), ("P_2 x", "y z"), ("y z", "##"), ("###", "o"), ("é", "e e"), ("e e", ""), ("b\n", "n"), ("漢字", "K"), ("a b", "漢"), ("$.*", "\\1")]
    words = ["".join(draw.choices("ab# 漢字", k=draw.randrange(2, 5))).strip() for _ in range(60)]
    into = dict([*fixed, *((w, draw.choice(["a", "b#", " ", "", "漢字", "Q"])) for w in words if w)])
    texts = ["Customer#012 x Customer#0123", "Customer#01#", "yé zé", "Customer#012 x#", "a b字", "$.*$.*", "", None, "none"]
    texts += ["".join(draw.choices("ab# 漢字é", k=draw.randrange(30))) for _ in range(300)]
    order = sorted(into, key=lambda w: (-len(w), w.encode()))
    want = [(k, *((None, 0) if t is None else scrubbing.replace_surfaces(t, order, [into[w] for w in order]))) for k, t in enumerate(texts)]
    known = spark.createDataFrame([(w, r, True, 1) for w, r in into.items()], "surface string, replacement string, multiword boolean, seq long")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    monkeypatch.setattr(scrubbing, "MULTIWORD", 3)
    monkeypatch.setattr(scrubbing, "_replace_all", None)  # a pass over all texts for every few surfaces
    out = scrubbing.multiword(df, "text", known)
    assert sorted((r.k, r.text, r.hits) for r in out.collect()) == want


def test_only_values_that_may_have_a_kind_go_to_python(spark):
    draw = random.Random(7)
    values = ["a@b.co", "010-1234-5678", "+1 (415) 555-0134", "02-123-4567", "123-45-6789", "4111 1111 1111 1111", "900101-1234567", "11-22-333333-44", "passport M12345678", "Customer#000012345", "000012", "agent 010-1234-5678"]
    values += ["".join(draw.choices("0123456789- .+()@a", k=draw.randrange(1, 18))).strip() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in set(values) if v], "v string")
    gated = {r.v: r.g for r in df.select("v", detect.may_have_kind(F.col("v")).alias("g")).collect()}
    assert all(gated[v] for v in gated if detect.kind_of(v))
    assert not any(gated[v] for v in ("Customer#000012345", "000012", "agent 010-1234-5678"))


def test_white_space_and_shapes_are_as_the_patterns_have_them(spark):
    """Trimming and shapes without a pattern for every value, against the patterns."""
    signs = [chr(i) for i in (*range(1, 0x300), 0x660, 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xAC00, 0xD7A3, 0xFEFF, 0xFF11)]
    values = ["", " ", *(f"{s}a{s}B{s}9{s}{s}" for s in signs), " 　\n12 가 \x85 ", "Customer#000012345 and more than that"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    old = F.substring("v", 1, text.SHAPE_LENGTH)
    for pattern, sign in ((r"\p{Nd}", "#"), ("[A-Z]", "A"), ("[a-z]", "a"), ("[가-힣]", "가"), (r"(?U)\s", " ")):
        old = F.regexp_replace(old, pattern, sign)
    old = F.concat(old, F.when(F.length("v") > text.SHAPE_LENGTH, F.lit("…")).otherwise(F.lit("")))
    rows = df.select("k", text.strip(F.col("v")).alias("s"), F.regexp_replace("v", r"(?U)^\s+|\s+$", "").alias("s0"), text.shape(F.col("v")).alias("h"), old.alias("h0")).collect()
    assert [(r.k, r.s, r.h) for r in rows if (r.s, r.h) != (r.s0, r.h0)] == []
