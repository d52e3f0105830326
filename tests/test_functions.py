"""Detectors, generalisation and text functions: values on the driver, and the same as columns."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shroud.functions import content, detect, text
from shroud.functions.generalize import REDACTED, SUPPORTED, GeneralizeError, generalize, generalize_value
from shroud.operators.dictionary import allocate, number
from shroud.operators.scrub import splice, tokens_in

FOUND = [
    ("900101-1234567", [("RRN", "9001011234567")]), ("9001011234567.", [("RRN", "9001011234567")]), ("901301-1234567", []), ("900132-1234567", []), ("900101-9234567", []),
    ("900101 - 5234567", [("RRN", "9001015234567")]), ("x900101-1234567", []), ("010-1234-5678", [("PHONE", "01012345678")]), ("01012345678", [("PHONE", "01012345678")]),
    ("+82 10-1234-5678", [("PHONE", "01012345678")]), ("02-123-4567", [("PHONE", "021234567")]), ("031) 123-4567", [("PHONE", "0311234567")]), ("0212345678", []),
    ("(212) 555-0123", [("PHONE", "2125550123")]), ("+1 212-555-0123", [("PHONE", "2125550123")]), ("112-555-0123", []), ("4111 1111 1111 1111", [("CARD", "4111111111111111")]),
    ("4111-1111-1111-1112", []), ("0000 0000 0000 0000", []), ("4222222222222", [("CARD", "4222222222222")]), ("A.B+c@Example.COM", [("EMAIL", "a.b+c@example.com")]),
    ("a@b", []), ("a@b.c", []), ("078-05-1120", [("SSN", "078051120")]), ("000-12-3456", []), ("666-12-3456", []), ("900-12-3456", []), ("123-00-4567", []), ("123-45-0000", []),
    ("11-22-333333-44", [("DRIVER", "112233333344")]), ("29-22-333333-44", []), ("M12345678", []), ("passport: m12345678", [("PASSPORT", "M12345678")]),
    ("여권번호 M123A4567", [("PASSPORT", "M123A4567")]), ("110-123-456789", []), ("계좌 110-123-456789", [("ACCOUNT", "110123456789")]), ("acct no. 12-34-56-7", [("ACCOUNT", "1234567")]),
    ("홍길동010-1234-5678", []), ("010-1234-5678입니다", []), ("a@b.co, 010-1111-2222 and 078-05-1120", [("EMAIL", "a@b.co"), ("PHONE", "01011112222"), ("SSN", "078051120")]),
]


@pytest.mark.parametrize("value,want", FOUND)
def test_find(value, want):
    assert [(f.kind, f.norm) for f in detect.find(value)] == want


def test_context_wins_over_other_detectors():
    (found,) = detect.find("account 4111-1111-1111-111")
    assert found.kind == "ACCOUNT"


def test_kind_and_norm_of_values():
    assert detect.kind_of(" 010-1234-5678 ") == "PHONE"
    assert detect.kind_of("call 010-1234-5678") is None
    assert detect.norm_of("PHONE", "call 010-1234-5678") == "01012345678"
    assert detect.norm_of("PHONE", " unknown ") == "unknown" and detect.norm_of(None, " 010-1234-5678") == "010-1234-5678"


def test_native_extraction_agrees_with_find_where_one_kind_stands_alone(spark):
    df = spark.createDataFrame([(v,) for v, _ in FOUND], "t string")
    for kind in detect.MANDATORY:
        got = df.select("t", F.explode(detect.extract(F.col("t"), *detect.places(kind))).alias("v")).select("t", detect.norm_column(kind, F.col("v")).alias("n"))
        want = sorted((v, n) for v, found in FOUND for k, n in found if k == kind)
        if kind not in ("SSN", "PHONE"):
            assert sorted(map(tuple, got.collect())) == want, kind
        else:
            assert set(want) <= set(map(tuple, got.collect())), kind


GENERAL = [
    ("birthdate", "1985-03-02", "1985"), ("birthdate", "85-03-02", REDACTED), ("birthdate", " 19850302", "1985"), ("date", "2024-3-9", "2024-03"), ("date", "20240309", "2024-03"),
    ("date", "2024", REDACTED), ("date", "2024-13", "2024-13"), ("address", "서울시 강남구 새길로 1", "서울시 강남구"), ("address", "경기도 수원시 영통구 길 1", "경기도 수원시 영통구"),
    ("address", "경기도 가평군 북면 1", "경기도 가평군"), ("address", "강원도 산길 3", "강원도"), ("address", "12 Main St, Springfield, IL 62704", "Springfield, IL"), ("address", "somewhere", REDACTED),
    ("zip", "06212", "062**"), ("zip", "123", REDACTED), ("age", "34", "30-34"), ("age", "34.9", "30-34"), ("age", "-1", REDACTED), ("age", "-0.5", "0-4"), ("age", "nan", REDACTED),
    ("age", "inf", REDACTED), ("age", "x", REDACTED), ("age", "", REDACTED), ("zip", " ", REDACTED),
]


def test_generalize(spark):
    for kind, value, want in GENERAL:
        assert generalize_value(kind, value) == want, (kind, value)
    for kind in SUPPORTED:
        rows = [(v, w) for k, v, w in GENERAL if k == kind] + [(None, None)]
        df = spark.createDataFrame(rows, "v string, w string").select("v", "w", generalize(kind, F.col("v")).alias("g"))
        assert [(r.v, r.g) for r in df.collect()] == rows
    with pytest.raises(GeneralizeError, match="supported: birthdate"):
        generalize("name", F.lit("x"))


def test_shapes_names_dates_and_masks(spark):
    values = ["P-100101", "홍길동 A1", "a" * 30, "x\ty", "２０２４", "김하늘", "김", "김하명", "가나다", "남궁하늘별", "2024-02-31", "20241301", "2024/3/9 10:00", "12345", "1234", "ab", "가나"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    rows = df.select("v", text.shape(v).alias("s"), text.name_like(v).alias("n"), text.is_date(v).alias("d"), text.maskable(v, F.lit("name")).alias("m"), text.maskable(v, F.lit(None).cast("string")).alias("o")).collect()
    for r in rows:
        assert r.s == text.shape_of(r.v) and r.n == text.name_like_value(r.v)
        assert r.m == text.maskable_value(r.v, "name") and r.o == text.maskable_value(r.v, None)
    assert {r.v for r in rows if r.n} == {"김하늘"}
    assert {r.v for r in rows if r.d} == {"2024-02-31", "2024/3/9 10:00"}
    assert {r.v: r.s for r in rows}["a" * 30] == "a" * 24 + "…"


def test_entity_names():
    assert [text.entity_name(n) for n in ("patient_no", "Dx Code", "2nd name", "성명", "--")] == ["PATIENT_NO", "DX_CODE", "C_2ND_NAME", "ID", "ID"]


def test_paths_and_dialogs(spark):
    paths = ["a/../b//c.csv", "/../x/./y", "..\\..\\z", "a/b/../../..", "/", "", "../a/../../b"]
    assert [content.normalize_path(p) for p in paths] == ["b/c.csv", "/x/y", "../../z", "..", "/", "", "../../b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(content.normalize_path_column(F.col("p")).alias("n"))
    assert [r.n for r in df.collect()] == [content.normalize_path(p) for p in paths]
    assert content.touches_state("cat .shroud/state/x") and content.touches_state("cat a/../.shroud/out/../state/x") and not content.touches_state("cat .shroud/out/a.csv")
    assert content.is_generated_path("x/.shroud/cards/a.md") and not content.is_generated_path(".shroud/out/../state/x")
    command = "python x.py 'my data.csv' b.tsv --in=c.jsonl; cat b.tsv > d.CSV.bak"
    assert content.data_paths_in(command) == ["my data.csv", "b.tsv", "c.jsonl"]
    got = spark.createDataFrame([(command,)], "c string").select(content.data_paths_column(F.col("c")).alias("p")).first().p
    assert got == content.data_paths_in(command)
    assert content.for_dialog("a\nb\u2028c" + "d" * 50, 8) == '"a b cddd…"'
    got = spark.createDataFrame([("a\nb\u2028c" + "d" * 50,), ('q"',)], "c string").select(content.for_dialog_column(F.col("c"), 8).alias("p")).collect()
    assert [r.p for r in got] == ['"a b cddd…"', '"q\\""']


def test_blocks(spark):
    blocks = [
        {"type": "text", "text": "one"}, {"type": "image", "data": "x"}, {"type": "tool_result", "content": "two"},
        {"type": "tool_result", "content": [{"type": "text", "text": "three"}, {"type": "image"}, {"type": "text", "text": "four"}]}, {"type": "text", "text": "five"},
    ]
    texts = content.texts_of(blocks)
    assert texts == ["one", "two", "three", "four", "five"]
    changed = content.with_texts(blocks, [t.upper() for t in texts])
    assert content.texts_of(changed) == [t.upper() for t in texts] and changed[1] == blocks[1]
    assert content.texts_of("x") == ["x"] and content.with_texts("x", ["y"]) == "y"
    row = [("text", "one", None, None), ("image", None, None, None), ("tool_result", None, "two", None), ("tool_result", None, None, [("text", "three"), ("image", None), ("text", "four")]), ("text", "five", None, None)]
    df = spark.createDataFrame([(row,)], f"b {content.BLOCKS}")
    got = df.select(content.texts_of_column(F.col("b")).alias("t"))
    assert got.first().t == texts
    new = df.select(content.with_texts_column(F.col("b"), F.transform(content.texts_of_column(F.col("b")), F.upper)).alias("b"))
    assert new.select(content.texts_of_column(F.col("b")).alias("t")).first().t == [t.upper() for t in texts]


def test_splice_and_tokens(spark):
    df = spark.createDataFrame([("한글 abc def", [(7, 10, "X"), (0, 2, "YY")]), ("z", [])], "t string, e array<struct<start:int,stop:int,text:string>>")
    assert [r.s for r in df.select(splice(F.col("t"), F.col("e")).alias("s")).collect()] == ["YY abc X", "z"]
    got = spark.createDataFrame([("NAME_000001이 A_B_1234567 xNAME_000002 NAME_000001",)], "t string").select(tokens_in(F.col("t")).alias("k")).first().k
    assert got == ["NAME_000001", "A_B_1234567"]


def test_allocation_is_the_same_however_it_is_spread(spark, monkeypatch):
    import shroud.operators.dictionary as d

    rows = [("P" if i % 3 else "Q", f"n{i * 7 % 1000}", f"raw{i}", i) for i in range(3000)]
    empty = spark.createDataFrame([], d.MAPPING)
    keys = spark.createDataFrame(rows, "entity string, norm string, raw string, seen long")
    one = sorted(map(tuple, allocate(keys, empty).collect()))
    monkeypatch.setattr(d, "WINDOW_KEYS", 100)
    for n in (1, 4, 16):
        assert sorted(map(tuple, allocate(keys.repartition(n), empty).collect())) == one
    known = spark.createDataFrame([("P", "n7", "r", "P_000009", 9)], d.MAPPING)
    fresh = allocate(keys, known)
    assert fresh.where("entity = 'P' and norm = 'n7'").isEmpty() and fresh.where("entity = 'P'").agg(F.min("n")).first()[0] == 10
    assert number(keys, [], "seen", "k").where("k <> seen + 1").isEmpty()


def test_sql_functions(spark):
    from shroud.session import register

    register(spark)
    row = spark.sql("select pii_kind('010-1234-5678') as k, generalize_zip('06212') as z, value_shape('A-1') as s, size(pii_matches('a@b.co 010-1234-5678')) as n").first()
    assert tuple(row) == ("PHONE", "062**", "A-#", 2)
    assert [r.kind for r in spark.sql("select * from pii_rows('a@b.co 010-1234-5678')").collect()] == ["EMAIL", "PHONE"]
    assert detect.kinds_of(pd.Series([None, "a@b.co"])).tolist()[1] == "EMAIL"


def test_find_equals_a_look_at_all_matches_before():
    """Against the plain rule: detectors in order, from left to right, what overlaps something found is dropped."""
    import random
    import time

    from shroud.functions import detect

    def plain(text):
        out = []
        for d in detect.DETECTORS:
            for m in d.pattern.finditer(text):
                start, end = m.span(1)
                if detect._passes(d.kind, m[1]) and all(end <= f.start or f.end <= start for f in out):
                    out.append(detect.Found(d.kind, start, end, m[1], detect.normal(d.kind, m[1])))
        return sorted(out, key=lambda f: f.start)

    rng = random.Random(3)
    parts = ["a@b.co", "010-1234-5678", "(212) 555-0134", "4111 1111 1111 1111", "900101-1234567", "123-45-6789", "11-22-333333-44", "passport M12345678", "계좌 110-234-567890", "x", "-", " ", " ", "\n"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert detect.find(text) == plain(text), text
    many, began = "a@b.co " * 20_000, time.time()
    assert len(detect.find(many)) == 20_000 and time.time() - began < 5
