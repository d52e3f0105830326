import random

import pytest

LONG = 20_000


def prose(rng, words: int) -> str:
    vocabulary = [a + b for a in ("ta", "ro", "mi", "len", "so", "ka", "du", "ve") for b in ("ra", "no", "sti", "lu", "mer", "po", "x", "gan")]
    out, at = [], 0
    while at < words:
        n = min(rng.randint(3, 14), words - at)
        out.append(" ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + ".")
        at += n
    return "".join(s + rng.choice((" ", " ", "\n")) for s in out).strip()


def odd_texts() -> dict:
    """Texts by id with everything that tables may hold: null, empty, blank, one word, copies, near copies, very long."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    words = base.split(" ")
    docs = {
        1: base, 2: base, 3: base.replace(" ", "  "), 4: None, 5: "", 6: "   ", 7: "one", 8: "one two three", 9: "One two  three", 10: "a b c d e", 11: "a b c d e f",
        12: " ".join([*words[:50], "changed", *words[51:]]), 13: " ".join([*words[:-1], "otherwise."]), 14: " ".join(words[: len(words) // 2]),
        15: prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30), 16: prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 20), 17: passage, 18: "x" * 3000, 19: "!!! ??? ...", 20: "日本語 の テスト😀 ñ é",
        21: prose(rng, LONG), 22: "\t tab\nline \r\n end ", 23: "a\u00a0b c\u2003d", 24: "null\0byte here", 25: "one two three",
    }
    docs |= {i: prose(rng, rng.randint(5, 150)) for i in range(26, 60)}
    docs |= {60 + i: docs[26 + i] for i in range(5)}
    return docs


@pytest.fixture(scope="session")
def texts():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "clash") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, h string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def repeated(docs):
    """Every row twice, and rows without an id."""
    from pyspark.sql import functions as F

    return docs.unionByName(docs).unionByName(docs.where("doc_id in (1, 5, 30)").withColumn("doc_id", F.lit(None).cast("long")))
