"""A replayed stream gives what the batch gives, and nothing unscrubbed passes when scrubbing fails."""

from pyspark.sql import functions as F

from shroud.operators.dictionary import State
from shroud.operators.scrub import scrub
from shroud.streaming import scrub as streaming

ROWS = [(1, "prompt", "mail a@b.co"), (2, "tool", "again A@B.CO and 010-1234-5678"), (3, "response", "a@b.co"), (4, "tool", "  "), (5, "tool", "nothing")]
SCHEMA = "k long, door string, text string"


def state_of(spark, path):
    return State(spark, f"file://{path}")


def test_stream_equals_batch(spark, tmp_path):
    for i, row in enumerate(ROWS):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state = state_of(spark, tmp_path / "state")
    q = streaming.scrub_stream(stream, "text", ["k"], state, streaming.parquet_sink(f"{tmp_path}/out"), f"{tmp_path}/check", door="door")
    q.awaitTermination(300)
    got = {r.k: (r.hits, r.withheld) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (0, False), 4: (0, False), 5: (0, False)}
    texts = {r.k: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert texts[3] == "a@b.co" and "EMAIL_000001" in texts[1] and texts[2].startswith("again EMAIL_000001")
    batch = scrub(spark.createDataFrame([r for r in ROWS if r[1] != "response"], SCHEMA), "text", ["k"], state_of(spark, tmp_path / "other"))
    assert {r.k: r.text for r in batch.collect()} == {k: t for k, t in texts.items() if k != 3}


def test_fails_closed(spark, tmp_path, monkeypatch):
    df, state = spark.createDataFrame(ROWS, SCHEMA), state_of(spark, tmp_path / "s")

    def broken(*a, **k):
        raise OSError("no state")

    monkeypatch.setattr(streaming, "scrub", broken)
    got = {r.k: (r.text, r.withheld) for r in streaming.scrub_batch(df, "text", ["k"], state, door="door").collect()}
    assert got[1] == (streaming.WITHHELD, True) and got[2][1] and got[3] == ("a@b.co", False) and got[4] == ("  ", False)
    down = {r.k: r.withheld for r in streaming.scrub_batch(df, "text", ["k"], state, door="door", ready=False).collect()}
    assert down == {1: False, 2: True, 3: False, 4: False, 5: True}
    safe = df.withColumn("kind", F.lit("skill_listing"))
    assert streaming.scrub_batch(safe, "text", ["k"], state, attachment="kind").where("withheld").isEmpty()


def test_streams_know_attachments_and_whether_the_engine_works(spark, tmp_path):
    rows = [(*r, "skill_listing" if r[0] == 2 else None) for r in ROWS]
    for up in (True, False):
        spark.createDataFrame(rows, SCHEMA + ", kind string").coalesce(1).write.parquet(f"{tmp_path}/in{up}/0")
        stream = spark.readStream.schema(SCHEMA + ", kind string").parquet(f"{tmp_path}/in{up}/*")
        q = streaming.scrub_stream(stream, "text", ["k"], state_of(spark, tmp_path / f"s{up}"), streaming.parquet_sink(f"{tmp_path}/out{up}"), f"{tmp_path}/c{up}", "door", True, "kind", lambda: up)
        q.awaitTermination(300)
        got = {r.k: (r.hits, r.withheld) for r in spark.read.parquet(f"{tmp_path}/out{up}").collect()}
        assert got == {1: (int(up), False), 2: (0, False), 3: (0, False), 4: (0, False), 5: (0, not up)}


def test_multiword_surfaces_in_turns(spark, monkeypatch):
    import random

    from shroud.operators import scrub as scrubbing

    rng = random.Random(2)
    surfaces = sorted({" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(2, 4))) for _ in range(90)}, key=lambda s: (-len(s), s))
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(30)) for _ in range(20)]
    known = spark.createDataFrame([(s, f"<{i}>", True, 1) for i, s in enumerate(surfaces)], "surface string, replacement string, multiword boolean, seq long")
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = [scrubbing.replace_surfaces(t, surfaces, [f"<{i}>" for i in range(len(surfaces))]) for t in texts]
    for most in (1000, 7):
        monkeypatch.setattr(scrubbing, "MULTIWORD", most)
        assert [(r.t, r.hits) for r in scrubbing.multiword(df, "t", known).orderBy("k").collect()] == want


def test_multiword_surfaces_longest_first(spark, tmp_path):
    state = state_of(spark, tmp_path / "m")
    rows = [("f", "c", "Main Street 5", "[A]", 1), ("f", "c", "Main Street 5, Springfield", "[B]", 2), ("f", "c", "xy", "[C]", 3), ("f", "d", "xy", "[D]", 4), ("f", "c", "12", "N_000001", 5)]
    state.add_lookups(spark.createDataFrame(rows, "file_id string, column string, surface string, replacement string, place long"))
    df = spark.createDataFrame([(1, "at Main Street 5, Springfield or Main Street 5"), (2, "xy 12.0 xyz 12.5"), (3, None)], "k long, t string")
    got = {r.k: (r.t, r.hits) for r in scrub(df, "t", ["k"], state).collect()}
    assert got == {1: ("at [B] or [A]", 2), 2: ("[C] N_000001 xyz 12.5", 2), 3: (None, 0)}
    state.commit(forget=[("f", "c")])
    assert {r.t for r in scrub(df.where("k = 2"), "t", ["k"], state).collect()} == {"[D] 12.0 xyz 12.5"}
    state.add_lookups(spark.createDataFrame([("f", "c", "xy", "[E]", 1)], "file_id string, column string, surface string, replacement string, place long"))
    assert state.lookups().where("surface = 'xy'").count() == 2
