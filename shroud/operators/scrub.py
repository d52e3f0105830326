"""Free text without personal data: known surfaces first, then detectors, then single words; and the way back.

1. Surfaces of several words are replaced, the longest first, wherever they stand.
2. Every detector match becomes the pseudonym of its kind; new ones are numbered in the order in which they are seen.
3. Every span (a run of letters, digits and joiners) is looked up: as it is, as an integer if it reads like ``12.0``, without a
   Korean particle, which is put back, and else by its parts between underscores. Pseudonyms themselves are left alone.

Texts are prepared once and kept in the checkpoint folder, so that numbering and rewriting see the same snapshot. Distinct
spans, not texts, are joined with the dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import with_matches
from .dictionary import SPAN, State, allocate, cut, number

# Particles that may follow a known word.
PARTICLES = (
    "이", "가", "은", "는", "을", "를", "의", "에", "에게", "께", "께서", "과", "와", "도", "만",
    "로", "으로", "님", "씨", "에서", "한테", "이랑", "랑", "이다", "이며", "이고",
)
LONGEST_FIRST = tuple(sorted(PARTICLES, key=lambda p: -len(p)))
TOKEN = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_\d{6,}(?![0-9])"
#: Surfaces of several words up to which they go to the executors in one piece; beyond, they are joined with the texts.
MULTIWORD = 200_000
#: Resolved spans up to which they go to the executors in one piece; beyond, texts are joined with them.
SPANS = 500_000
#: Texts whose matches a Python worker holds as objects at a time.
SLICE = 64
EDITS = "array<struct<start:int,stop:int,text:string>>"


def splice(text: Column, edits: Column) -> Column:
    """The text with edits (start, stop, text; counted from 0, not overlapping) made, without leaving the JVM."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, e: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, e["start"] - done["at"])
        return F.struct(F.concat(done["out"], kept, e["text"]).alias("out"), e["stop"].alias("at"))

    def rest(done: Column) -> Column:
        return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))

    return F.when(F.size(edits) > 0, F.aggregate(F.array_sort(edits), begin, step, rest)).otherwise(text)


def replace_surfaces(text: str, surfaces: list[str], into: list[str], finder=None) -> tuple[str, int]:
    """Each surface in turn, and the number of replacements. ``finder`` names the surfaces that occur, of many."""
    hits, at = 0, 0
    if finder is None:
        for s, r in zip(surfaces, into):
            if s in text:
                hits += text.count(s)
                text = text.replace(s, r)
        return text, hits
    while (at := min((i for _, i in finder.iter(text) if i >= at), default=-1)) >= 0:
        hits += text.count(surfaces[at])
        text = text.replace(surfaces[at], into[at])
        at += 1
    return text, hits


def multiword(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with the column's known surfaces of several words replaced, and their number in ``hits``."""
    known = dictionary.where("multiword").groupBy("surface").agg(F.min_by("replacement", "seq").alias("replacement"))
    known = cut(number(known.withColumn("order", F.struct((-F.length("surface")).alias("l"), "surface")), [], "order", "place"))
    df, most = df.withColumn("hits", F.lit(0)), known.count()
    if most > MULTIWORD:
        return _replace_joined(df, column, known)
    if most:
        part = known.orderBy("place").collect()
        df = _replace_all(df, column, [r.surface for r in part], [r.replacement for r in part])
    return df


# Very many surfaces: each is joined with the texts that may hold it. The key is one of its runs of letters and digits. A run that
# has other signs on both sides within the surface is a whole run of the text (w); at the surface's end it begins a run of the
# text (p), at its start it ends one (s), and alone it is within one (i). Surfaces without letters and digits are within a run of others (o).
RUN, OTHERS = r"[\p{L}\p{Nd}]+", r"[^\p{L}\p{Nd}]+"


def anchors(known: DataFrame) -> DataFrame:
    """place, surface, replacement, kind, part: for each surface the key that the fewest surfaces share."""
    s = F.col("surface")
    runs = F.regexp_extract_all(s, F.lit(RUN), F.lit(0))
    rows = known.withColumns({"n": F.size(runs), "begins": s.rlike(r"\A[\p{L}\p{Nd}]"), "ends": s.rlike(r"[\p{L}\p{Nd}]\z")})
    rows = rows.select("place", "n", "begins", "ends", F.posexplode(F.when(F.col("n") > 0, runs).otherwise(F.array(s))).alias("i", "part"))
    left, right = F.col("begins") & (F.col("i") == 0), F.col("ends") & (F.col("i") == F.col("n") - 1)
    kind = F.when(F.col("n") == 0, "o").when(left & right, "i").when(left, "s").when(right, "p").otherwise("w")
    rows = cut(rows.select("place", kind.alias("kind"), "part"))
    shared = rows.groupBy("kind", "part").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("kind", "part"), F.struct("n", -F.length("part"), "kind", "part")).alias("a")
    chosen = rows.join(shared, ["kind", "part"]).groupBy("place").agg(best).select("place", "a.*")
    return cut(known.join(chosen, "place"))


def _keys(df: DataFrame, column: str, keep: list[str], lengths: dict[str, list[int]]) -> DataFrame:
    """The kept columns, kind and part: every key of these lengths that stands in the text."""

    def of(runs: str, kinds: str) -> Column:
        def keys(run: Column) -> Column:
            def fit(kind: str) -> Column:
                return F.filter(F.array(*[F.lit(n) for n in lengths[kind]]), lambda n: n <= F.length(run))

            def within(kind: str) -> Column:
                return F.flatten(F.transform(fit(kind), lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda at: F.substring(run, at, n))))

            made = {
                "w": lambda: F.array(run), "p": lambda: F.transform(fit("p"), lambda n: F.substring(run, F.lit(1), n)),
                "s": lambda: F.transform(fit("s"), lambda n: F.substring(run, F.length(run) - n + 1, n)), "i": lambda: within("i"), "o": lambda: within("o"),
            }
            def named(kind: str) -> Column:
                return F.transform(made[kind](), lambda part: F.struct(F.lit(kind).alias("kind"), part.alias("part")))

            return F.flatten(F.array(*map(named, kinds)))

        return F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(runs), F.lit(0))), keys))

    sides = [(RUN, [k for k in "wpsi" if k in lengths]), (OTHERS, [k for k in "o" if k in lengths])]
    made = [of(runs, kinds) for runs, kinds in sides if kinds]
    return df.select(*keep, F.explode(F.array_distinct(F.concat(*made))).alias("k")).select(*keep, "k.*")


def _replace_joined(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Each surface in turn, of those that a text may hold. A replacement can make a surface that was not there: it has a part of the
    replacement in it, so the places of replacements are looked up as well, until they hold nothing new."""
    known = anchors(known)
    lengths: dict[str, list[int]] = {}
    for r in known.select("kind", F.length("part").alias("n")).distinct().orderBy("kind", "n").collect():  # one row for each length
        lengths.setdefault(r.kind, []).append(r.n)
    reach = known.agg(F.max(F.length("surface"))).first()[0] - 1

    @F.pandas_udf("struct<text:string,hits:int,zones:array<string>>")
    def replaced(texts: pd.Series, surfaces: pd.Series, into: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replace_noting(t, s, r, reach) for t, s, r in zip(texts, surfaces, into)], columns=["text", "hits", "zones"])

    df = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    found = ["_id", "place", "surface", "replacement"]
    held = cut(_keys(df, column, ["_id"], lengths).join(known, ["kind", "part"]).select(*found).distinct())
    while True:
        own = held.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("place", "surface", "replacement"))).alias("_h"))
        done = df.join(own, "_id").withColumn("_m", replaced(F.col(column), F.col("_h.surface"), F.col("_h.replacement"))).drop("_h")
        done = cut(done.where("_m.hits > 0"))
        zones = _keys(done.select("_id", F.explode("_m.zones").alias("zone")), "zone", ["_id", "zone"], lengths).join(known, ["kind", "part"])
        more = cut(zones.where(F.col("zone").contains(F.col("surface"))).select(*found).distinct().join(held, ["_id", "place"], "left_anti").select(*found))
        if more.isEmpty():
            break
        held = cut(held.unionByName(more))
    changed = done.select("_id", F.col("_m.text").alias("_t"), F.col("_m.hits").alias("_n"))
    out = df.join(changed, "_id", "left").withColumns({column: F.coalesce("_t", F.col(column)), "hits": F.col("hits") + F.coalesce("_n", F.lit(0))})
    return out.drop("_id", "_t", "_n")


def replace_noting(text: str, surfaces: Iterable[str], into: Iterable[str], reach: int) -> tuple[str, int, list[str]]:
    """Each surface in turn, the number of replacements, and what stands around each of them at that time."""
    hits, zones = 0, []
    for s, r in zip(surfaces, into):
        first, *parts = text.split(s)
        if not parts:
            continue
        text, at = r.join((first, *parts)), len(first)
        for part in parts:
            zones.append(text[max(0, at - reach) : at + len(r) + reach])
            at += len(r) + len(part)
        hits += len(parts)
    return text, hits, zones


def _replace_all(df: DataFrame, column: str, surfaces: list[str], into: list[str]) -> DataFrame:
    told = df.sparkSession.sparkContext.broadcast((surfaces, into))

    @F.pandas_udf("struct<text:string,hits:int>")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, finder = told.value, None
        if len(known[0]) > 64:  # made once for all batches of a task
            import ahocorasick

            finder = ahocorasick.Automaton()
            for i, s in enumerate(known[0]):
                finder.add_word(s, i)
            finder.make_automaton()
        for texts in batches:
            yield pd.DataFrame([replace_surfaces(t, *known, finder) if isinstance(t, str) else (None, 0) for t in texts], columns=["text", "hits"])

    return df.withColumn("_m", replaced(F.col(column))).withColumns({column: F.col("_m.text"), "hits": F.col("hits") + F.col("_m.hits")}).drop("_m")


# ---- single spans ----


def candidates(span: Column) -> Column:
    """Surfaces under which a span may be known, in order, and what follows their replacement."""
    ways = [F.struct(F.lit(0).alias("way"), span.alias("surface"), F.lit("").alias("tail"))]
    whole = F.regexp_extract(span, r"^(\d+)\.0+$", 1)
    ways.append(F.when(whole != "", F.struct(F.lit(1).alias("way"), whole.alias("surface"), F.lit("").alias("tail"))))
    for i, p in enumerate(LONGEST_FIRST):
        shorter = F.substring(span, F.lit(1), F.length(span) - len(p))
        ways.append(F.when(span.endswith(p) & (F.length(span) > len(p)), F.struct(F.lit(2 + i).alias("way"), shorter.alias("surface"), F.lit(p).alias("tail"))))
    return F.filter(F.array(*ways), lambda w: w.isNotNull())


def resolve(spans: DataFrame, dictionary: DataFrame, tokens: DataFrame) -> DataFrame:
    """span, replacement, hits of the spans (distinct) that the dictionary knows in one of the ways."""
    known = dictionary.groupBy("surface").agg(F.min_by("replacement", "seq").alias("replacement"))
    spans = cut(spans.join(tokens.select(F.col("token").alias("span")), "span", "left_anti"))  # read six times below
    parted = F.col("span").contains("_")
    parts = spans.where(parted).select("span", F.posexplode(F.split("span", "_", -1)).alias("i", "part"))
    units = cut(spans.select(F.col("span").alias("unit")).union(parts.select("part")).where("unit <> ''").distinct())
    ways = units.select("unit", F.explode(candidates(F.col("unit"))).alias("w")).select("unit", "w.*")
    found = ways.join(known, "surface").groupBy("unit").agg(F.min_by(F.concat("replacement", "tail"), "way").alias("put"))
    found = cut(found)
    direct = spans.join(found, spans["span"] == found["unit"]).select("span", F.col("put").alias("replacement"), F.lit(1).alias("hits"))
    by_part = parts.join(direct.select("span"), "span", "left_anti").join(found, parts["part"] == found["unit"], "left")
    by_part = by_part.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("put", "part").alias("put")))).alias("p"), F.count("put").alias("hits"))
    by_part = by_part.where("hits > 0").select("span", F.array_join(F.transform("p", lambda x: x["put"]), "_").alias("replacement"), F.col("hits").cast("int"))
    return direct.unionByName(by_part)


_SPAN = re.compile(SPAN)


def places_in(pattern: re.Pattern, texts: pa.Array) -> pa.Array:
    """Matches in each text as Arrow lists; null stays null. Only the matches of ``SLICE`` texts are Python objects at a time."""

    def lists(part: pa.Array) -> pa.Array:
        ends, found = [], []
        for t in part.to_pylist():
            ends.append(None if t is None else len(found))
            found += [(*m.span(), m[0]) for m in pattern.finditer(t)] if t else []
        start, stop, span = zip(*found) if found else ((), (), ())
        rows = pa.StructArray.from_arrays([pa.array(start, "int32"), pa.array(stop, "int32"), pa.array(span, "string")], ["start", "stop", "span"])
        return pa.ListArray.from_arrays(pa.array([*ends, len(found)], "int32"), rows)

    return pa.concat_arrays([lists(texts.slice(lo, SLICE)) for lo in range(0, max(len(texts), 1), SLICE)])


def occurrences(pattern: re.Pattern, c: Column) -> Column:
    """Matches of a pattern with their places, as array<struct<start,stop,span>>."""

    @F.arrow_udf("array<struct<start:int,stop:int,span:string>>")
    def found(texts: pa.Array) -> pa.Array:
        return places_in(pattern, texts)

    return found(c)


def spans_of(c: Column) -> Column:
    return occurrences(_SPAN, c)


def span_texts(c: Column) -> Column:
    """The spans of a text without their places, on the JVM."""
    return F.regexp_extract_all(c, F.lit(SPAN), F.lit(0))


def replace_spans(df: DataFrame, column: str, key: list[str], resolved: DataFrame) -> DataFrame:
    """``df`` with resolved spans replaced and counted into ``hits``."""
    resolved = cut(resolved)
    if resolved.limit(SPANS + 1).count() <= SPANS:
        told = df.sparkSession.sparkContext.broadcast({r.span: (r.replacement, r.hits) for r in resolved.collect()})

        @F.pandas_udf("struct<text:string,hits:int>")
        def rewritten(texts: pd.Series) -> pd.DataFrame:
            known, out = told.value, []
            for t in texts:
                n = 0

                def put(m: re.Match) -> str:
                    nonlocal n
                    new = known.get(m[0])
                    n += new[1] if new else 0
                    return new[0] if new else m[0]

                out.append((_SPAN.sub(put, t) if isinstance(t, str) else None, n))
            return pd.DataFrame(out, columns=["text", "hits"])

        if not told.value:
            return df
        return df.withColumn("_r", rewritten(F.col(column))).withColumns({column: F.col("_r.text"), "hits": F.col("hits") + F.col("_r.hits")}).drop("_r")
    marked = df.select(*key, F.explode(spans_of(F.col(column))).alias("s")).select(*key, "s.*").join(resolved, "span")
    edits = marked.groupBy(*key).agg(F.collect_list(F.struct("start", "stop", F.col("replacement").alias("text"))).alias("edits"), F.sum("hits").alias("more"))
    joined = df.join(edits, key, "left")
    changed = splice(F.col(column), F.coalesce("edits", F.array().cast(EDITS)))
    return joined.withColumns({column: changed, "hits": F.col("hits") + F.coalesce("more", F.lit(0))}).drop("edits", "more")


def scrub(df: DataFrame, column: str, key: list[str], state: State, commit: bool = True) -> DataFrame:
    """``df`` with the column scrubbed and the number of replacements in ``hits``.

    ``key``: columns that tell rows apart and give the order in which new pseudonyms are numbered.
    """
    dictionary, mapping = cut(state.lookups()), state.mapping()
    # The snapshot that both the numbering and the rewriting see. Surfaces are replaced before the texts part at the gate of the
    # detectors, so that no text goes that way twice.
    ready = multiword(df, column, dictionary)
    if not dictionary.where("multiword").isEmpty():
        ready = cut(ready)
    ready = cut(with_matches(ready, column, "_found"))
    found = ready.select(*key, F.explode("_found").alias("m"))
    seen = F.struct(*[F.col(k) for k in key], F.col("m.start").alias("_start"))
    keys = found.select(F.col("m.kind").alias("entity"), F.col("m.norm").alias("norm"), F.col("m.value").alias("raw"), seen.alias("seen"))
    fresh = cut(allocate(keys, mapping))
    if commit and not fresh.isEmpty():
        state.commit(mapping=fresh)
    tokens = mapping.unionByName(fresh).select("entity", "norm", "token")
    put = found.select(*key, "m.*").join(tokens.withColumnRenamed("entity", "kind"), ["kind", "norm"])
    edits = put.groupBy(*key).agg(F.collect_list(F.struct("start", F.col("end").alias("stop"), F.col("token").alias("text"))).alias("_edits"))
    ready = ready.join(edits, key, "left").withColumn("_edits", F.coalesce("_edits", F.array().cast(EDITS)))
    ready = ready.withColumns({column: splice(F.col(column), F.col("_edits")), "hits": F.col("hits") + F.size("_edits")}).drop("_found", "_edits")
    ready = cut(ready)
    if dictionary.isEmpty():
        return ready
    spans = ready.select(F.explode(span_texts(F.col(column))).alias("span")).distinct()
    return replace_spans(ready, column, key, resolve(spans, dictionary, tokens))


# ---- the way back ----


def tokens_in(text: Column) -> Column:
    """Distinct pseudonyms in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


_TOKEN = re.compile(TOKEN)


def restore(df: DataFrame, column: str, key: list[str], state: State) -> DataFrame:
    """``df`` with known pseudonyms replaced by what was seen first for them; unknown ones stay."""
    has = F.coalesce(F.col(column).rlike(TOKEN), F.lit(False))
    places = df.where(has).select(*key, F.explode(occurrences(_TOKEN, F.col(column))).alias("p")).select(*key, "p.start", "p.stop", F.col("p.span").alias("token"))
    edits = places.join(state.mapping().select("token", "raw"), "token")
    edits = edits.groupBy(*key).agg(F.collect_list(F.struct("start", "stop", F.col("raw").alias("text"))).alias("_edits"))
    out = df.join(edits, key, "left")
    return out.withColumn(column, splice(F.col(column), F.coalesce("_edits", F.array().cast(EDITS)))).drop("_edits")
