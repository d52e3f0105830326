"""N-gram Jaccard self-join by prefix trees, and its connected components.

1. Every text becomes the set of its distinct five-word shingles; equal sets form a class with a number of its own, and only one
   text of a class goes on. A class also has ``WORDS64`` words of parity bits: bit b is the parity of its shingles that hash to b.
2. A global order: shingles by how often they occur, rare ones first, then by hash. Only the ``COMMON`` most frequent ones need
   their counts (any fixed order gives right results; this one keeps frequent shingles out of the prefixes).
3. Sets that reach the similarity share a shingle among the first |x| - ceil(t |x|) + 1 of each. These prefixes form a table of
   (shingle, class); shingles of one class alone drop out.
4. In the group of a shingle, members are first joined with ``PIVOTS`` of them only, the smallest and those of the least hashes under
   different seeds (mostly the same ones in all groups of near copies of a text). What these joins link is merged into components.
5. Where a group still has several components, its members of different components are paired, if their sizes, the places
   of a shingle in both sets, their parity bits and the number of shingles that their prefixes share leave room for enough overlap.
   These pairs are joined too, and components merged again.
   Pairs within one component are not needed for the components, so none that matters is lost.

Two sets differ in at least as many shingles as their parity bits differ in, so a pair whose bits differ in more than the similarity
allows is no link; this test runs inside the join on the shingle, so that what a large group of unlike sets makes is compared there but not kept.

A join of classes with a pivot: the members' sets, in the global order reversed so that frequent shingles come first,
form a prefix tree, held as the sorted list of its paths. It is walked in order; a member takes over the overlap
that was counted on the path which it shares with the one before it, and a path is left where the remaining lengths cannot
bring the overlap to the bound; paths below it that share the part where it was left are skipped without a look at their rest. The members of a
pivot are dealt into trees of at most about ``TREE`` sets, each with its own copy of the pivot's set, so a large group spreads over tasks.

The driver holds the list of frequent shingles (bounded) and counts. Tables between the steps lie in the shared
checkpoint folder.

Defined results: null text, empty text and text without words have an empty set, n_shingles 0 and a component of
their own (their id); repeated rows each get a result; rows with equal ids and different texts, null ids as well, are different documents, linked
only if their texts are; a component is named by its smallest id that isn't null, null only if all are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_names, quoted, release, remove_dir, scratch, slices, small_batches
from .shingles import set_key, shingle_sets

NUM, DEN = 4, 5  # similarity of 4/5 or more
COMMON = 400_000  # frequent shingles whose counts order them
PIVOTS = 4  # members of a group that all others are joined with first
TREE, GOES = 128, 512  # sets in a tree, and trees that one row sends a set to
SLICE, SENT = 1000, 8 << 20  # texts whose sets are made at a time, and bytes of sets sent at a time
WORDS64 = 16  # 64-bit words of parity bits
NO_ID = 2**63 - 1
FIRST = "doc_id long, h long, n long, k1 long, k2 long, token long, times long, bits array<long>"


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``WORDS64`` words for each set: bit b is the parity of the number of its shingles whose low bits are b."""
    width = 64 * WORDS64
    out = np.zeros((len(sets), width), "uint8")
    for row, s in zip(out, sets):
        row[:] = np.bincount((s % np.uint64(width)).astype("int64"), minlength=width) & 1
    return np.packbits(out, axis=1, bitorder="little").view("int64")


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows for shingles that several sets of this task's part have."""
    names = [f.split()[0] for f in FIRST.split(", ")]
    seen, held, size, n_sets = set(), [], 0, 0

    def frequent():
        flat = np.concatenate(held)
        held.clear()
        flat.sort()
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        times = np.diff(np.append(starts, len(flat)))
        often = times >= max(3, n_sets // 4000)
        tokens, times = flat[starts[often]], times[often]
        m = len(tokens)
        return pa.record_batch([*[pa.nulls(m, pa.int64())] * 5, pa.array(tokens.view("int64")), pa.array(times), pa.nulls(m, pa.list_(pa.int64()))], names=names)

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            sets = shingle_sets(part["text"])
            keys = [set_key(s) for s in sets]
            m, bits = part.num_rows, pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype="int32") * WORDS64), pa.array(parity(sets).ravel()))
            yield pa.record_batch(
                [
                    part["doc_id"], part["h"], pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    *[pa.nulls(m, pa.int64())] * 2, bits,
                ],
                names=names,
            )
            for s, k in zip(sets, keys):
                if len(s) and k not in seen:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
                    n_sets += 1
            if size > 4_000_000:  # bounds the memory; counts of a part of the task do as well
                yield frequent()
                seen, size, n_sets = set(), 0, 0
    if held:
        yield frequent()


class Order:
    """The global order of shingles."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.times = tokens[by], times[by].astype("int64")

    def sort(self, s: np.ndarray) -> np.ndarray:
        """A set (sorted by hash) in the global order."""
        if not len(self.tokens) or not len(s):
            return s
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        times = np.where(self.tokens[at] == s, self.times[at], 0)
        return s[np.argsort(times, kind="stable")]


def least_overlap(n: int, m: int) -> int:
    """Overlap of sets of these sizes from which their similarity reaches the bound: DEN * o >= NUM * (n + m - o)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _alike(n: str, m: str) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return NUM * F.greatest(n, m) <= DEN * F.least(n, m)


def _least_common(n: str, m: str) -> Column:
    """Shingles that the prefixes of sets of these sizes must share at least.

    Of the two prefixes, one ends first in the global order. What the sets share up to there lies in both prefixes; what
    they share beyond lies in the rest of that set. So the overlap is at most the common part of the prefixes and the larger rest.
    """
    need = F.ceil(NUM * (F.col(n) + F.col(m)) / F.lit(NUM + DEN))
    rest = F.ceil(NUM * F.greatest(n, m) / F.lit(DEN)) - 1
    return need - rest


def _bits_allow(n: str, m: str, bits: str, other: str) -> Column:
    """Whether parity bits differ in no more places than the sets may differ in shingles. Written out, so that it is compiled."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(WORDS64)])
    both = F.col(n) + F.col(m)
    return differ <= both - 2 * F.ceil(NUM * both / F.lit(NUM + DEN))


def _plausible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes, bits and prefixes leave room for the similarity. ``heads``: v, n, tokens and bits."""
    left, right = heads.toDF("a", "n_a", "t_a", "bits_a"), heads.toDF("b", "n_b", "t_b", "bits_b")
    common = F.size(F.array_intersect("t_a", "t_b"))
    found = pairs.join(left, "a").join(right, "b").where(_alike("n_a", "n_b") & _bits_allow("n_a", "n_b", "bits_a", "bits_b")).where(common >= _least_common("n_a", "n_b"))
    return found.select("a", "b").distinct()


def tree_join(pivot: np.ndarray, members: list[np.ndarray]) -> list[int]:
    """Indices of members whose similarity to the pivot reaches the bound. All sets are in one global order, frequent first.

    The sorted members are the depth-first walk of their prefix tree. ``path`` is the overlap with the pivot after each step from the root;
    a path is followed only as far as the bound allows, in blocks of doubling length, and where it is left it ends, so members below that branch
    are pruned as soon as their own lengths do no better.
    """
    order = sorted(range(len(members)), key=lambda i: members[i].tobytes())
    inside = np.sort(pivot)
    n, out = len(pivot), []
    before = np.zeros(0, "uint64")
    path = np.zeros(1, "int64")
    for i in order:
        s = members[i]
        m = len(s)
        need = least_overlap(n, m)
        if not n or need > min(n, m):
            continue
        room = min(len(before), m, len(path) - 1)
        differ = np.flatnonzero(before[:room] != s[:room])
        at = int(differ[0]) if len(differ) else room
        path, before, step = path[: at + 1], s, 32
        while path[-1] + min(m - at, n - path[-1]) >= need and at < m:
            rest = s[at : at + step]
            hit = inside[np.minimum(np.searchsorted(inside, rest), n - 1)] == rest
            path = np.concatenate([path, path[-1] + np.cumsum(hit)])
            at, step = at + len(rest), step * 2
        if at == m and path[-1] >= need:
            out.append(i)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by pivot and tree, the pivot's own set first: the links found."""

    def flush():
        found = sorted({ids[i] for i in tree_join(own, sets)})
        return pa.record_batch([pa.array([at[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    at, own, ids, sets = None, None, [], []
    for batch in batches:
        for part in slices(batch, "items", 2000, SENT):
            for pivot, tree, v, raw in zip(*(part[c].to_pylist() for c in ("pivot", "tree", "v", "items"))):
                if (pivot, tree) != at:
                    if own is not None and sets:
                        yield flush()
                    at, own, ids, sets = (pivot, tree), None, [], []
                s = np.frombuffer(raw, "uint64")
                if v == pivot:
                    own = s
                else:
                    ids.append(v)
                    sets.append(s)
    if own is not None and sets:
        yield flush()


def _ship(order):
    """Sets of classes, for each tree that they go to."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows, size = [], 0
                for v, s, trees in zip(part["v"].to_pylist(), shingle_sets(part["text"]), part["trees"].to_pylist()):
                    raw = order.value.sort(s)[::-1].tobytes()
                    for t in trees:
                        rows.append((t["pivot"], t["tree"], v != t["pivot"], v, raw))
                        size += len(raw)
                        if len(rows) >= 2000 or size > SENT:
                            yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=schema)

    schema = pa.schema([("pivot", pa.int64()), ("tree", pa.int64()), ("member", pa.bool_()), ("v", pa.int64()), ("items", pa.large_binary())])
    return make


def _verify(pairs: DataFrame, texts: DataFrame, classes: DataFrame, order) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity. ``pairs`` are written already."""
    if pairs.isEmpty():
        return pairs
    sizes = cut(pairs.groupBy("a").agg(F.count("*").alias("members")))  # written, so that a hot pivot's join can be split
    trees = F.ceil(F.col("members") / TREE)
    dealt = cut(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), trees).alias("tree")))
    goes = dealt.select(F.col("b").alias("v"), F.col("a").alias("pivot"), "tree").unionByName(dealt.select("a", "tree").distinct().select(F.col("a").alias("v"), F.col("a").alias("pivot"), "tree"))
    # A pivot of very many trees has a row for each GOES of them; a member has no more pivots than shingles in its prefix.
    goes = goes.withColumn("lot", F.when(F.col("v") == F.col("pivot"), F.floor(F.col("tree") / GOES)).otherwise(F.lit(0)))
    goes = goes.groupBy("v", "lot").agg(F.collect_list(F.struct("pivot", "tree")).alias("trees"))
    goes = goes.join(classes.select("v", "doc_id", "h"), "v")
    sent = texts.join(goes, ["doc_id", "h"]).mapInArrow(_ship(order), "pivot long, tree long, member boolean, v long, items binary")
    sent = sent.repartition("pivot", "tree").sortWithinPartitions("pivot", "tree", "member")
    return cut(sent.select("pivot", "tree", "v", "items").mapInArrow(_joined, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """v, c: the smallest vertex that each linked vertex reaches. Labels spread along links and are looked up in themselves."""
    both = cut(links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct())
    label = cut(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("c")))
    while True:
        near = both.join(label.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w").groupBy("v").agg(F.min("cw").alias("cw"))
        step = cut(label.join(near, "v").select("v", "c", F.least("c", "cw").alias("d")))
        jump = step.select(F.col("v").alias("d"), F.col("d").alias("e"))
        step = cut(step.join(jump, "d", "left").select("v", "c", F.least("d", F.coalesce("e", "d")).alias("d")))
        if step.where("c != d").isEmpty():
            return label
        label = step.select("v", F.col("d").alias("c"))


@dataclass
class _Join:
    rows: DataFrame  # doc_id, h, n, k1, k2 of every row; h is the hash of its text
    classes: DataFrame  # k1, k2, n, v, doc_id, h of the smallest document, bits
    links: DataFrame  # a, b: numbers of classes
    repeated: bool  # whether rows have one id and one text


def _linked(docs: DataFrame, id_col: str, text_col: str, every: bool, folder: str) -> _Join:
    """The join. Not ``every`` link: those that components need. ``folder`` may go when what is returned has been used."""
    spark = docs.sparkSession
    text = F.col(quoted(text_col))
    texts = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    first = cut(texts.mapInArrow(_first_pass, FIRST))
    rows = cut(first.where("n is not null").select("doc_id", "h", "n", "k1", "k2"))
    often = first.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(COMMON).toArrow()
    order = spark.sparkContext.broadcast(Order(often["token"].to_numpy().view("uint64"), often["times"].to_numpy()))
    classes = first.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("bits").alias("bits"))
    classes = cut(classes.select("k1", "k2", "n", F.monotonically_increasing_id().alias("v"), "least.doc_id", "least.h", "bits"))
    del first
    repeated = not rows.where("n > 0").groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    if repeated:  # else a text stands for itself
        texts = cut(texts.dropDuplicates(["doc_id", "h"]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, sets = part["v"].to_numpy(), [s for s in shingle_sets(part["text"])]
                heads = [order.value.sort(s)[: prefix_length(len(s))] for s in sets]
                size = np.array([len(h) if len(s) else 0 for h, s in zip(heads, sets)], "int64")
                whole = np.array([len(s) for s in sets], "int64")
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                flat = np.concatenate([h[:k] for h, k in zip(heads, size)]) if len(heads) else np.zeros(0, "uint64")
                yield pa.record_batch([pa.array(flat.view("int64")), pa.array(np.repeat(ids, size)), pa.array(np.repeat(whole, size).astype("int32")), pa.array(place.astype("int32"))], names=["token", "v", "n", "pos"])

    with small_batches(spark):
        texts.join(classes.select("doc_id", "h", "v"), ["doc_id", "h"]).select("v", "text").mapInArrow(prefixes, "token long, v long, n int, pos int").write.parquet(f"{folder}/prefixes")
    release(spark)
    table = spark.read.parquet(f"{folder}/prefixes")
    pivots = F.array_distinct(F.array(F.min("v"), *[F.min_by("v", F.xxhash64("v", F.lit(i))) for i in range(1, PIVOTS)]))
    shared = table.groupBy("token").agg(F.count("*").alias("df"), pivots.alias("pivots")).where("df > 1").select("token", "pivots")
    table.join(shared, "token").write.parquet(f"{folder}/shared")
    table = spark.read.parquet(f"{folder}/shared")
    del shared
    remove_dir(spark, f"{folder}/prefixes")
    release(spark)
    # The shared shingles of a prefix, and the bits of its set.
    heads = cut(table.groupBy("v").agg(F.collect_list("token").alias("tokens")).join(classes.select("v", "n", "bits"), "v").select("v", "n", "tokens", "bits"))

    # Step 4: each member with its group's pivots; a is the pivot, whichever number is smaller.
    star = table.select(F.explode("pivots").alias("a"), F.col("v").alias("b")).where("a != b")
    star = star.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
    star = cut(_plausible(star, heads))
    links = _verify(star, texts, classes, order)
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    release(spark)
    # Members of different components in one group; for every link each member counts as a component.
    table = table.drop("pivots")
    if every:
        table = table.withColumn("c", F.col("v"))
    else:
        table = table.join(components(links).select("v", "c"), "v", "left").withColumn("c", F.coalesce("c", "v"))
    mixed = table.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    # Written and read rather than cut: a checkpoint keeps the plan's constraints, which the optimizer would multiply by the names of the other side.
    table.join(mixed, "token", "left_semi").join(classes.select("v", "bits"), "v").write.parquet(f"{folder}/mixed")
    table = spark.read.parquet(f"{folder}/mixed")
    del mixed
    remove_dir(spark, f"{folder}/shared")
    release(spark)

    # Step 5.
    other = table.select("token", F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"), F.col("bits").alias("bits2"))
    room = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    fits = (DEN + NUM) * room >= NUM * (F.col("n") + F.col("n2"))
    more = table.join(other, "token").where((F.col("v") < F.col("v2")) & (F.col("c") != F.col("c2")) & _alike("n", "n2") & fits & _bits_allow("n", "n2", "bits", "bits2"))
    more = cut(more.select(F.col("v").alias("a"), F.col("v2").alias("b")).distinct())
    more = cut(_plausible(more, heads).join(tried, ["a", "b"], "left_anti"))
    del table, other, star, tried, heads
    release(spark)
    links = links.unionByName(_verify(more, texts, classes, order))
    return _Join(rows, classes, links, repeated)


def _null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join. Every row's doc_id, class_id and rep, the smallest id with an equal set; and class_a, class_b, a, b, the pairs of classes that are alike and their reps.

    Rows of one class are alike as well; a row without shingles is alike to none, its own rep, and has no class. a <= b, a null after all.
    """
    with scratch(docs.sparkSession) as folder:
        got = _linked(docs, id_col, text_col, True, folder)
        links = cut(got.links)
    reps = got.classes.select("k1", "k2", "n", F.col("v").alias("class_id"), F.col("doc_id").alias("rep"))
    members = cut(got.rows.join(reps, ["k1", "k2", "n"], "left").select(_null("doc_id").alias("doc_id"), "class_id", F.nullif(F.coalesce("rep", "doc_id"), F.lit(NO_ID)).alias("rep")))
    one = got.classes.select(F.struct(F.col("doc_id").alias("rep"), "v").alias("x"), F.col("v"))
    links = links.join(one.toDF("x", "a"), "a").join(one.toDF("y", "b"), "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return members, cut(links.select(F.col("x.v").alias("class_a"), F.col("y.v").alias("class_b"), _null("x.rep").alias("a"), _null("y.rep").alias("b")))


def _components_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[_Join, DataFrame]:
    """The join, and its classes with c, the number of their component."""
    with scratch(docs.sparkSession) as folder:
        got = _linked(docs, id_col, text_col, False, folder)
        joined = components(got.links).select("v", "c")
    return got, cut(got.classes.drop("bits").join(joined, "v", "left").withColumn("c", F.coalesce("c", "v")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    got, known = _components_of(docs, id_col, text_col)
    named = known.groupBy("c").agg(F.min("doc_id").alias("name"))
    known = cut(known.select("k1", "k2", "n", "c").join(named, "c").drop("c"))
    return cut(got.rows.join(known, ["k1", "k2", "n"], "left").select(_null("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("name", "doc_id"), F.lit(NO_ID)).alias("component_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (of equal ids, the least hash of its text), with all its columns.

    Documents without words stay. Of repeated rows (one id and one text) that stay, the one whose other columns are least as JSON does.
    """
    got, known = _components_of(docs, id_col, text_col)
    kept = known.groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("least")).select("least.*", F.lit(True).alias("one"))
    kept = cut(kept.unionByName(got.rows.where("n = 0").select("doc_id", "h", F.lit(False).alias("one")).distinct()))
    ident, h, one, place = free_names(docs, "doc_id", "h", "one", "place")
    names = [F.col(quoted(c)) for c in docs.columns]
    text = F.col(quoted(text_col))
    marked = docs.select(*names, F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias(ident), F.xxhash64(text).alias(h))
    marked = marked.join(kept.toDF(ident, h, one), [ident, h])
    if got.repeated:
        by = Window.partitionBy(ident, h).orderBy(F.to_json(F.struct(*names)))
        marked = marked.where(f"not {one}").withColumn(place, F.lit(1)).unionByName(marked.where(one).withColumn(place, F.row_number().over(by))).where(f"{place} = 1")
    return marked.select(*names)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""
