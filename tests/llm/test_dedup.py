"""Exact copies, repeated passages and near copies against brute force."""

import hashlib
import random
import re

from conftest import prose
from shroud.llm import spans
from shroud.llm.exact_dedup import drop_copies, exact_dedup
from shroud.llm.jaccard_join import jaccard_components, jaccard_links, keep_first, least_overlap, prefix_length, tree_join
from shroud.llm.spans import remove_repeats, substring_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, texts):
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(normal(t), []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_of_a_group_over_many_ranges(spark):
    rows = [(i, "the same text") for i in range(5000)] + [(i, f"other {i}") for i in range(5000, 5600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup(df).groupBy("group_size", "keep_id", "kept").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = {(r.keep_id, r.kept): r["count"] for r in got if r.group_size > 1}
    assert hot == {(0, True): 1, (0, False): 4999}
    assert sum(r["count"] for r in got if r.group_size == 1) == 600


def test_exact_dedup_odd_tables(empty, repeated, texts):
    assert exact_dedup(empty).count() == 0
    got = exact_dedup(repeated).collect()
    assert sum(r.kept for r in got) == len({normal(t) for t in texts.values()})
    assert drop_copies(repeated).count() == len({normal(t) for t in texts.values()})
    assert set(drop_copies(empty).columns) == set(empty.columns)


def test_drop_copies_of_equal_ids_that_differ_in_white_space(spark):
    rows = [(5, "a b"), (5, "a  b"), (5, "a\tb"), (5, "other"), (6, "a b"), (None, "x y"), (None, "x\n y"), (None, None), (None, ""), (7, "c")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = [(r.doc_id, normal(r.text), r.source) for r in drop_copies(df).collect()]
    assert sorted(got, key=repr) == sorted([(5, "a b", "s"), (5, "other", "s"), (None, "x y", "s"), (None, "", "s"), (7, "c", "s")], key=repr)


def brute_spans(texts):
    """Runs in order of id and place; every run seen before covers its sentences."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        ends, sizes, said = spans.sentences(t or "")
        first, last = spans.runs(sizes)
        covered = [], []
        for a, b in zip(first.tolist(), last.tolist()):
            run = tuple(said[a : b + 1])
            if run in seen:
                covered[0].append(a)
                covered[1].append(b)
            seen.add(run)
        out[i] = (None, 0) if t is None else spans.remove_runs(t, *covered)
    return out


def test_substring_dedup(docs, texts):
    want = brute_spans(texts)
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == want
    assert got[2][0] == "" and got[17][0] == ""  # copies go as a whole
    assert texts[17] in got[15][0] and texts[17] not in got[16][0]


def test_runs_cover_every_repeated_passage_of_fifty_words():
    for sizes in ([12] * 5, [3] * 17, [1, 2, 16, 16, 16, 1], [16, 16, 16, 3], [2] * 30):
        first, last = spans.runs(sizes)
        covered = {k for a, b in zip(first.tolist(), last.tolist()) for k in range(a, b + 1)}
        assert covered == set(range(len(sizes)))


def test_unaligned_passages_against_brute_force_over_windows(spark):
    """Repeated passages of more than 50 words are touched wherever they begin and end, in long sentences and in short ones."""
    rng, size = random.Random(11), 51

    def said(n, most):
        out = []
        while len(out) < n:
            out += [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(rng.randint(1, most))]
            out[-1] += "."
        return out[:n]

    docs = {0: " ".join(said(70, 90))}
    for i in range(1, 160):
        words = said(rng.randint(60, 160), most := rng.choice((5, 16, 20, 60, 200)))
        source = docs[rng.randrange(i)].split()
        at, n = rng.randrange(len(source) - size + 1), rng.randint(size, size + 8)
        cut = rng.randrange(len(words))
        docs[i] = " ".join([*words[:cut], *source[at : at + n], *said(rng.randint(1, 40), most)])
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()}
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == brute_spans(docs)
    seen, untouched, repeated = set(), [], 0
    for i, text in docs.items():
        words, kept = text.split(), f" {' '.join(got[i].text.split())} "
        windows = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
        repeated += sum(w in seen for w in windows)
        untouched += [(i, k) for k, w in enumerate(windows) if w in seen and f" {w} " in kept]
        seen.update(windows)
    assert repeated > 159 and not untouched


def test_substring_dedup_odd_tables(empty, repeated, docs):
    assert substring_dedup(empty).count() == 0
    once = {(r.doc_id, r.text) for r in substring_dedup(docs).select("doc_id", "text").collect()}
    twice = {(r.doc_id, r.text) for r in substring_dedup(repeated.where("doc_id is not null")).select("doc_id", "text").collect()}
    assert once == twice
    out = remove_repeats(docs.withColumnRenamed("source", "so.urce").withColumnRenamed("h", "n_removed"))
    assert out.columns == ["doc_id", "text", "lang", "so.urce", "n_chars", "score", "n_removed"]
    assert out.where("n_removed <> 'clash'").count() == 0
    assert substring_dedup(out).columns[-1] == "_n_removed"
    assert out.where("n_chars <> length(text)").count() == 0


def test_substring_dedup_of_null_and_equal_ids(spark):
    rng = random.Random(2)
    passage, other = prose(rng, 80), prose(rng, 80)
    rows = [(None, passage), (None, prose(rng, 20) + "\n" + passage), (7, other), (7, prose(rng, 30) + "\n" + other), (7, other), (8, prose(rng, 40))]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    for part in (passage, other):  # one place keeps it; a repeated row is the same place
        assert len({r.text for r in got if part in r.text}) == 1
    assert len(got) == 6 and sum(r.n_removed > 0 for r in got) in (2, 3)


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_components(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute_components(texts)


def test_jaccard_chains_and_frequent_passages(spark):
    """Links that only lead on through others, and passages that many documents share without being alike."""
    words = [f"w{i}" for i in range(400)]
    chain = {i: " ".join(words[6 * i : 6 * i + 120]) for i in range(40)}
    shared = {100 + i: " ".join(words[:30]) + " " + " ".join(f"d{i}x{j}" for j in range(40)) for i in range(60)}
    near = {200 + i: " ".join([*words[200:290], f"e{i}"]) for i in range(60)}
    texts = chain | shared | near
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute_components(texts)


def test_jaccard_links_are_all_pairs(spark, docs, texts, empty):
    words = [f"w{i}" for i in range(120)]
    near = {i: " ".join([*words[: 90 + i % 7], f"e{i}"]) for i in range(30)} | {40: " ".join([*words[:90], "e0"])}
    for said, df in ((texts, docs), (near, spark.createDataFrame(list(near.items()), "doc_id long, text string").repartition(3))):
        sets = {i: frozenset(shingles(t)) for i, t in said.items()}
        rep = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
        reps = sorted(i for i in set(rep.values()) if sets[i])
        want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        members, links = jaccard_links(df)
        assert {r.doc_id: r.rep for r in members.collect()} == rep
        assert sorted((r.a, r.b) for r in links.collect()) == sorted(want)
    assert [x.count() for x in jaccard_links(empty)] == [0, 0]


def brute_rows(rows):
    """Components of (id, text) rows, each row a document of its own: sets, labels and the rows of each component."""
    sets = [shingles(t) for _, t in rows]
    label = brute_components({i: t for i, (_, t) in enumerate(rows)})
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(label[i][1], []).append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sets, groups, {g: least([rows[i][0] for i in members]) for g, members in groups.items()}


def test_jaccard_odd_tables(empty, repeated, texts):
    assert jaccard_components(empty).count() == 0 and keep_first(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in repeated.collect()]
    sets, groups, names = brute_rows(rows)
    want = sorted([(rows[i][0], len(sets[i]), names[g]) for g, members in groups.items() for i in members], key=repr)
    assert sorted([tuple(r) for r in jaccard_components(repeated).collect()], key=repr) == want
    kept = keep_first(repeated)
    assert kept.columns == repeated.columns and kept.schema == repeated.schema
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([names[g] for g in groups], key=repr)


def test_jaccard_null_and_equal_ids_are_documents_of_their_own(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other, third = " ".join(words), " ".join(words + ["more"]), " ".join(f"z{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(5, text), (None, near), (None, other), (7, other + " end"), (7, third), (7, third), (None, None), (None, "x"), (None, "x"), (8, "")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, `so.me` string, h int").repartition(3)
    got = sorted([tuple(r) for r in jaccard_components(df).collect()], key=repr)
    sets, groups, names = brute_rows(rows)
    assert got == sorted([(rows[i][0], len(sets[i]), names[g]) for g, members in groups.items() for i in members], key=repr)
    assert (None, 26, 7) in got and (None, 57, 5) in got and (None, 1, None) in got
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(5, text), (7, other + " end"), (7, third), (None, None), (None, "x"), (8, "")], key=repr)
    alone = spark.createDataFrame([(5, text), (None, near), (None, other)], "doc_id long, text string")
    assert sorted([(r.doc_id, r.text) for r in keep_first(alone).collect()], key=repr) == [(5, text), (None, other)]


def test_jaccard_rounds_lose_no_link(spark):
    """Near copies of a few texts, many unlike one another, over all rounds."""
    rng = random.Random(4)
    texts, at = {}, 0
    for k in range(3):
        base = [f"{k}x{i}" for i in range(150)]
        for _ in range(70):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            texts[at] = " ".join(words)
            at += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()} == brute_components(texts)


def test_bounds_on_prefixes_and_bits_lose_no_pair():
    import numpy as np

    from shroud.llm.jaccard_join import NUM, DEN, parity

    rng = np.random.default_rng(8)
    alike = 0
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        x = rng.choice(400, n, replace=False)
        y = np.unique(np.concatenate([x[rng.random(n) > rng.random() * 0.2], rng.choice(400, int(rng.integers(0, 1 + n // 5)))]))
        x, m = np.sort(x), len(y)
        common = len(np.intersect1d(x, y))
        if not m or DEN * common < NUM * (n + m - common):
            continue
        alike += 1
        need = -(-NUM * (n + m) // (NUM + DEN))
        least = need - (-(-NUM * max(n, m) // DEN) - 1)
        assert len(np.intersect1d(x[: prefix_length(n)], y[: prefix_length(m)])) >= least
        bits = [np.unpackbits(b.view("uint8")) for b in parity([x.astype("uint64"), y.astype("uint64")])]
        assert (bits[0] != bits[1]).sum() <= n + m - 2 * common <= n + m - 2 * need
    assert alike > 500


def test_bounds_and_tree():
    import numpy as np

    for n in range(1, 60):
        for m in range(n, 60):
            o = least_overlap(n, m)
            assert 5 * o >= 4 * (n + m - o) and not 5 * (o - 1) >= 4 * (n + m - o + 1)
            if o <= n:
                assert prefix_length(n) + o > n  # what overlaps enough can't lie beyond the prefix alone
    rng = np.random.default_rng(1)
    pivot = np.arange(100, dtype="uint64")
    members = [np.concatenate([pivot[rng.random(100) > 0.1], np.arange(1000 + 50 * i, 1000 + 50 * i + rng.integers(0, 20), dtype="uint64")]) for i in range(50)]
    want = [i for i, s in enumerate(members) if 5 * len(np.intersect1d(pivot, s)) >= 4 * len(np.union1d(pivot, s))]
    assert sorted(tree_join(pivot, members)) == want
