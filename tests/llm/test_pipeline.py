"""The whole pipeline against a brute-force version of each stage, on odd tables."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from test_dedup import brute_rows, brute_spans, normal  # noqa: E402
from test_tokens import check_packing  # noqa: E402

import corpus_pipeline  # noqa: E402
from shroud.llm.quality import classify, keep_good  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Documents with extra, dotted and clashing columns, and labels that call documents of few words bad."""
    out = str(tmp_path_factory.mktemp("sf"))
    rows = docs.withColumnsRenamed({"source": "so.urce", "score": "n_removed", "lang": "row"})
    rows.write.parquet(f"{out}/documents.parquet")
    docs.selectExpr("doc_id", "cast(length(coalesce(text, '')) > 20 as int) as quality", "0 as toxic").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_equal_their_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, steps, at = docs.columns, dict(corpus_pipeline.STAGES), docs
    assert list(steps) == ["quality", "exact", "near", "passages", "packing"]
    good = {r.doc_id for r in classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    said = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    assert 30 < len(said) < docs.count()
    first = {}
    for i, t in sorted(said.items()):
        first.setdefault(normal(t), i)
    exact = {i: said[i] for i in first.values()}
    _, groups, labels = brute_rows(list(exact.items()))
    near = {i: exact[i] for i in labels.values()}
    passages = {i: t for i, (t, _) in brute_spans(near).items()}
    for name, want in (("quality", said), ("exact", exact), ("near", near), ("passages", passages)):
        steps[name](spark, at, folder).write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        assert at.columns == names and at.schema == docs.schema, name
        assert {r.doc_id: r.text for r in at.collect()} == want, name
    assert at.where("n_chars <> length(text) or n_removed <> 0.5").count() == 0
    packed = steps["packing"](spark, at, folder).collect()
    check_packing(packed, passages)
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_empty_and_narrow_tables(spark, docs, folder, tmp_path):
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for names in (["doc_id", "text"], ["text", "doc_id"]):
        kept = keep_good(docs.select(*names), labels)
        assert kept.columns == names
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in classify(docs, labels).where("predicted = 1").collect()}


def test_odd_ids(spark, repeated, folder):
    """Repeated rows and null ids go through every stage; what the brute-force versions call copies is gone."""
    at = repeated.where("length(text) > 20")
    count = len({normal(r.text) for r in at.collect()})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        at = stage(spark, at, folder)
        assert re.fullmatch("doc_id,text,lang,source,n_chars,score,h", ",".join(at.columns))
        if name == "exact":
            assert at.count() == count
    _, groups, _ = brute_rows([(r.doc_id, r.text) for r in corpus_pipeline.exact(spark, repeated.where("length(text) > 20"), folder).collect()])
    assert at.count() == len(groups)
