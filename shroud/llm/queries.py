"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from .arrow_store import read_documents, write_tokens
from .common import cut, read, scratch
from .exact_dedup import ORACLE as EXACT_SQL
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_documents
from .jaccard_join import ORACLE as JACCARD_SQL
from .jaccard_join import jaccard_components
from .language import identify
from .packing import pack
from .quality import classify
from .spans import substring_dedup
from .suffix_pieces import encode_digests
from .url_templates import judge_urls
from .url_templates import oracle as url_sql


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_spans(spark, sf_dir):
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op2_suffix_array_pieces(spark, sf_dir):
    return encode_digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_additive_quality(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_crf_language(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))


def op5_prefix_fingerprints(spark, sf_dir):
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_arrow_store(spark, sf_dir):
    with scratch(spark) as folder:
        manifest = write_tokens(read(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
        return cut(read_documents(manifest))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"))


def op10_url_templates(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_sentence_spans, op2_suffix_array_pieces, op3_additive_quality, op4_crf_language, op5_prefix_fingerprints, op6_exact_dedup, op7_packing, op8_arrow_store, op9_jaccard_join, op10_url_templates)}
ORACLE = {"op9_jaccard_join": JACCARD_SQL, "op6_exact_dedup": EXACT_SQL, "op10_url_templates": url_sql()}
