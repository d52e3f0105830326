"""Exact deduplication by sorting content.

Texts are normalised (null is empty, each run of ASCII white space becomes one space) and dealt into ranges by
sampled splitters over the first bytes of the normalised text; the text's hash and the identifier follow in the
key, so that a group of copies of any size spreads over many ranges. Each range is sorted externally by Spark,
equal texts stand next to each other, and neighbours are compared in full. A run of equal texts that touches a
border of its range may go on in another range: the at most few runs at the borders carry their text and are
glued by a grouping on that full text.

Defined results: null text equals empty text; repeated rows (same id and text) form one group of which one row
stays; a null id sorts last and stays only if its whole group has null ids; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, free_names, quoted

NO_ID = 2**63 - 1
RUNS = "doc_id long, pid int, run long, head boolean, run_min long, run_len long, text_sha256 string, edge_text string"


class _Run:
    def __init__(self, key: int, text: str):
        self.key, self.text, self.ids = key, text, []


def _emit(run: _Run, number: int, pid: int, edge: bool) -> pa.RecordBatch:
    ids = np.concatenate(run.ids)
    n = len(ids)
    sha = hashlib.sha256(run.text.encode()).hexdigest()
    return [ids, np.full(n, pid, "int32"), np.full(n, number), np.arange(n) == 0, np.full(n, ids[0]), np.full(n, n), [sha] * n, [run.text if edge else None] + [None] * (n - 1)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("pid", pa.int32()), ("run", pa.int64()), ("head", pa.bool_()), ("run_min", pa.int64()), ("run_len", pa.int64()), ("text_sha256", pa.string()), ("edge_text", pa.string())])


def _batch(parts: list) -> pa.RecordBatch:
    cols = [np.concatenate([p[i] for p in parts]) if isinstance(parts[0][i], np.ndarray) else [x for p in parts for x in p[i]] for i in range(len(_SCHEMA))]
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range with the run of equal neighbours that each lies in."""
    pid = TaskContext.get().partitionId()
    first_key, number, held, out, rows = None, 0, [], [], 0  # held: the runs whose key is the latest
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, text, keys = batch["doc_id"].to_numpy(), batch["norm"], batch["h"].to_numpy()
        same = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False) if len(ids) > 1 else np.zeros(0, bool)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        for lo, hi in zip(starts, [*starts[1:], len(ids)]):
            key, value = int(keys[lo]), text[lo].as_py()
            first_key = key if first_key is None else first_key
            if held and held[-1].text == value:
                held[-1].ids.append(ids[lo:hi])
                continue
            if held and held[-1].key != key:
                for run in held:
                    out.append(_emit(run, number, pid, run.key == first_key))
                    rows += len(out[-1][0])
                    number += 1
                held = []
                if rows > 4000:
                    yield _batch(out)
                    out, rows = [], 0
            held.append(_Run(key, value))
            held[-1].ids.append(ids[lo:hi])
    for run in held:
        out.append(_emit(run, number, pid, True))
        number += 1
    if out:
        yield _batch(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    norm = F.regexp_replace(F.coalesce(F.col(quoted(text_col)), F.lit("")), SPACE, " ")
    rows = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("doc_id"), norm.alias("norm"))
    rows = rows.select("doc_id", "norm", F.substring("norm", 1, 32).alias("lead"), F.xxhash64("norm").alias("h"))
    rows = rows.repartitionByRange("lead", "h", "doc_id").sortWithinPartitions("lead", "h", "norm", "doc_id")
    runs = cut(rows.select("doc_id", "norm", "h").mapInArrow(_runs, RUNS))
    # At most a few runs a range: their texts are glued in full, and the result is small enough to broadcast.
    edges = runs.where("edge_text is not null").groupBy("edge_text").agg(F.min("run_min").alias("g_min"), F.sum("run_len").alias("g_len"), F.min(F.struct("pid", "run")).alias("g_first"), F.collect_list(F.struct("pid", "run")).alias("parts"))
    edges = edges.select("g_min", "g_len", "g_first", F.explode("parts").alias("p")).select(F.col("p.pid").alias("pid"), F.col("p.run").alias("run"), "g_min", "g_len", F.col("g_first") == F.col("p"))
    edges = edges.toDF("pid", "run", "g_min", "g_len", "g_is_first")
    out = runs.join(F.broadcast(edges), ["pid", "run"], "left")
    keep, ident = F.coalesce("g_min", "run_min"), F.col("doc_id")
    return out.select(
        F.nullif(ident, F.lit(NO_ID)).alias("doc_id"),
        F.nullif(keep, F.lit(NO_ID)).alias("keep_id"),
        F.coalesce("g_len", "run_len").alias("group_size"),
        (F.col("head") & F.coalesce("g_is_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows with one id (or none) whose normalised texts are equal, one stays: that whose columns are least as JSON.
    """
    out = exact_dedup(docs, id_col, text_col)
    kept = cut(out.where("kept").select("doc_id", "text_sha256"))
    ident, sha, place = free_names(docs, "id", "sha", "place")
    names = [F.col(quoted(c)) for c in docs.columns]
    rows = docs.withColumn(ident, F.col(quoted(id_col)).cast("long"))
    by_id = rows.groupBy(ident).count().where("count > 1")
    kept = kept.toDF("keep_id", "keep_sha")
    if by_id.isEmpty():
        return rows.join(kept, rows[ident].eqNullSafe(kept["keep_id"]), "left_semi").select(*names)
    # The sha is a column before the join, so that both know it: equal ids may differ in white space only.
    norm = F.regexp_replace(F.coalesce(F.col(quoted(text_col)), F.lit("")), SPACE, " ")
    rows = rows.withColumn(sha, F.sha2(norm.cast("binary"), 256))
    rows = rows.join(kept, rows[ident].eqNullSafe(kept["keep_id"]) & (rows[sha] == kept["keep_sha"]), "left_semi")
    by = Window.partitionBy(ident, sha).orderBy(F.to_json(F.struct(*names)))
    return rows.withColumn(place, F.row_number().over(by)).where(F.col(place) == 1).select(*names)


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
