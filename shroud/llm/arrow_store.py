"""Token ids in Arrow files with fixed-size-list batches.

Documents in ascending order of id are dealt into ranges; each range writes one Arrow file of equal-length sequences
(``fixed_size_list[1024]`` of ids, as wide as the vocabulary needs, and the mask, a byte for each id, 64 sequences a batch), which a reader
can map into memory and address without copying, and one Arrow file with the documents' places in that stream. Masks are a dictionary of
``fixed_size_list<uint8>[1024]``: all sequences of a file but the last share the full mask, so a file holds at most two of them, and a
sequence's mask is a view of its entry (Arrow joins the two, 2 KB, when it opens a file that has both). A file's
name has its task's attempt in it, and only files named in the written manifest are read, so retried and speculative
tasks do no harm. Folders are URIs of any store that Arrow opens; Spark's names for object stores (``s3a``, ``s3n``) are understood.

Defined results: null text is empty and has only the end id; an empty table gives no files and an empty result; equal
ids are ordered by a hash of the text, then by text, and a repeated row is stored again; null ids come first; a text of any length goes on over
as many sequences as it needs; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, slices
from .tokens import BYTES, SLICE, encoder, release_unused

LENGTH = 1024  # ids in a sequence
ROWS = 64  # sequences in a batch
MANIFEST = "part int, seq_uri string, doc_uri string, n_tokens long, n_docs long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), length)))])


def _open(uri: str):
    """File system and path of a URI as Spark writes it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def _sequences(ids: np.ndarray, length: int) -> pa.RecordBatch:
    rows = -(-len(ids) // length)
    full = np.zeros(rows * length, ids.dtype)
    full[: len(ids)] = ids
    masks, which = np.ones(length, "uint8"), np.zeros(rows, "int32")
    if last := len(ids) % length:
        masks = np.concatenate([masks, (np.arange(length) < last).astype("uint8")])
        which[-1] = 1
    mask = pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(pa.array(masks), length))
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(full), length), mask], schema=_schema(length, ids.dtype.itemsize == 4))


def _unpadded(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch that its masks keep."""
    mask = batch["mask"]
    masks = mask.dictionary.values.to_numpy().view(bool).reshape(len(mask.dictionary), -1)
    return batch["ids"].values.to_numpy()[masks[mask.indices.to_numpy()].reshape(-1)]


def _writer(folder: str, vocabulary: str, end_id: int, length: int, special: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        words = encoder(vocabulary, True, special)
        width = "uint16" if max(words.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "uint32"
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, path = _open(f"{name}.seq.arrow")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        rest, n_tokens, n_docs = np.zeros(0, width), 0, 0
        with store.open_output_stream(path) as a, store.open_output_stream(path.replace(".seq.", ".doc.")) as b:
            with pa.ipc.new_file(a, _schema(length, width == "uint32"), options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)) as seqs, pa.ipc.new_file(b, DOCS) as docs:
                for batch in batches:
                    for part in slices(batch, "text", SLICE, BYTES):
                        ids, ends = words.encode(part["text"])
                        ids = np.insert(ids, ends, end_id).astype(width)
                        ends = ends + np.arange(1, len(ends) + 1)
                        starts = np.concatenate([[0], ends[:-1]])
                        docs.write_batch(pa.record_batch([part["doc_id"], pa.array(starts + n_tokens), pa.array(ends - starts)], schema=DOCS))
                        n_tokens += len(ids)
                        n_docs += part.num_rows
                        rest = np.concatenate([rest, ids])
                        while len(rest) >= ROWS * length:
                            seqs.write_batch(_sequences(rest[: ROWS * length], length))
                            rest = rest[ROWS * length :]
                if len(rest):
                    seqs.write_batch(_sequences(rest, length))
        release_unused()
        if n_docs:
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"{name}.seq.arrow"]), pa.array([f"{name}.doc.arrow"]), pa.array([n_tokens]), pa.array([n_docs])], names=["part", "seq_uri", "doc_uri", "n_tokens", "n_docs"])

    return write


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Write the files below ``folder`` (a URI that all executors reach); returns the manifest, a row for each file pair."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.xxhash64(F.col(quoted(text_col))).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return cut(rows.mapInArrow(_writer(folder, vocabulary, end_id, length, special), MANIFEST))


def sequence(uri: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence, by its place in a file: views, nothing is copied."""
    path = _open(uri)[1]
    with pa.ipc.open_file(pa.memory_map(path)) as file:
        batch = file.get_batch(row // ROWS)
        mask = batch["mask"]
        return batch["ids"][row % ROWS].values.to_numpy(), mask.dictionary[mask.indices[row % ROWS].as_py()].values.to_numpy()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seq_uri, doc_uri, base in zip(batch["seq_uri"].to_pylist(), batch["doc_uri"].to_pylist(), batch["base"].to_pylist()):
            store, path = _open(seq_uri)
            with store.open_input_file(path) as a, store.open_input_file(_open(doc_uri)[1]) as b:
                seqs, docs = pa.ipc.open_file(a), pa.ipc.open_file(b)
                stream = (_unpadded(seqs.get_batch(i)) for i in range(seqs.num_record_batches))
                have = np.zeros(0, "uint16")
                for i in range(docs.num_record_batches):
                    doc = docs.get_batch(i)
                    sizes, crcs = doc["n_tokens"].to_numpy(), []
                    for n in sizes.tolist():
                        crc = 0
                        while n > len(have):
                            crc = zlib.crc32(have.astype("<u4").tobytes(), crc)
                            n -= len(have)
                            have = next(stream)
                        crcs.append(zlib.crc32(have[:n].astype("<u4").tobytes(), crc))
                        have = have[n:]
                    yield pa.record_batch([doc["doc_id"], pa.array(doc["start"].to_numpy() + base), doc["n_tokens"], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    The driver holds one row for each file, to place the files in the whole stream.
    """
    spark = manifest.sparkSession
    files = manifest.orderBy("part").collect()
    base, rows = 0, []
    for f in files:
        rows.append((f.part, f.seq_uri, f.doc_uri, base))
        base += f.n_tokens
    parts = spark.createDataFrame(rows, "part int, seq_uri string, doc_uri string, base long").repartition(max(1, len(rows)))
    return parts.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
