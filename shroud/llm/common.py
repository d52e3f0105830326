"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
#: ASCII white space as the contracts of the operators define it: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return named or held.get()
    if not named and not (spark.sparkContext.master or "").partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="shroud-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession):
    """What runs in here sends Python batches of ``BATCH_BYTES`` at most, as the JVM and the worker hold several each; results are the same."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more, rather than when the driver's memory fills.

    Python tells the JVM of dropped references by a thread of its own, which has to come first.
    """
    gc.collect()
    told = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    for _ in range(2):  # on a busy machine the last reference may be told after the first collection
        for _ in range(30):
            if not told:
                break
            time.sleep(0.1)
        time.sleep(0.5)
        spark._jvm.System.gc()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder, as a URI that executors can write to."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """A new folder below the shared folder, which goes in the end, whatever happens."""
    folder = scratch_dir(spark)
    try:
        yield folder
    finally:
        remove_dir(spark, folder)


def remove_dir(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name as Spark takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of our own that clash with none of the table's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch, column: str, rows: int, most: int = 16 << 20):
    """Slices of an Arrow batch of so many rows and bytes of text at most; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype("int64"))
    lo = 0
    while lo < batch.num_rows:
        before = total[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(total, before + most, "right")), lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
