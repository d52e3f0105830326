"""The two dictionaries of the engine: pseudonyms (``mapping``) and what the scrubber replaces (``lookups``).

Both are Parquet tables below a state folder. Every commit adds files and then swaps one small pointer file, so a
reader sees the state before or after it, never in between. There is one writer at a time.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAPPING = "entity string, norm string, raw string, token string, n long"
LOOKUPS = "file_id string, column string, surface string, replacement string, multiword boolean, seq long"
#: One span of the scrubber: letters and digits, inside also joiners; the ends are trimmed.
SPAN = r"[0-9A-Za-z가-힣](?:[0-9A-Za-z가-힣@.+\-_]*[0-9A-Za-z가-힣])?"
#: New keys of one batch up to which a window of one task per entity numbers them; beyond, numbering is spread.
WINDOW_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master or "").partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="shroud-")


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class State:
    """Versioned state below ``root`` (a path or URI of any Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files --

    def read_text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Replace a file in one step."""
        fresh, path = self._path(f"{self.root}/{name}.new"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(path.getParent())
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()) if path.toUri().getScheme() else self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, path, options)

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # -- tables --

    def manifest(self) -> dict:
        return json.loads(self.read_text("CURRENT") or '{"version": 0, "mapping": [], "lookups": [], "forgotten": [], "seq": 0}')

    def mapping(self) -> DataFrame:
        return self._table("mapping", MAPPING)

    def _table(self, name: str, schema: str) -> DataFrame:
        parts = self.manifest()[name]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in parts])

    def lookups(self) -> DataFrame:
        """Live rows: the latest for each (file, column, surface), without what was forgotten since."""
        rows = self._table("lookups", LOOKUPS)
        for f in self.manifest()["forgotten"]:
            match = (F.col("file_id") == f["file_id"]) & (F.col("column") == f["column"] if f["column"] is not None else F.lit(True))
            rows = rows.where(~(match & (F.col("seq") <= f["seq"])))
        last = F.max_by(F.struct("replacement", "multiword", "seq"), "seq").alias("last")
        return rows.groupBy("file_id", "column", "surface").agg(last).select("file_id", "column", "surface", "last.*")

    def commit(self, mapping: DataFrame | None = None, lookups: DataFrame | None = None, forget: Iterable[tuple[str, str | None]] = ()) -> None:
        """Add rows. ``forget`` (file, column or all) takes effect on what was there before."""
        m = self.manifest()
        version = m["version"] + 1
        m["forgotten"] += [{"file_id": f, "column": c, "seq": m["seq"]} for f, c in forget]
        for name, rows in (("mapping", mapping), ("lookups", lookups)):
            if rows is not None:
                part = f"v{version:08d}"
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{part}")
                m[name].append(part)
        m["version"] = version
        if lookups is not None:
            m["seq"] = max(m["seq"], self.spark.read.parquet(f"{self.root}/lookups/v{version:08d}").agg(F.max("seq")).first()[0] or 0)
        self.write_text("CURRENT", json.dumps(m))

    def add_lookups(self, rows: DataFrame, mapping: DataFrame | None = None, forget: Iterable[tuple[str, str | None]] = ()) -> None:
        """Upsert (file_id, column, surface, replacement, place): ``place`` orders rows of this batch."""
        base = self.manifest()["seq"]
        self.commit(mapping=mapping, lookups=lookup_rows(rows, base), forget=forget)

    def reveal(self, token: str) -> str | None:
        row = self.mapping().where(F.col("token") == token).select("raw").first()
        return row.raw if row else None


def lookup_rows(rows: DataFrame, base: int = 0) -> DataFrame:
    """Rows as ``lookups`` keeps them: trimmed surfaces, the multiword mark, numbers in order of ``place``; the last of equals."""
    surface = F.regexp_replace("surface", r"(?U)^\s+|\s+$", "")
    rows = rows.select("file_id", "column", surface.alias("surface"), "replacement", "place").where("surface <> ''")
    rows = rows.groupBy("file_id", "column", "surface").agg(F.max_by("replacement", "place").alias("replacement"), F.max("place").alias("place"))
    rows = number(rows, [], "place", "seq")
    return rows.select("file_id", "column", "surface", "replacement", (~F.col("surface").rlike(f"^(?:{SPAN})$")).alias("multiword"), (F.col("seq") + base).alias("seq"))


def number(df: DataFrame, by: list[str], order: str, into: str) -> DataFrame:
    """``df`` with a number from 1 on within each group, in the given order.

    Up to ``WINDOW_KEYS`` rows a window does it. Beyond, rows are range-partitioned by group and order, numbered within their
    range, and moved on by the sizes of the ranges before: a hot group spreads over tasks, and the driver gets one row
    for each range and group.
    """
    df = cut(df)
    if df.limit(WINDOW_KEYS + 1).count() <= WINDOW_KEYS:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)).cast("long"))
    ranged = cut(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.broadcast(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    local = F.row_number().over(Window.partitionBy("_range", *by).orderBy(order))
    return ranged.withColumn(into, local.cast("long")).join(moved, ["_range", *by]).withColumn(into, F.col(into) + F.col("_before")).drop("_range", "_before")


def token_of(entity: Column, n: Column) -> Column:
    """Six digits at least; larger numbers have more."""
    return F.concat(entity, F.lit("_"), F.when(n < 1_000_000, F.lpad(n.cast("string"), 6, "0")).otherwise(n.cast("string")))


def allocate(keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """New mapping rows for the keys (entity, norm, raw, seen) that the mapping lacks, numbered in order of ``seen``.

    Keys are made distinct first; the raw form is the one seen first.
    """
    fresh = keys.groupBy("entity", "norm").agg(F.min_by("raw", "seen").alias("raw"), F.min("seen").alias("seen"))
    fresh = fresh.join(mapping.select("entity", "norm"), ["entity", "norm"], "left_anti")
    used = mapping.groupBy("entity").agg(F.max("n").alias("used"))
    fresh = number(fresh, ["entity"], "seen", "k").join(F.broadcast(used), "entity", "left")
    n = F.col("k") + F.coalesce("used", F.lit(0))
    return fresh.select("entity", "norm", "raw", token_of(F.col("entity"), n).alias("token"), n.cast("long").alias("n"))
