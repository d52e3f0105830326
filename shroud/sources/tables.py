"""Files as Spark tables of text columns.

A table's physical columns are ``c1`` to ``cN`` and ``_ord``, the place of the row; the names shown, which may repeat, are kept
beside. Any number of files is read by one distributed job (``read_cells``); large regular files have native readers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import parse
from .parse import NotTabular

CELLS = "path string, table_idx int, name string, ord long, cells array<string>, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("table_idx", pa.int32()), ("name", pa.string()), ("ord", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


@dataclass
class Table:
    name: str
    columns: list[str]
    df: DataFrame  # _ord, c1 .. cN

    @property
    def physical(self) -> list[str]:
        return [f"c{i}" for i in range(1, len(self.columns) + 1)]

    def count(self) -> int:
        return self.df.count()


def cells_of(path: str, raw: bytes) -> Iterator[tuple]:
    """Rows of all tables of a file, each table's names as row -1; or one row with the error."""
    try:
        for i, g in enumerate(parse.grids(path, raw)):
            yield path, i, g.name, -1, g.columns, None
            for k, row in enumerate(g.rows):
                yield path, i, g.name, k, row, None
    except Exception as e:
        yield path, -1, None, -1, None, f"{type(e).__name__}: {e}"


def parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch["path"].to_pylist(), batch["content"]):
            rows = []
            for row in cells_of(path, raw.as_py()):
                rows.append(row)
                if len(rows) == 5000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def read_cells(spark: SparkSession, *paths: str) -> DataFrame:
    """All cells of any number of files, by one job; a file that can't be read gives one row with its error."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(parse_files, CELLS)


class TableSource(DataSource):
    """``spark.read.format("shroud").load(path)``: the cells of one or more files, a partition each."""

    @classmethod
    def name(cls) -> str:
        return "shroud"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


class _FileReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.value) if "://" in partition.value else (fs.LocalFileSystem(), partition.value)
        with store.open_input_stream(path) as f:
            yield from cells_of(partition.value, f.read())


def read_tables(spark: SparkSession, path: str) -> list[Table]:
    """The tables of one file; raises ``NotTabular`` or ``ValueError`` as the parsers do."""
    if not parse.is_data_file(path):
        raise ValueError(f"unsupported file type: .{parse.extension(path)}")
    from ..operators.dictionary import cut

    cells = cut(read_cells(spark, path))  # one parse, and a snapshot if the file changes
    heads = cells.where("ord = -1").orderBy("table_idx").collect()
    if not heads:  # Spark passes over files without a byte
        nothing = spark.createDataFrame([], CELLS)
        return [from_cells(nothing, g.name, g.columns) for g in parse.grids(path, b"")]
    if heads[0].error:
        kind, _, text = heads[0].error.partition(": ")
        raise (NotTabular if kind == "NotTabular" else ValueError)(text)
    return [from_cells(cells.where((F.col("table_idx") == h.table_idx) & (F.col("ord") >= 0)), h.name, list(h.cells)) for h in heads]


def from_cells(rows: DataFrame, name: str, columns: list[str]) -> Table:
    picked = [F.col("cells")[i].alias(f"c{i + 1}") for i in range(len(columns))]
    return Table(name, columns, rows.select(F.col("ord").alias("_ord"), *picked))


def from_dataframe(name: str, df: DataFrame, order: str, columns: list[str] | None = None) -> Table:
    """A table of any DataFrame: all columns as text, empty text as null, rows in the order of a unique column."""
    names = columns or [c for c in df.columns if c != order]
    texts = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(names, 1)]
    return Table(name, names, df.select(F.col(order).cast("long").alias("_ord"), *texts))


# ---- native readers for large regular files: splittable, every row with as many cells as the header ----


def read_delimited_native(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.option("sep", separator).option("header", True).option("multiLine", False).option("escape", "\"").option("inferSchema", False).csv(path)


def read_json_lines_native(spark: SparkSession, path: str) -> DataFrame:
    """Columns in order of the keys' first appearance, values as text."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    fields = lines.select(F.from_json("value", "map<string,string>").alias("m"))
    keys = fields.select(F.posexplode(F.map_keys("m"))).groupBy("col").agg(F.count("*").alias("n"), F.avg("pos").alias("pos"))
    order = [r.col for r in keys.orderBy("pos", "col").collect()]  # one row for each column
    return fields.select(*[F.element_at("m", F.lit(k)).alias(k) for k in order])


# ---- files of a project ----

# Folders that are not looked into, and the limits of a scan.
SKIPPED = (
    ".git", ".shroud", "node_modules", ".venv", "venv", "env", "__pycache__", "dist", "build", "site-packages",
    ".tox", ".mypy_cache", ".pytest_cache", ".claude",
)
MAX_FILES, MAX_BYTES = 2000, 200 * 1024 * 1024


def data_files(spark: SparkSession, root: str, skipped=SKIPPED, most: int = MAX_BYTES) -> DataFrame:
    """path, length, modified of the data files below a folder, tables before JSON. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(e + "," + e.upper() for e in parse.EXTENSIONS) + "}").load(root)
    inside = F.array_except(F.split(F.col("path"), "/"), F.array(*[F.lit(s) for s in skipped]))
    kept = files.select("path", "length", F.col("modificationTime").alias("modified")).where((F.size(inside) == F.size(F.array_distinct(F.split("path", "/")))) & (F.col("length") <= most))
    return kept.withColumn("last", F.lower("path").rlike(r"\.jsonl?$")).orderBy("last", "path").drop("last")
