"""Tables to files: exact single files for people, part files for clusters."""

from __future__ import annotations

import csv
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parse import extension
from .tables import Table


def unique_names(columns: list[str]) -> list[str]:
    """Names for records: a repeated name gets a number, so no column is lost."""
    seen, out = set(), []
    for c in columns:
        name, n = c, 2
        while name in seen:
            name, n = f"{c}_{n}", n + 1
        seen.add(name)
        out.append(name)
    return out


def write_table(table: Table, path: str | Path) -> None:
    """One file by its extension; rows stream through the driver, a partition at a time."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = table.df.orderBy("_ord").select(*table.physical).toLocalIterator()
    kind = extension(str(path))
    if kind in ("json", "jsonl"):
        names = unique_names(table.columns)
        texts = (json.dumps(dict(zip(names, r)), ensure_ascii=False, indent=1 if kind == "json" else None) for r in rows)
        with path.open("w", encoding="utf-8") as f:
            if kind == "jsonl":
                f.writelines(f"{t}\n" for t in texts)
            else:
                any_row = False
                for t in texts:
                    f.write((",\n" if any_row else "[\n") + " " + t.replace("\n", "\n "))
                    any_row = True
                f.write("\n]" if any_row else "[]")
        return
    with path.open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter="\t" if kind == "tsv" else ",")
        out.writerow(table.columns)
        out.writerows(["" if c is None else c for c in r] for r in rows)


def write_parts(table: Table, path: str, kind: str = "csv") -> None:
    """Part files written by the executors; names are the shown ones, made unique."""
    df = table.df.select(*[F.col(p).alias(n) for p, n in zip(table.physical, unique_names(table.columns))])
    if kind in ("csv", "tsv"):
        df.write.mode("overwrite").option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("lineSep", "\r\n").option("emptyValue", "").option("escape", "\"").csv(path)
    elif kind in ("json", "jsonl"):
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def json_records(df: DataFrame) -> DataFrame:
    """Rows as JSON text, null fields kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def safe_name(name: str, taken: set[str]) -> str:
    """A sheet's name as a file name that stays in its folder and differs from those taken, whatever their case."""
    base = re.sub(r"[^\w\- ]", "_", name).strip(" ._") or "sheet"
    free, n = base, 1
    while free.lower() in taken:
        n += 1
        free = f"{base}_{n}"
    taken.add(free.lower())
    return free


def output_paths(root: Path, rel: str, names: list[str]) -> tuple[list[Path], Path]:
    """Where the copies of a file's tables go, and what to read: the copy, or an index of several."""
    copy = Path(root) / ".shroud" / "out" / rel
    if len(names) == 1 and extension(rel) != "xlsx":
        return [copy], copy
    taken: set[str] = set()
    folder = copy.with_name(f"{copy.name}.sheets")
    return [folder / f"{safe_name(n, taken)}.csv" for n in names], copy.with_name(f"{copy.name}.md")


def write_index(path: Path, rel: str, copies: list[str]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([f"# Copy of `{rel}` without personal data", "", "One file for each sheet or table:", "", *(f"- `{c}`" for c in copies), ""]), encoding="utf-8")
