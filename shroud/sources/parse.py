"""Bytes of one file to tables of text cells: what delimited files, JSON, JSON lines and workbooks have in common."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

# File types, and the encodings to try.
EXTENSIONS = ("csv", "tsv", "xlsx", "json", "jsonl")
ENCODINGS = ("utf-8-sig", "cp949", "latin-1")


class NotTabular(ValueError):
    """A file of a known type that holds no table, such as a configuration."""


@dataclass
class Grid:
    """One table as parsed."""

    name: str
    columns: list[str]
    rows: list[list[str | None]]


def extension(path: str) -> str:
    return path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""


def is_data_file(path: str) -> bool:
    return path.lower().endswith(tuple(f".{e}" for e in EXTENSIONS))


def stem(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[0] or name


def decode(raw: bytes) -> str:
    """The first encoding that fits; the last one always does."""
    for name in ENCODINGS[:-1]:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode(ENCODINGS[-1])


def cell(value) -> str | None:
    """The text of a value: null and empty are null, nested values are JSON, numbers without a needless fraction."""
    match value:
        case None | "":
            return None
        case str():
            return value
        case bool():
            return str(value).lower()
        case float() if value.is_integer():
            return str(int(value))
        case int() | float():
            return str(value)
    return json.dumps(value, ensure_ascii=False)


def fit(row: list, width: int) -> list:
    return row[:width] + [None] * (width - len(row))


def named(header: Iterable[str | None], width: int) -> list[str]:
    """Column names for ``width`` columns, by place where there is none."""
    return [h if h else f"col_{i}" for i, h in enumerate(fit(list(header), width), 1)]


def _grid(name: str, header: list, rows: list[list]) -> Grid:
    width = max([len(header), *map(len, rows)])
    return Grid(name, named(header, width), [fit(r, width) for r in rows])


def delimited(name: str, text: str, separator: str) -> list[Grid]:
    csv.field_size_limit(1 << 30)
    lines = [[cell(c) for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if row]
    return [_grid(name, lines[0], lines[1:]) if lines else Grid(name, [], [])]


def _all(kind: type, values) -> bool:
    return all(isinstance(v, kind) for v in values)


def records(name: str, values: list) -> Grid:
    if len(values) < 2 or not _all(dict, values):
        raise NotTabular(f"{name} holds fewer than two objects, or other values among them")
    columns = list(dict.fromkeys(k for v in values for k in v))
    return Grid(name, columns, [[cell(v.get(c)) for c in columns] for v in values])


def _lists(name: str, values: list[list], columns: list | None) -> Grid:
    header = [str(c) for c in columns or []]
    width = max([len(header), *map(len, values)])
    header += [f"col_{i + 1}" for i in range(len(header), width)]
    return Grid(name, header, [fit([cell(c) for c in v], width) for v in values])


def json_grid(name: str, value) -> Grid | None:
    """A table if the value has the shape of one: split, lists, records, or records by key; in this order."""
    if isinstance(value, dict):
        data = value.get("data")
        if value.keys() <= {"columns", "index", "data"} and isinstance(data, list) and data and _all(list, data):
            columns = value.get("columns")
            return _lists(name, data, columns if isinstance(columns, list) else None)
        if len(value) >= 2 and _all(dict, value.values()):
            key = "_key"
            while any(key in v for v in value.values()):
                key = f"_{key}"
            return records(name, [{key: k} | v for k, v in value.items()])
    elif isinstance(value, list) and len(value) >= 2:
        if _all(list, value):
            return _lists(name, value, None)
        if _all(dict, value):
            return records(name, value)
    return None


def whole_json(name: str, text: str) -> list[Grid]:
    value = json.loads(text)
    if one := json_grid(name, value):
        return [one]
    found = [g for k, v in value.items() if (g := json_grid(str(k), v))] if isinstance(value, dict) else []
    if not found:
        raise NotTabular(f"nothing in {name} has the shape of a table")
    return found


def json_values(kind: str, text: str) -> Iterator:
    """The values of a JSON file, or of the lines of one that can be read."""
    if kind != "jsonl":
        yield json.loads(text)
        return
    for line in filter(str.strip, text.splitlines()):
        with suppress(ValueError):
            yield json.loads(line)


def json_lines(name: str, text: str) -> list[Grid]:
    return [records(name, [json.loads(line) for line in text.splitlines() if line.strip()])]


# ---- workbooks ----

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats that come with the program and show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), 45, 46, 47])
_NUMBER = re.compile(r"-?[\d.]+(?:E[-+]?\d+)?", re.I)


def safe_xml(raw: bytes) -> ElementTree.Element:
    """Parse a part; one with a document type or an entity is refused, as it could expand without bounds."""
    upper = raw.upper()
    if b"<!DOCTYPE" in upper[:4096] or b"<!ENTITY" in upper:
        raise ValueError("a part of the workbook declares a document type")
    return ElementTree.fromstring(raw)


def rich_text(node: ElementTree.Element | None) -> str:
    """Text and runs of a string; readings given for it are not part of it."""
    if node is None:
        return ""
    texts = []
    for child in node:
        if child.tag == f"{MAIN}t":
            texts.append(child)
        elif child.tag == f"{MAIN}r":
            texts += child.iterfind(f"{MAIN}t")
    return "".join(t.text or "" for t in texts)


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + "ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(letter) + 1
    return n - 1


def shows_date(code: str) -> bool:
    """Whether a format code has a year, month or day outside quoted, bracketed and escaped text."""
    bare = re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", code).lower()
    return "general" not in bare and any(c in bare for c in "ymd")


def date_text(serial: float, from_1904: bool) -> str:
    when = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(days=serial)
    return f"{when:%Y-%m-%d}" if serial == int(serial) else f"{when:%Y-%m-%d %H:%M:%S}"


class Workbook:
    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.parts = set(self.zip.namelist())
        self.book = self.part("xl/workbook.xml")
        settings = self.book.find(f"{MAIN}workbookPr")
        self.from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        self.targets = {r.get("Id"): r.get("Target") for r in self.part("xl/_rels/workbook.xml.rels")}
        shared = self.part("xl/sharedStrings.xml")
        self.shared = [rich_text(si) for si in shared.iterfind(f"{MAIN}si")] if shared is not None else []
        self.dates = self._date_styles()

    def part(self, name: str) -> ElementTree.Element | None:
        return safe_xml(self.zip.read(name)) if name in self.parts else None

    def _date_styles(self) -> set[int]:
        styles = self.part("xl/styles.xml")
        if styles is None:
            return set()
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iterfind(f"{MAIN}numFmts/{MAIN}numFmt")}
        used = [int(x.get("numFmtId", "0")) for x in styles.iterfind(f"{MAIN}cellXfs/{MAIN}xf")]
        return {i for i, f in enumerate(used) if f in DATE_FORMATS or shows_date(own.get(f, ""))}

    def value(self, c: ElementTree.Element) -> str | None:
        kind, v = c.get("t"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            return cell(rich_text(c.find(f"{MAIN}is")))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return cell(self.shared[int(v.text)])
        if kind == "b":
            return "true" if v.text == "1" else "false"
        if kind in ("str", "e"):
            return cell(v.text)
        if int(c.get("s", "0")) in self.dates:
            return date_text(float(v.text), self.from_1904)
        return cell(float(v.text)) if _NUMBER.fullmatch(v.text) else v.text

    def sheets(self) -> Iterator[Grid]:
        for sheet in self.book.iterfind(f"{MAIN}sheets/{MAIN}sheet"):
            target = self.targets[sheet.get(RELATION)].lstrip("/")
            page = self.part(target if target.startswith("xl/") else f"xl/{target}")
            rows = []
            for row in page.iterfind(f"{MAIN}sheetData/{MAIN}row"):
                cells = {column_number(c.get("r")): self.value(c) for c in row.iterfind(f"{MAIN}c")}
                if any(v is not None for v in cells.values()):
                    rows.append([cells.get(i) for i in range(max(cells) + 1)])
            yield _grid(sheet.get("name"), rows[0], rows[1:]) if rows else Grid(sheet.get("name"), [], [])


def grids(path: str, raw: bytes) -> list[Grid]:
    """The tables of a file."""
    name, kind = stem(path), extension(path)
    if kind in ("csv", "tsv"):
        return delimited(name, decode(raw), "," if kind == "csv" else "\t")
    if kind == "json":
        return whole_json(name, decode(raw))
    if kind == "jsonl":
        return json_lines(name, decode(raw))
    if kind == "xlsx":
        return list(Workbook(raw).sheets())
    raise ValueError(f"unsupported file type: .{kind}")
