"""Conversation content and the paths that it names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which paths hold data, copies, state.
DATA = r"(?i)\.(csv|tsv|xlsx|jsonl?)$"
GENERATED = r"(?i)(^|/)\.shroud/(out|cards)/"
STATE = r"(?i)\.shroud(?![\\/]+(out|cards)\b)"
IN_COMMAND = r"""(?i)(['"])([^'"\n]*?\.(?:csv|tsv|xlsx|jsonl?))\1|([^\s'"()=;&|<>,]+\.(?:csv|tsv|xlsx|jsonl?))(?![\w.])"""

#: Content blocks as a Spark type: text blocks have a text, results of tools a text or blocks of their own.
BLOCKS = "array<struct<type:string,text:string,result:string,blocks:array<struct<type:string,text:string>>>>"


def normalize_path(path: str) -> str:
    """One kind of separator, without empty, ``.`` and resolvable ``..`` segments."""
    rooted = path[:1] in ("/", "\\")
    kept: list[str] = []
    for part in re.split(r"[\\/]+", path):
        if part == ".." and kept and kept[-1] != "..":
            kept.pop()
        elif part not in ("", ".") and not (part == ".." and rooted):
            kept.append(part)
    return "/" * rooted + "/".join(kept)


def normalize_path_column(path: Column) -> Column:
    parts = F.filter(F.split(path, r"[\\/]+"), lambda p: ~p.isin("", "."))
    rooted = path.rlike(r"^[\\/]")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("")) != "..")
        return F.when(up, F.slice(kept, 1, F.size(kept) - 1)).when((part == "..") & rooted, kept).otherwise(F.array_append(kept, part))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def is_data_path(path: str) -> bool:
    return bool(re.search(DATA, path))


def is_generated_path(path: str) -> bool:
    return bool(re.search(GENERATED, normalize_path(path)))


def touches_state(text: str) -> bool:
    """Whether a path, or a word of a command, leads into the engine's state."""
    words = re.split(r"[\s'\"`;|&()<>=]+", text)
    return bool(re.search(STATE, text)) or any(".." in w and re.search(STATE, normalize_path(w)) for w in words)


def data_paths_in(command: str) -> list[str]:
    """Distinct data files that a shell command names, quoted or bare."""
    return list(dict.fromkeys(m[2] or m[3] for m in re.finditer(IN_COMMAND, command)))


def data_paths_column(command: Column) -> Column:
    quoted, bare = (F.regexp_extract_all(command, F.lit(IN_COMMAND), F.lit(g)) for g in (2, 3))
    return F.array_distinct(F.zip_with(quoted, bare, lambda q, b: F.coalesce(F.nullif(q, F.lit("")), b)))


def for_dialog(text: str, most: int) -> str:
    """Text safe to show in one line: no control characters, bounded, quoted."""
    flat = re.sub(r"[\x00-\x1f\x7f\u2028\u2029]+", " ", text).strip()
    return json.dumps(flat if len(flat) <= most else f"{flat[:most]}…", ensure_ascii=False)


def for_dialog_column(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f\u2028\u2029]+", " "))
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)
    return F.regexp_replace(F.to_json(F.array(cut)), r"^\[|\]$", "")


# ---- blocks, as Python values and as columns ----


def texts_of(content) -> list[str]:
    """Every text that a reader of the content sees, in order. Content: a string, or a list of blocks."""
    if isinstance(content, str):
        return [content]
    out = []
    for b in content:
        if b.get("type") == "text":
            out.append(str(b.get("text")))
        elif b.get("type") == "tool_result":
            inner = b.get("content")
            if isinstance(inner, str):
                out.append(inner)
            elif isinstance(inner, list):
                out += [str(x.get("text")) for x in inner if isinstance(x, dict) and x.get("type") == "text"]
    return out


def with_texts(content, texts: list[str]):
    """The content with its texts replaced, in the order of ``texts_of``."""
    fresh = iter(texts)
    if isinstance(content, str):
        return next(fresh)

    def block(b):
        if b.get("type") == "text":
            return b | {"text": next(fresh)}
        inner = b.get("content")
        if b.get("type") == "tool_result" and isinstance(inner, str):
            return b | {"content": next(fresh)}
        if b.get("type") == "tool_result" and isinstance(inner, list):
            return b | {"content": [x | {"text": next(fresh)} if isinstance(x, dict) and x.get("type") == "text" else x for x in inner]}
        return b

    return [block(b) for b in content]


def _block_texts(b: Column) -> Column:
    nested = F.transform(F.filter(b["blocks"], lambda x: x["type"] == "text"), lambda x: x["text"])
    result = F.when(b["result"].isNotNull(), F.array(b["result"])).when(b["blocks"].isNotNull(), nested).otherwise(F.array().cast("array<string>"))
    return F.when(b["type"] == "text", F.array(b["text"])).when(b["type"] == "tool_result", result).otherwise(F.array().cast("array<string>"))


def texts_of_column(blocks: Column) -> Column:
    """The texts of a column of type ``BLOCKS``."""
    return F.flatten(F.transform(blocks, _block_texts))


def with_texts_column(blocks: Column, texts: Column) -> Column:
    """A column of type ``BLOCKS`` with its texts replaced."""

    def block(b: Column, i: Column) -> Column:
        before = F.size(texts_of_column(F.slice(blocks, F.lit(1), i)))

        def nested(x: Column, k: Column) -> Column:
            earlier = F.size(F.filter(F.slice(b["blocks"], F.lit(1), k), lambda y: y["type"] == "text"))
            return F.struct(x["type"].alias("type"), F.when(x["type"] == "text", F.get(texts, before + earlier)).otherwise(x["text"]).alias("text"))

        tool = b["type"] == "tool_result"
        return F.struct(
            b["type"].alias("type"),
            F.when(b["type"] == "text", F.get(texts, before)).otherwise(b["text"]).alias("text"),
            F.when(tool & b["result"].isNotNull(), F.get(texts, before)).otherwise(b["result"]).alias("result"),
            F.when(tool & b["result"].isNull(), F.transform(b["blocks"], nested)).otherwise(b["blocks"]).alias("blocks"),
        )

    return F.transform(blocks, block)
