"""Markdown trees: documents, sections and requirement sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.ranks import LEVELS
from ledgerline.functions.text import CODE, EMPHASIS, LINK, level, normal, slug, statement_id, status, strip_noise, whole

# What ends a block, a list marker, and where a sentence may end.
_BLOCK = re.compile(r"\n\s*\n|\n(?=\s*[-*+]\s)|\n(?=\s*\d+\.\s)")
_MARKER = re.compile(r"^(\s*)(?:[-*+]|\d+\.)\s+")
_STOP = re.compile(r"(?<=[.!?])\s+(?=[A-Z`\[(])")
# Abbreviations after which a sentence goes on.
_ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "resp.", "approx.", "Fig.", "no.", "No.")
LONGEST = 600


def read_tree(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path below root, text) of all files of a tree that match, one row a file."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    base = F.lit(root.rstrip("/") + "/")
    path = F.col("_metadata.file_path")
    return found.select(F.coalesce(F.nullif(F.split_part(path, base, F.lit(-1)), F.lit("")), path).alias("path"), F.col("value").alias("text"))


def sections(files: DataFrame) -> DataFrame:
    """(id, path, anchor, title, depth, status, length, body) of every heading, without a shuffle.

    A document is cut before its headings; what comes before the first one is dropped. Anchors that
    a document repeats get -1, -2 and so on, counted inside the document's own array.
    """
    head = r"^(#{1,6})[^\S\n]+(.*)"
    pieces = F.filter(F.split(strip_noise(F.col("text")), r"(?m)(?=^#{1,6}[^\S\n]+)"), lambda x: x.rlike(head))

    def section(piece: Column) -> Column:
        title = normal(F.regexp_extract(piece, head, 2))
        body = F.regexp_replace(F.regexp_replace(piece, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")
        return F.struct(slug(title).alias("base"), title.alias("title"), F.length(F.regexp_extract(piece, head, 1)).alias("depth"), body.alias("body"))

    rows = files.select("path", status(F.col("text")).alias("status"), F.transform(pieces, section).alias("s"))
    earlier = lambda x, i: F.size(F.filter(F.slice("s", F.lit(1), i), lambda y: y["base"] == x["base"]))
    numbered = F.transform("s", lambda x, i: F.struct(x.alias("x"), earlier(x, i).alias("seen")))
    rows = rows.select("path", "status", F.posexplode(numbered).alias("ordinal", "x"))
    base, seen = F.col("x.x.base"), F.col("x.seen")
    anchor = F.when(seen == 0, base).otherwise(F.concat(base, F.lit("-"), seen.cast("string")))
    rows = rows.select("path", "status", "ordinal", anchor.alias("anchor"), F.col("x.x.title").alias("title"), F.col("x.x.depth").alias("depth"), F.col("x.x.body").alias("body"))
    return rows.select(F.concat("path", F.lit("#"), "anchor").alias("id"), "path", "anchor", "title", "depth", "status", F.length("body").alias("length"), "body", "ordinal")


def documents(files: DataFrame) -> DataFrame:
    """(path, title, status): the first heading of depth 1 is the title, else the path is."""
    titles = F.regexp_extract(strip_noise(F.col("text")), r"(?m)^#[^\S\n]+(.*)", 1)
    return files.select("path", F.coalesce(F.nullif(normal(titles), F.lit("")), F.col("path")).alias("title"), status(F.col("text")).alias("status"))


def _sentences(text: str) -> list[str]:
    out, start = [], 0
    for m in _STOP.finditer(text):
        before = text[start : m.start()]
        if any(before.endswith(a) and not before[: -len(a)][-1:].isalnum() and before[: -len(a)][-1:] != "_" for a in _ABBREVIATIONS):
            continue
        out.append(before)
        start = m.end()
    return [s for s in map(str.strip, [*out, text[start:]]) if s]


def statements(body: str, plain, levels: list[str] = LEVELS) -> list[tuple[str, str]]:
    """(level, sentence) of a section's body, each sentence once whatever its case.

    Paragraphs and list items are blocks; a block whose last sentence has a keyword and ends with a
    colon takes in the deeper items below it, except those with a keyword of their own and what is
    below these. plain: block text without mark-up.
    """
    tests = [(x, re.compile(whole(x, x.replace(" ", r"\s+")))) for x in levels]
    find = lambda s: next((x for x, p in tests if p.search(s)), None)
    blocks = []
    for raw in _BLOCK.split(body):
        marker = _MARKER.match(raw)
        if text := plain(_MARKER.sub("", raw, count=1)):
            blocks.append((len(marker[1]) if marker else -1, text))
    out: dict[str, tuple[str, str]] = {}
    for at, (indent, text) in enumerate(blocks):
        parts = _sentences(text)
        if parts and parts[-1].endswith(":") and find(parts[-1]):
            items, hidden = [], None
            for deep, item in blocks[at + 1 :]:
                if deep <= indent:
                    break
                if hidden is not None and deep > hidden:
                    continue
                hidden = deep if find(item) else None
                if hidden is None:
                    items.append(re.sub(r"[.;,]$", "", item))
            if items:
                parts[-1] += " " + "; ".join(items)
        for sentence in parts:
            if kind := find(sentence):
                short = sentence if len(sentence) <= LONGEST else sentence[: LONGEST - 1] + "..."
                out.setdefault(short.lower(), (kind, short))
    return list(out.values())


_CODE = re.compile(f"({CODE})")
_MARKS = [re.compile(p) for p in EMPHASIS]


def plain_text(text: str) -> str:
    """``functions.text.normal`` for one string, for use inside ``statements``."""
    parts = _CODE.split(re.sub(r"\s+", " ", re.sub(LINK, r"\1", text)))
    for i in range(0, len(parts), 2):
        for mark in _MARKS:
            parts[i] = mark.sub(r"\1", parts[i])
    return "".join(parts).strip()


def requirements(found: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """(id, level, text, section, path, title, status, ordinal) of the requirement sentences of ``sections``.

    Folding list items into their lead-in depends on the order of blocks, so a pandas UDF does it,
    section by section; everything else is columns.
    """

    @F.pandas_udf("array<struct<level string, text string>>")
    def extract(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in bodies:
            yield pd.Series([[{"level": a, "text": b} for a, b in statements(x or "", plain_text, levels)] for x in batch])

    rows = found.select("id", "path", "title", "status", F.posexplode(extract("body")).alias("ordinal", "s"))
    section = F.col("id")
    return rows.select(statement_id(section, F.col("s.text")).alias("id"), F.col("s.level").alias("level"), F.col("s.text").alias("text"), section.alias("section"), "path", "title", "status", "ordinal")


def plain_requirements(docs: DataFrame, levels: list[str], *, section: Column, text: Column) -> DataFrame:
    """Requirement sentences of running text without lists, in columns only: cut at line ends and after . ! ?; keywords from ``levels`` by priority."""
    pieces = F.transform(F.split(text, r"\n|[.!?]\s+"), lambda x: F.trim(x))
    rows = docs.select(section.alias("section"), F.posexplode(pieces).alias("ordinal", "text"))
    rows = rows.select("section", "ordinal", "text", level(F.col("text"), levels).alias("level")).where("level IS NOT NULL")
    return rows.select(statement_id(F.col("section"), F.col("text")).alias("id"), "level", "text", "section", "ordinal")
