"""Wire definition files: tokens, statements, and the declarations that the statements nest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

FIELD = "struct<name string, number int, type string, label string, oneof string, deprecated boolean, comment string>"
VALUE = "struct<name string, number int, deprecated boolean>"
RANGE = "struct<low int, high int>"
SCHEMA = f"name string, kind string, file string, deprecated boolean, comment string, fields array<{FIELD}>, values array<{VALUE}>, reserved array<int>, reserved_ranges array<{RANGE}>"
_FIELDS = pa.struct([("name", pa.string()), ("number", pa.int32()), ("type", pa.string()), ("label", pa.string()), ("oneof", pa.string()), ("deprecated", pa.bool_()), ("comment", pa.string())])
_VALUES = pa.struct([("name", pa.string()), ("number", pa.int32()), ("deprecated", pa.bool_())])
_RANGES = pa.struct([("low", pa.int32()), ("high", pa.int32())])
_ARROW = pa.schema(
    [("name", pa.string()), ("kind", pa.string()), ("file", pa.string()), ("deprecated", pa.bool_()), ("comment", pa.string())]
    + [("fields", pa.list_(_FIELDS)), ("values", pa.list_(_VALUES)), ("reserved", pa.list_(pa.int32())), ("reserved_ranges", pa.list_(_RANGES))]
)
_TOKEN = re.compile(r"(?P<note>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<word>[\w.+-]+)|(?P<mark>[^\s\w])", re.S)
# The schema language's declarations, labels and largest field number; the longest comment that is kept.
DECLARATIONS, LABELS, LAST_NUMBER, LONGEST = ("message", "enum", "service"), ("repeated", "optional", "required"), 536_870_911, 300
_RETIRED = re.compile(r"deprecated[.:]", re.I)


@dataclass
class Statement:
    """Words and marks up to a semicolon or an opening brace, the comment lines right above, and what the braces hold."""

    tokens: list[str]
    comment: str | None
    body: list[Statement] | None = None
    closed: bool = False


@dataclass
class Scope:
    """An open brace: where its statements go, and whose it is."""

    into: list[Statement]
    owner: Statement | None = None
    pending: list[str] = field(default_factory=list)
    comment: str | None = None


def comment_text(lines: list[str]) -> str | None:
    """Comment lines as one, at most LONGEST characters."""
    text = " ".join(" ".join(lines).split())
    return (text if len(text) <= LONGEST else text[: LONGEST - 1] + "...") or None


def statements(source: str) -> list[Statement]:
    """The file as nested statements. A comment belongs to the statement that begins on the next line; brackets and option values keep their braces."""
    root: list[Statement] = []
    scopes = [Scope(root)]
    lines: list[str] = []  # of the comment above
    below = -1  # the line under that comment
    line, at, nested = 0, 0, 0  # nested: brackets, and braces within them
    fresh = True  # nothing but white space on this line so far
    for m in _TOKEN.finditer(source):
        gap = source.count("\n", at, m.start())
        line, fresh = line + gap, fresh or gap > 0
        at = m.start()
        token, scope = m.group(), scopes[-1]
        if m.lastgroup in ("note", "block"):
            if fresh and m.lastgroup == "note":
                lines = [*lines, token[2:]] if below == line else [token[2:]]
                below = line + 1
            elif fresh:
                lines = [re.sub(r"(?m)^\s*\*+/?|\*/$", " ", token[2:])]
                below = line + token.count("\n") + 1
        else:
            if not scope.pending and token not in "{};":
                scope.comment = comment_text(lines) if below == line else None
            if token in ("[", "(") or nested and token == "{":
                nested += 1
            elif nested and token in "])}":
                nested -= 1
            if nested or token not in ("{", "}", ";"):
                scope.pending.append(token)
            elif token == "{":
                owner = Statement(scope.pending, scope.comment, [])
                scope.into.append(owner)
                scope.pending = []
                scopes.append(Scope(owner.body, owner))
            else:
                if scope.pending:
                    scope.into.append(Statement(scope.pending, scope.comment))
                    scope.pending = []
                if token == "}" and len(scopes) > 1:
                    scopes.pop().owner.closed = True
        fresh = m.lastgroup == "note" and fresh
        line += token.count("\n")
        at = m.end()
    return root


def _retired(statement: Statement) -> bool:
    options = "".join(statement.tokens[statement.tokens.index("[") :]) if "[" in statement.tokens else ""
    return bool(re.search(r"[\[,]deprecated=true[\],]", options) or _RETIRED.match(statement.comment or ""))


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def _type(tokens: list[str]) -> str:
    return "".join(", " if t == "," else t for t in tokens)


def _field(statement: Statement, union: str | None) -> dict | None:
    """A field from "[label] type name = number [options]"; None for what isn't one."""
    tokens = statement.tokens[: statement.tokens.index("[")] if "[" in statement.tokens else statement.tokens
    label = tokens[0] if tokens[0] in LABELS and len(tokens) > 4 else None
    head = tokens[label is not None :]
    if len(head) < 4 or head[-2] != "=" or (number := _number(head[-1])) is None:
        return None
    return {"name": head[-3], "number": number, "type": _type(head[:-3]), "label": label, "oneof": union, "deprecated": _retired(statement), "comment": statement.comment}


def _value(statement: Statement) -> dict | None:
    tokens = statement.tokens
    if len(tokens) < 3 or tokens[1] != "=" or (number := _number(tokens[2])) is None:
        return None
    return {"name": tokens[0], "number": number, "deprecated": _retired(statement)}


def _reserved(tokens: list[str]) -> tuple[list[int], list[dict]]:
    """Single numbers and ranges of a reserved statement; names play no part."""
    singles, ranges = [], []
    for part in " ".join(tokens[1:]).split(","):
        match part.split():
            case [one] if _number(one) is not None:
                singles.append(int(one))
            case [low, "to", high] if _number(low) is not None and (high == "max" or _number(high) is not None):
                ranges.append({"low": int(low), "high": LAST_NUMBER if high == "max" else int(high)})
    return singles, ranges


def declared(found: list[Statement], file: str) -> list[dict]:
    """Messages, enums and services, each after those that it holds; nested names are qualified by the outer ones. One whose brace never closes is left out."""
    package = next((s.tokens[1] for s in found if s.tokens[:1] == ["package"] and len(s.tokens) > 1), "")
    out: list[dict] = []
    todo = [(True, package, None, None, iter(found))]  # (is it closed, prefix, record of the declaration, union, rest)
    while todo:
        closed, prefix, record, union, rest = todo[-1]
        for s in rest:
            kind = s.tokens[0] if s.tokens else ""
            if s.body is not None and kind in DECLARATIONS and len(s.tokens) > 1:
                name = f"{prefix}.{s.tokens[1]}" if prefix else s.tokens[1]
                made = {"name": name, "kind": kind, "file": file, "deprecated": bool(_RETIRED.match(s.comment or "")), "comment": s.comment, "fields": [], "values": [], "reserved": [], "reserved_ranges": []}
                todo.append((s.closed, name, made, None, iter(s.body)))
                break
            if record is None:
                continue
            if s.body is not None:
                if kind == "oneof" and len(s.tokens) > 1:
                    todo.append((s.closed, prefix, record, s.tokens[1], iter(s.body)))
                    break
            elif kind == "reserved":
                singles, ranges = _reserved(s.tokens)
                record["reserved"] += singles
                record["reserved_ranges"] += ranges
            elif record["kind"] == "enum":
                record["values"] += [v for v in [_value(s)] if v]
            elif kind != "option":
                record["fields"] += [f for f in [_field(s, union)] if f]
        else:
            todo.pop()
            if record is not None and union is None and closed:
                out.append(record)
    return out


def parse(file: str, source: str) -> list[dict]:
    return declared(statements(source), file)


def messages(files: DataFrame) -> DataFrame:
    """(path, text) rows of definition files -> one row a message, enum or service, as in SCHEMA. Statements nest, so this runs in Python, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [m for path, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) for m in parse(path, text or "")]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "text").mapInArrow(run, SCHEMA)
