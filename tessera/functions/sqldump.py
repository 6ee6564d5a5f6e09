"""Tables out of SQL dump text: CREATE TABLE and INSERT ... VALUES statements are read, never run."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.functions.csvtext import render_csv

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)|(?P<text>[NnXx]?'(?:[^'\\]|\\.|'')*')|(?P<name>`(?:[^`]|``)*`|"(?:[^"]|"")*"|\[[^\]]*\])|(?P<word>[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<mark>.)""",
    re.S | re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
_CONSTRAINTS = {"PRIMARY", "KEY", "UNIQUE", "INDEX", "CONSTRAINT", "FOREIGN", "CHECK", "FULLTEXT", "SPATIAL", "EXCLUDE"}


@dataclass
class SqlTable:
    name: str
    columns: list[str] = field(default_factory=list)
    rows: list[list[str | None]] = field(default_factory=list)

    def padded(self) -> list[list[str | None]]:
        return [[*row, *[None] * (len(self.columns) - len(row))] for row in self.rows]

    def to_csv(self, delimiter: str = ",", eol: str = "\n") -> str:
        return render_csv([self.columns, *([x if x is not None else "" for x in row] for row in self.padded())], delimiter, eol)


def _unquote(kind: str, text: str) -> str:
    if kind == "text":
        body = text[text.index("'") + 1 : -1].replace("''", "'")
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)
    return text[1:-1].replace("``", "`").replace('""', '"') if kind == "name" else text


def _statements(text: str):
    own: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "mark" and m[0] == ";":
            yield own
            own = []
        else:
            own.append((kind, m[0]))
    if own:
        yield own


def _groups(tokens: list[tuple[str, str]]) -> list[list[list[tuple[str, str]]]]:
    """The parenthesised groups of a statement, each cut at its own commas."""
    out, depth, items = [], 0, [[]]
    for kind, text in tokens:
        if kind == "mark" and text == "(":
            depth += 1
            if depth == 1:
                items = [[]]
                continue
        elif kind == "mark" and text == ")":
            depth -= 1
            if depth == 0:
                out.append(items)
                continue
        if depth == 1 and kind == "mark" and text == ",":
            items.append([])
        elif depth:
            items[-1].append((kind, text))
    return out


def _value(tokens: list[tuple[str, str]]) -> str | None:
    if len(tokens) == 1:
        kind, text = tokens[0]
        return None if kind == "word" and text.upper() == "NULL" else _unquote(kind, text)
    return "".join(_unquote(k, t) for k, t in tokens)


def parse_dump(text: str) -> tuple[list[SqlTable], list[str]]:
    """Tables in the order of their first mention, and note codes. NULL stays apart from ''. Values beyond the known columns
    get columns c3, c4, ...; rows that are shorter than the table are filled up with NULL."""
    tables: dict[str, SqlTable] = {}
    notes: set[str] = set()
    for statement in _statements(text):
        words = [t.upper() for k, t in statement if k == "word"]
        heads = [t.upper() for _, t in statement[:6]]
        if heads[:1] == ["CREATE"] and "TABLE" in heads:
            at = next(k for k, t in enumerate(statement) if t[1].upper() == "TABLE") + 1
            while at < len(statement) and statement[at][1].upper() in ("IF", "NOT", "EXISTS"):
                at += 1
            name, at = _table_name(statement, at)
            groups = _groups(statement[at:])
            found = tables.setdefault(name, SqlTable(name))
            if groups and not found.columns:
                found.columns = [_unquote(*c[0]) for c in groups[0] if c and not (c[0][0] == "word" and c[0][1].upper() in _CONSTRAINTS)]
        elif heads[:1] in (["INSERT"], ["REPLACE"]) and "VALUES" in words:
            at = 1
            while at < len(statement) and statement[at][1].upper() in ("IGNORE", "INTO", "LOW_PRIORITY", "DELAYED", "HIGH_PRIORITY", "OR", "REPLACE"):
                at += 1
            name, at = _table_name(statement, at)
            values = next(k for k in range(at, len(statement)) if statement[k][0] == "word" and statement[k][1].upper() == "VALUES")
            named = _groups(statement[at:values])
            names = [_unquote(*c[0]) for c in named[0] if c] if named else None
            found = tables.setdefault(name, SqlTable(name))
            tail = next((k for k in range(values, len(statement)) if statement[k][1].upper() == "ON"), len(statement))
            for items in _groups(statement[values:tail]):
                row = [_value(x) for x in items]
                width = len(row)
                own = names or found.columns
                order = [*own[:width], *(f"c{k + 1}" for k in range(len(own), width))]
                for c in order:
                    if c not in found.columns:
                        found.columns.append(c)
                cells: list[str | None] = [None] * len(found.columns)
                for c, x in zip(order, row, strict=True):
                    cells[found.columns.index(c)] = x
                found.rows.append(cells)
                if width < len(own):
                    notes.add("SHORT_ROWS")
                if any(x is None for x in row):
                    notes.add("NULL_AS_EMPTY")
        elif statement:
            notes.add("STATEMENTS_SKIPPED")
    return list(tables.values()), sorted(notes)


def _table_name(statement: list[tuple[str, str]], at: int) -> tuple[str, int]:
    """The last part of a dotted name, and the place behind it."""
    name = _unquote(*statement[at])
    at += 1
    while at + 1 < len(statement) and statement[at] == ("mark", "."):
        name, at = _unquote(*statement[at + 1]), at + 2
    return name, at
