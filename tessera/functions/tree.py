"""The tree that JSON, YAML, TOML, INI and XML share: dict, list, str, bool, None, and numbers that keep their spelling."""

from __future__ import annotations

import json
import re


class FormatError(ValueError):
    """Input that is refused rather than guessed at."""


class Number(str):
    """A number as it was spelt."""


JSON_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")


def _constant(name: str):
    raise FormatError(f"{name} is no JSON number")


def parse_json(text: str):
    """Strict JSON; of equal keys the last value counts, at the first one's place; numbers keep their spelling."""
    try:
        return json.loads(text.removeprefix("\ufeff"), parse_int=Number, parse_float=Number, parse_constant=_constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise FormatError(str(e)) from None


def quote_json(text: str, ascii_only: bool = False) -> str:
    return json.dumps(str(text), ensure_ascii=ascii_only)


def render_json(tree, indent: int | None = 2, sort_keys: bool = False, ascii_only: bool = False) -> str:
    """JSON text; without indent in one line without spaces. Empty containers stay short."""

    def put(x, depth: int) -> str:
        if x is None:
            return "null"
        if x is True or x is False:
            return "true" if x else "false"
        if isinstance(x, Number):
            return str(x)
        if isinstance(x, str):
            return quote_json(x, ascii_only)
        if not x:
            return "{}" if isinstance(x, dict) else "[]"
        if isinstance(x, dict):
            colon = ": " if indent is not None else ":"
            items = [f"{quote_json(k, ascii_only)}{colon}{put(v, depth + 1)}" for k, v in (sorted(x.items()) if sort_keys else x.items())]
            left, right = "{", "}"
        else:
            items, (left, right) = [put(v, depth + 1) for v in x], "[]"
        if indent is None:
            return left + ",".join(items) + right
        pad = "\n" + " " * (indent * (depth + 1))
        return left + pad + ("," + pad).join(items) + "\n" + " " * (indent * depth) + right

    return put(tree, 0)


# -- tables ---------------------------------------------------------------------------------------------------------

#: Names that a table without its own gets, by language (fixed values).
COLUMN_NAMES = {"en": ("column", "value"), "zh": ("列", "值")}


def cell(x) -> str:
    """A tree as the text of one cell: nothing for null, compact JSON for containers."""
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, str) else render_json(x, None)


def to_table(tree, naming: str = "en") -> tuple[list[str], list[list[str]], list[str]]:
    """(columns, rows, note codes) of an array: objects by the union of their keys as first seen, arrays by place, else one column."""
    if not isinstance(tree, list):
        raise FormatError("only an array has rows")
    if not tree:
        raise FormatError("an empty array has no columns")
    column, value = COLUMN_NAMES[naming]
    notes = ["TYPES_LOST"]
    if all(isinstance(x, dict) for x in tree):
        names = list(dict.fromkeys(k for x in tree for k in x))
        if any(isinstance(v, (dict, list)) for x in tree for v in x.values()):
            notes.append("NESTED_PACKED")
        if any(v is None for x in tree for v in x.values()):
            notes.append("NULL_AS_EMPTY")
        if len({len(x) for x in tree}) > 1:
            notes.append("UNEVEN_WIDTHS")
        return names, [[cell(x.get(k)) for k in names] for x in tree], notes
    if any(x is None for x in tree):
        notes.append("NULL_AS_EMPTY")
    if all(isinstance(x, list) for x in tree):
        width = max(map(len, tree))
        if len({len(x) for x in tree}) > 1:
            notes.append("UNEVEN_WIDTHS")
        return [f"{column}{k + 1}" for k in range(width)], [[*map(cell, x), *[""] * (width - len(x))] for x in tree], notes
    if any(isinstance(x, (dict, list)) for x in tree):
        notes.append("NESTED_PACKED")
    return [value], [[cell(x)] for x in tree], notes


def unique_headers(names: list[str], naming: str = "en") -> list[str]:
    """Trimmed headers; blank ones are named by place, repeated ones get _2, _3, ..."""
    out: list[str] = []
    taken: set[str] = set()
    for k, name in enumerate(names):
        base = name.strip() or f"{COLUMN_NAMES[naming][0]}{k + 1}"
        made, n = base, 2
        while made in taken:
            made, n = f"{base}_{n}", n + 1
        taken.add(made)
        out.append(made)
    return out


def scalar(text: str, infer: bool = False):
    """A cell as a leaf: text, or with `infer` the number or truth value that it spells."""
    trimmed = text.strip()
    if infer and JSON_NUMBER.fullmatch(trimmed):
        return Number(trimmed)
    if infer and trimmed in ("true", "false"):
        return trimmed == "true"
    return text


def from_records(records: list[list[str]], header: bool = True, infer: bool = False, naming: str = "en") -> list:
    """Records as an array of objects, or without a header of arrays. Short rows are filled up, cells beyond the header are left out."""
    if not header:
        return [[scalar(x, infer) for x in row] for row in records]
    names = unique_headers(records[0], naming) if records else []
    return [{name: scalar(row[k] if k < len(row) else "", infer) for k, name in enumerate(names)} for row in records[1:]]
