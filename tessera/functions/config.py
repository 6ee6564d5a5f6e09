"""INI and TOML text to and from the shared tree."""

from __future__ import annotations

import re

from tessera.functions.tree import FormatError, Number, quote_json

# -- INI ------------------------------------------------------------------------------------------------------------


def parse_ini(text: str) -> dict:
    """Sections of keys; the first `=` or `:` splits, values are text, the last of equal keys counts, keys before any section lie under ""."""
    out: dict[str, dict[str, str]] = {}
    own = None
    for k, line in enumerate(re.split("\r\n|\n|\r", text.removeprefix("\ufeff")), 1):
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[":
            if not line.endswith("]"):
                raise FormatError(f"line {k}: the section's bracket doesn't close")
            own = out.setdefault(line[1:-1].strip(), {})
            continue
        m = re.match(r"([^=:]*)[=:](.*)", line, re.S)
        if not m or not m[1].strip():
            raise FormatError(f"line {k}: neither a section nor key=value")
        own = out.setdefault("", {}) if own is None else own
        value = m[2].strip()
        own[m[1].strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
    return out


def render_ini(tree) -> str:
    """Sections of single values; arrays, null and deeper trees have no place in INI."""
    if not isinstance(tree, dict):
        raise FormatError("INI holds an object of sections")

    def lines(section: dict) -> list[str]:
        for k, v in section.items():
            if v is None or isinstance(v, (dict, list)):
                raise FormatError(f"{k}: INI holds single values only")
            if "\n" in str(v) or "\r" in str(v) or not k.strip() or re.search(r"[=:\r\n\[]", k):
                raise FormatError(f"{k}: INI has no escape for this")
        return [f"{k} = {str(v).lower() if isinstance(v, bool) else v}" for k, v in section.items()]

    plain = {k: v for k, v in tree.items() if not isinstance(v, dict)} | (tree.get("") if isinstance(tree.get(""), dict) else {})
    out = lines(plain)
    for name, section in tree.items():
        if isinstance(section, dict) and name:
            out += [*[""] * bool(out), f"[{name}]", *lines(section)]
    return "\n".join(out) + "\n" if out else ""


# -- TOML -----------------------------------------------------------------------------------------------------------

_BARE = re.compile(r"[A-Za-z0-9_-]+")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?")
_NUMBER = re.compile(r"[+-]?(?:0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)")
_ESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}


class _Toml:
    def __init__(self, text: str):
        self.text, self.at = text.removeprefix("\ufeff").replace("\r\n", "\n"), 0

    def fail(self, why: str):
        raise FormatError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {why}")

    def skip(self, lines: bool = False) -> None:
        m = re.compile(r"(?:[ \t]|#[^\n]*|\n)*" if lines else r"[ \t]*(?:#[^\n]*)?").match(self.text, self.at)
        self.at = m.end()

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def string(self) -> str:
        for mark in ('"""', "'''", '"', "'"):
            if not self.take(mark):
                continue
            long, raw = len(mark) == 3, mark[0] == "'"
            if long:
                self.take("\n")
            out = []
            while not self.take(mark):
                if self.at >= len(self.text) or (not long and self.text[self.at] == "\n"):
                    self.fail("the text doesn't close")
                c = self.text[self.at]
                self.at += 1
                if c != "\\" or raw:
                    out.append(c)
                    continue
                e = self.text[self.at : self.at + 1]
                self.at += 1
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif e in ("u", "U"):
                    size = 4 if e == "u" else 8
                    try:
                        out.append(chr(int(self.text[self.at : self.at + size], 16)))
                    except ValueError:
                        self.fail("an escape isn't hexadecimal")
                    self.at += size
                elif long and e in (" ", "\t", "\n"):
                    self.at = re.compile(r"[ \t]*\n?\s*").match(self.text, self.at - 1).end()
                else:
                    self.fail(f"unknown escape \\{e}")
            while long and self.take(mark[0]):  # up to two quotes may stand before the closing ones
                out.append(mark[0])
            return "".join(out)
        self.fail("a text is expected")

    def key(self) -> list[str]:
        out = []
        while True:
            self.skip()
            m = _BARE.match(self.text, self.at)
            if m:
                out.append(m[0])
                self.at = m.end()
            else:
                out.append(self.string())
            blank = re.compile(r"[ \t]*").match(self.text, self.at)
            self.at = blank.end()
            if not self.take("."):
                return out

    def value(self):
        c = self.text[self.at : self.at + 1]
        if c in ('"', "'"):
            return self.string()
        if self.take("["):
            out = []
            while True:
                self.skip(True)
                if self.take("]"):
                    return out
                out.append(self.value())
                self.skip(True)
                if not self.take(",") and self.text[self.at : self.at + 1] != "]":
                    self.fail("a comma is missing")
        if self.take("{"):
            out = {}
            self.skip()
            while not self.take("}"):
                self.pair(out)
                self.skip()
                if not self.take(",") and self.text[self.at : self.at + 1] != "}":
                    self.fail("a comma is missing")
                self.skip()
            return out
        for kind, pattern in (("date", _DATE), ("number", _NUMBER), ("word", re.compile(r"[+-]?[A-Za-z]+"))):
            m = pattern.match(self.text, self.at)
            if m and (m.end() == len(self.text) or self.text[m.end()] in " \t\n,]}#"):
                self.at = m.end()
                if kind == "date":
                    return m[0]
                if kind == "number":
                    plain = m[0].replace("_", "").removeprefix("+")
                    return Number(int(plain, 0) if re.match(r"-?0[xob]", plain) else plain)
                if m[0] in ("true", "false"):
                    return m[0] == "true"
                if m[0].lstrip("+-") in ("inf", "nan"):
                    return m[0]
        self.fail("no value that TOML has")

    def pair(self, table: dict) -> None:
        path = self.key()
        if not self.take("="):
            self.fail("= is missing")
        self.skip()
        for name in path[:-1]:
            table = table.setdefault(name, {})
            if not isinstance(table, dict):
                self.fail(f"{name} is a value already")
        if path[-1] in table:
            self.fail(f"{path[-1]} is defined twice")
        table[path[-1]] = self.value()

    def document(self) -> dict:
        root: dict = {}
        own, made = root, set()
        while True:
            self.skip(True)
            if self.at >= len(self.text):
                return root
            if self.take("["):
                many = self.take("[")
                path = self.key()
                if not self.take("]]" if many else "]"):
                    self.fail("the table's bracket doesn't close")
                own = root
                for name in path[:-1]:
                    own = own.setdefault(name, {})
                    own = own[-1] if isinstance(own, list) and own and isinstance(own[-1], dict) else own
                    if not isinstance(own, dict):
                        self.fail(f"{name} is a value already")
                if many:
                    rows = own.setdefault(path[-1], [])
                    if not isinstance(rows, list):
                        self.fail(f"{path[-1]} is no array of tables")
                    rows.append({})
                    own = rows[-1]
                else:
                    own = own.setdefault(path[-1], {})
                    if not isinstance(own, dict) or id(own) in made:
                        self.fail(f"{path[-1]} is defined twice")
                    made.add(id(own))
            else:
                self.pair(own)
            self.skip()
            if self.at < len(self.text) and not self.take("\n"):
                self.fail("more stands on the line")


def parse_toml(text: str) -> dict:
    """TOML 1.0; numbers keep their decimal spelling, dates and times are text."""
    return _Toml(text).document()


def render_toml(tree) -> str:
    """TOML; null has no form, and only an object can be a document. Text that looks like a date is written as one."""
    if not isinstance(tree, dict):
        raise FormatError("a TOML document is an object")

    def name(k: str) -> str:
        return k if _BARE.fullmatch(k) else quote_json(k)

    def inline(x) -> str:
        if x is None:
            raise FormatError("TOML has no null")
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, Number):
            return re.sub(r"^(-?\d+)([eE])", r"\1.0\2", str(x))
        if isinstance(x, str):
            return x if _DATE.fullmatch(x) else quote_json(x).replace("\x7f", "\\u007f")
        if isinstance(x, list):
            return "[" + ", ".join(map(inline, x)) + "]"
        return "{ " + ", ".join(f"{name(k)} = {inline(v)}" for k, v in x.items()) + " }" if x else "{}"

    def tables(v) -> bool:
        return isinstance(v, list) and bool(v) and all(isinstance(x, dict) for x in v)

    out: list[str] = []

    def put(table: dict, path: list[str]) -> None:
        for k, v in table.items():
            if not isinstance(v, dict) and not tables(v):
                out.append(f"{name(k)} = {inline(v)}")
        for k, v in table.items():
            if isinstance(v, dict):
                out.extend([*[""] * bool(out), "[" + ".".join(map(name, [*path, k])) + "]"])
                put(v, [*path, k])
            elif tables(v):
                for row in v:
                    out.extend([*[""] * bool(out), "[[" + ".".join(map(name, [*path, k])) + "]]"])
                    put(row, [*path, k])

    put(tree, [])
    return "\n".join(out) + "\n" if out else ""
