"""YAML 1.2 core text to and from the shared tree: block and flow collections, anchors, merges, block scalars."""

from __future__ import annotations

import re

from tessera.functions.tree import JSON_NUMBER, FormatError, Number, quote_json

_INT = re.compile(r"[-+]?\d+")
_FLOAT = re.compile(r"[-+]?(\.\d+|\d+\.\d*)([eE][-+]?\d+)?")
_BASED = re.compile(r"0x[0-9a-fA-F]+|0o[0-7]+")
_NULLS = ("", "~", "null", "Null", "NULL")
_TRUTHS = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


def resolve(text: str):
    """A plain scalar under the 1.2 core schema: yes/no, dates and 1:30 are text, 012 is twelve; decimals keep their spelling."""
    if text in _NULLS:
        return None
    if text in _TRUTHS:
        return _TRUTHS[text]
    if _BASED.fullmatch(text):
        return Number(int(text, 0))
    if _INT.fullmatch(text):
        return Number(int(text))
    if _FLOAT.fullmatch(text):
        if JSON_NUMBER.fullmatch(text):
            return Number(text)
        sign, _, rest = text.removeprefix("+").rpartition("-") if text.startswith("-") else ("", "", text.removeprefix("+"))
        digits, _, power = rest.replace("E", "e").partition("e")
        whole, _, part = digits.partition(".")
        return Number(("-" if text.startswith("-") else "") + str(int(whole or "0")) + (f".{part}" if part else "") + (f"e{power}" if power else ""))
    return text


class _Yaml:
    def __init__(self, text: str):
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        self.lines: list[tuple[int, str]] = []  # indent and text; blank lines keep indent -1
        for k, line in enumerate(text.removesuffix("\n").split("\n"), 1):
            body = line.lstrip(" ")
            if body.startswith("\t") and body.strip():
                raise FormatError(f"line {k}: a tab can't indent")
            self.lines.append((len(line) - len(body) if body.strip() else -1, body))
        self.at = 0
        self.anchors: dict[str, object] = {}

    def fail(self, why: str):
        raise FormatError(f"line {self.at + 1}: {why}")

    def skip(self) -> bool:
        """Goes to the next line with content; whether there is one."""
        while self.at < len(self.lines) and (self.lines[self.at][0] < 0 or self.lines[self.at][1].startswith("#")):
            self.at += 1
        return self.at < len(self.lines) and not (self.lines[self.at][0] == 0 and re.match(r"(\.\.\.|---)(\s|$)", self.lines[self.at][1]))

    def document(self):
        self.skip_marks()
        out = self.node(0) if self.skip() else None
        if self.skip():
            self.fail("this doesn't belong to what stands before")
        while self.at < len(self.lines):
            if self.lines[self.at][0] >= 0 and not re.match(r"(\.\.\.|#)", self.lines[self.at][1]):
                self.fail("only one document is read")
            self.at += 1
        return out

    def skip_marks(self) -> None:
        while self.at < len(self.lines):
            indent, body = self.lines[self.at]
            if body.startswith("%"):
                self.fail("directives are not supported")
            if indent == 0 and re.match(r"---(\s|$)", body):
                rest = body[3:].strip()
                if rest and not rest.startswith("#"):
                    self.lines[self.at] = (0, rest)
                else:
                    self.at += 1
                return
            if indent >= 0 and not body.startswith("#"):
                return
            self.at += 1

    # -- blocks

    def node(self, least: int):
        """The block node at the present line, whose indent is `least` or more."""
        indent, body = self.lines[self.at]
        if body == "-" or body.startswith("- "):
            return self.sequence(indent)
        if self.key_of(body) is not None:
            return self.mapping(indent)
        self.at += 1
        return self.value(body, indent - 1, indent)

    def key_of(self, body: str) -> tuple[str, str] | None:
        """(key, rest) of a mapping line."""
        if body.startswith(("? ", "?\n")) or body == "?":
            self.fail("complex keys are not supported")
        m = re.match(r'("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\')\s*:(?=\s|$)', body)
        if m:
            return self.quoted(m[1]), body[m.end() :].strip()
        if body[:1] in "\"'[{#|>@`%&*!" and not body.startswith("*"):
            return None
        m = re.match(r"([^#]*?(?:\S#[^#]*?)*?)\s*:(?=\s|$)", body)
        return (m[1], body[m.end() :].strip()) if m and m[1] else None

    def sequence(self, indent: int) -> list:
        out = []
        while self.skip() and self.lines[self.at][0] == indent and (self.lines[self.at][1] == "-" or self.lines[self.at][1].startswith("- ")):
            body = self.lines[self.at][1][1:]
            rest = body.lstrip(" ")
            inner = indent + 1 + len(body) - len(rest)
            if rest and not rest.startswith("#") and (rest == "-" or rest.startswith("- ") or self.key_of(rest) is not None):
                self.lines[self.at] = (inner, rest)
                out.append(self.node(inner))
            else:
                self.at += 1
                out.append(self.value(rest, indent, inner))
        if self.skip() and self.lines[self.at][0] > indent:
            self.fail("the indent fits nothing above")
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        merges: list = []
        while self.skip() and self.lines[self.at][0] == indent:
            found = self.key_of(self.lines[self.at][1])
            if found is None:
                self.fail("a key is expected")
            key, rest = found
            self.at += 1
            value = self.value(rest, indent, indent + 1, True)
            if key == "<<":
                merges += value if isinstance(value, list) else [value]
                continue
            if key in out:
                self.fail(f"the key {key} stands twice")
            out[key] = value
        if self.skip() and self.lines[self.at][0] > indent:
            self.fail("the indent fits nothing above")
        for other in merges:
            if not isinstance(other, dict):
                self.fail("only a mapping can be merged")
            for k, v in other.items():
                out.setdefault(k, v)
        return out

    def value(self, rest: str, indent: int, inner: int, in_mapping: bool = False):
        """What follows a key or a dash: on the same line or, deeper than `indent`, on the next ones."""
        m = re.match(r"&([^\s,\[\]{}]+)\s*", rest)
        if m:
            found = self.value(rest[m.end() :], indent, inner, in_mapping)
            self.anchors[m[1]] = found
            return found
        if rest.startswith("!"):
            self.fail("tags are not supported")
        if not rest or rest.startswith("#"):
            if self.skip() and (self.lines[self.at][0] > indent or (in_mapping and self.lines[self.at][0] == indent and re.match(r"-( |$)", self.lines[self.at][1]))):
                return self.node(self.lines[self.at][0])
            return None
        if rest[0] == "*":
            name = rest[1:].split(" #")[0].strip()
            if name not in self.anchors:
                self.fail(f"no anchor {name}")
            return self.anchors[name]
        if rest[0] in "|>":
            return self.block(rest, indent)
        if rest[0] in "[{":
            return self.flow(rest, indent)
        if rest[0] in "\"'":
            while not re.match(r'("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\')\s*(#.*)?$', rest, re.S):
                if self.at >= len(self.lines):
                    self.fail("the quote doesn't close")
                rest += "\n" + self.lines[self.at][1].strip()
                self.at += 1
            return self.quoted(re.match(r'("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\')', rest, re.S)[1])
        if rest[0] in "@`%":
            self.fail(f"{rest[0]} begins no plain text")
        text = re.split(r"\s#", rest, maxsplit=1)[0].strip()
        more = []
        while not re.search(r"\s#", rest) and self.at < len(self.lines) and (self.lines[self.at][0] > indent or self.lines[self.at][0] < 0):
            if self.lines[self.at][0] < 0:
                if not any(x[0] >= 0 for x in self.lines[self.at :]) or next(x[0] for x in self.lines[self.at :] if x[0] >= 0) <= indent:
                    break
                more.append("\n")
            elif self.lines[self.at][1].startswith("#"):
                break
            else:
                line = re.split(r"\s#", self.lines[self.at][1], maxsplit=1)[0].strip()
                if re.search(r":(\s|$)", line):
                    self.fail("a key can't stand within a text")
                more.append(line)
            self.at += 1
        if more:
            return self.folded("\n".join([text, *("" if x == "\n" else x for x in more)]))
        return resolve(text)

    @staticmethod
    def folded(text: str) -> str:
        return re.sub(r"[ \t]*(\n+)[ \t]*", lambda m: " " if len(m[1]) == 1 else "\n" * (len(m[1]) - 1), text)

    def quoted(self, text: str) -> str:
        body = text[1:-1]
        if text[0] == "'":
            return self.folded(body).replace("''", "'")

        def escape(m: re.Match) -> str:
            e = m[1]
            if e[0] in "xuU":
                return chr(int(e[1:], 16))
            if e == "\n":
                return ""
            if e not in _ESCAPES:
                self.fail(f"unknown escape \\{e}")
            return _ESCAPES[e]

        body = re.sub(r"(?<!\\)((?:\\\\)*)[ \t]*(\n+)[ \t]*", lambda m: m[1] + (" " if len(m[2]) == 1 else "\n" * (len(m[2]) - 1)), body)
        return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.|\n)", escape, body, flags=re.S)

    def block(self, head: str, indent: int) -> str:
        m = re.fullmatch(r"([|>])([-+]?)(\d?)([-+]?)\s*(#.*)?", head)
        if not m:
            self.fail("the block's head can't be read")
        keep, own = m[2] or m[4], indent + int(m[3]) if m[3] else None
        lines: list[str] = []
        while self.at < len(self.lines):
            at, body = self.lines[self.at]
            if at >= 0 and own is None and at > indent:
                own = at
            if at >= 0 and (own is None or at < own):
                break
            lines.append("" if at < 0 else " " * (at - own) + body)
            self.at += 1
        tail = 0
        while lines and not lines[-1]:
            lines.pop()
            tail += 1
        if m[1] == "|":
            text = "\n".join(lines)
        else:
            text, before = "", False
            for k, line in enumerate(lines):
                deep = line.startswith((" ", "\t"))
                if not k:
                    text = line
                elif not line:
                    text += "\n"
                elif deep or before or text.endswith("\n"):
                    text += line if text.endswith("\n") and not (deep or before) else "\n" + line
                else:
                    text += " " + line
                before = deep
        return text + ("" if keep == "-" or not lines and keep != "+" else "\n" * (tail + bool(lines)) if keep == "+" else "\n")

    # -- flow

    def flow(self, rest: str, indent: int):
        text = rest
        while True:
            try:
                value, end = self.flow_value(text, 0)
                break
            except IndexError:
                if self.at >= len(self.lines):
                    self.fail("the bracket doesn't close")
                text += "\n" + self.lines[self.at][1]
                self.at += 1
        if not re.fullmatch(r"\s*(#.*)?", text[end:], re.S):
            self.fail("more stands behind the bracket")
        return value

    def flow_skip(self, text: str, at: int) -> int:
        at = re.compile(r"(\s|(?<=\s)#[^\n]*)*").match(text, at).end()
        if at >= len(text):
            raise IndexError
        return at

    def flow_value(self, text: str, at: int):
        at = self.flow_skip(text, at)
        c = text[at]
        if c == "[" or c == "{":
            out: list | dict = [] if c == "[" else {}
            close = "]" if c == "[" else "}"
            at = self.flow_skip(text, at + 1)
            while text[at] != close:
                key, at = self.flow_value(text, at)
                at = self.flow_skip(text, at)
                if text[at] == ":":
                    at = self.flow_skip(text, at + 1)
                    value, at = (None, at) if text[at] in ",]}" else self.flow_value(text, at)
                    at = self.flow_skip(text, at)
                    key = "" if key is None else str(key).lower() if isinstance(key, bool) else str(key)
                    if isinstance(out, dict):
                        out[key] = value
                    else:
                        out.append({key: value})
                elif isinstance(out, dict):
                    out["" if key is None else str(key)] = None
                else:
                    out.append(key)
                if text[at] == ",":
                    at = self.flow_skip(text, at + 1)
                elif text[at] != close:
                    self.fail("a comma is missing")
            return out, at + 1
        if c in "\"'":
            m = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', re.S).match(text, at)
            if not m:
                raise IndexError
            return self.quoted(m[0]), m.end()
        if c == "*":
            m = re.compile(r"\*([^\s,\[\]{}]+)").match(text, at)
            if m[1] not in self.anchors:
                self.fail(f"no anchor {m[1]}")
            return self.anchors[m[1]], m.end()
        m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)*").match(text, at)
        return resolve(m[0].strip()), m.end()


def parse_yaml(text: str):
    """One document of the 1.2 core schema. Tags, directives, complex keys and tabs as indent are refused."""
    try:
        return _Yaml(text).document()
    except RecursionError:
        raise FormatError("too deep") from None


#: Plain words that some reader takes for something else than text (fixed values of the 1.1 and 1.2 schemas).
_RISKY = re.compile(r"(?i:null|true|false|yes|no|on|off|y|n)|~|[-+]?\.(?i:inf|nan)|[-+]?[\d.][\d_,.:eE+-]*|0[xob][\da-fA-F_]+|\d{4}-\d\d?-\d\d?.*|<<|=")


def quote_yaml(text: str) -> str:
    """Plain if no reader of 1.1 or 1.2 could take it for something else, else in double quotes."""
    plain = text and text == text.strip() and not _RISKY.fullmatch(text) and text[0] not in "-?:,[]{}#&*!|>'\"%@`" and ": " not in text and " #" not in text and not text.endswith(":") and text.isprintable()
    return text if plain else quote_json(text)


def render_yaml(tree, indent: int = 2) -> str:
    def leaf(x) -> str:
        if x is None:
            return "null"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, Number):
            return re.sub(r"^(-?\d+)[eE]", r"\1.0e", str(x))
        if isinstance(x, str):
            return quote_yaml(x)
        return "{}" if isinstance(x, dict) else "[]"

    def put(x, depth: int) -> list[str]:
        pad = " " * (indent * depth)
        if isinstance(x, dict) and x:
            out = []
            for k, v in x.items():
                deep = isinstance(v, (dict, list)) and v
                out.append(f"{pad}{quote_yaml(k)}:" + ("" if deep else f" {leaf(v)}"))
                out += put(v, depth + 1) if deep else []
            return out
        if isinstance(x, list) and x:
            out = []
            for v in x:
                inner = put(v, depth + 1) if isinstance(v, (dict, list)) and v else [f"{pad}  {leaf(v)}"]
                first = inner[0].lstrip(" ")
                out += [f"{pad}-" + " " * (indent - 1 if isinstance(v, (dict, list)) and v else 1) + first, *inner[1:]]
            return out
        return [pad + leaf(x)]

    return "\n".join(put(tree, 0)) + "\n"
