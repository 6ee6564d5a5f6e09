"""XML text to and from the shared tree, and the choice of the element in it that is a table's row."""

from __future__ import annotations

import re
from xml.parsers import expat

from tessera.functions.tree import FormatError, Number, render_json

_NAME = re.compile(r"[A-Za-z_:\u00c0-\ufffd][\w:.\-\u00b7]*")


def parse_xml(text: str) -> dict:
    """{root: element}. Of an element: attributes as @name, sorted; child elements always as arrays, in order of first occurrence;
    text, trimmed, as #text or, where nothing else is, as the value; null if empty. Document types are refused, comments dropped."""
    if re.search(r"<!(DOCTYPE|ENTITY|NOTATION)", text[:8192]):
        raise FormatError("a document type is refused")
    parser = expat.ParserCreate()
    parser.buffer_text = True
    stack: list[tuple[dict, dict, list[str]]] = [({}, {}, [])]

    def start(name, attributes):
        stack.append((attributes, {}, []))

    def end(name):
        attributes, children, texts = stack.pop()
        content = "".join(texts).strip()
        out = {f"@{k}": v for k, v in sorted(attributes.items())}
        if content and (out or children):
            out["#text"] = content
        out |= children
        stack[-1][1].setdefault(name, []).append(out or (content or None))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, lambda x: stack[-1][2].append(x)

    def refuse(*_):
        raise FormatError("a document type is refused")

    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(text.removeprefix("\ufeff").encode(), True) if not re.match(r"\ufeff?\s*<\?xml[^>]*encoding", text) else parser.Parse(re.sub(r"(<\?xml[^>]*?)\s+encoding\s*=\s*(\"[^\"]*\"|'[^']*')", r"\1", text.removeprefix("\ufeff"), count=1).lstrip().encode(), True)
    except expat.ExpatError as e:
        raise FormatError(str(e)) from None
    return {k: v[0] for k, v in stack[0][1].items()}


def escape_xml(text: str) -> str:
    if re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", text):
        raise FormatError("XML has no form for a control character")
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def render_xml(tree, root: str = "root", item: str = "item", indent: int = 2) -> str:
    """The inverse of parse_xml. An object of one member that is no array is the root itself, else `root` wraps it; array items
    without a name are `item`. Names that XML doesn't allow are refused."""

    def text_of(x) -> str:
        return ("true" if x else "false") if isinstance(x, bool) else "" if x is None else str(x)

    def element(name: str, x, depth: int) -> list[str]:
        if not _NAME.fullmatch(name):
            raise FormatError(f"{name} is no XML name")
        pad = " " * (indent * depth)
        if isinstance(x, list):
            return [f"{pad}<{name}>", *(line for v in x for line in element(item, v, depth + 1)), f"{pad}</{name}>"] if x else [f"{pad}<{name}/>"]
        attributes, content, children = "", "", []
        if isinstance(x, dict):
            for k, v in x.items():
                if k.startswith("@") and not isinstance(v, (dict, list)):
                    if not _NAME.fullmatch(k[1:]):
                        raise FormatError(f"{k[1:]} is no XML name")
                    attributes += f' {k[1:]}="' + escape_xml(text_of(v)).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;") + '"'
                elif k == "#text" and not isinstance(v, (dict, list)):
                    content = escape_xml(text_of(v))
                else:
                    children += [line for one in (v if isinstance(v, list) else [v]) for line in element(k, one, depth + 1)]
        else:
            content = escape_xml(text_of(x))
        if not children:
            return [f"{pad}<{name}{attributes}>{content}</{name}>" if content else f"{pad}<{name}{attributes}/>"]
        return [f"{pad}<{name}{attributes}>{content}", *children, f"{pad}</{name}>"]

    single = isinstance(tree, dict) and len(tree) == 1 and not isinstance(next(iter(tree.values())), list) and not next(iter(tree)).startswith(("@", "#"))
    name, top = next(iter(tree.items())) if single else (root, tree)
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', *element(name, top, 0)]) + "\n"


def pick_rows(tree: dict) -> tuple[list[str], list[list[str]], str, list[str]]:
    """(columns, rows, path, note codes) of the repeated element that is most like a table's row: the highest of
    100 * count + 10 * keys - depth, the first of equal ones. Single children become a.b, repeated ones JSON."""
    best: tuple[int, str, list] | None = None
    places = 0

    def look(x, path: str, depth: int) -> None:
        nonlocal best, places
        if not isinstance(x, dict):
            return
        for k, v in x.items():
            if isinstance(v, list):
                if len(v) > 1:
                    places += 1
                    keys = len({n for one in v if isinstance(one, dict) for n in one})
                    score = 100 * len(v) + 10 * keys - depth
                    if best is None or score > best[0]:
                        best = (score, f"{path}/{k}", v)
                for one in v:
                    look(one, f"{path}/{k}", depth + 1)
            else:
                look(v, f"{path}/{k}", depth + 1)

    look(tree, "", 0)
    if best is None:
        raise FormatError("no element repeats")
    notes = ["ROWS_CHOSEN"] + ["OTHER_TABLES"] * (places > 1)
    rows = []
    for one in best[2]:
        flat: dict[str, str] = {}

        def put(name: str, value: str, flat=flat) -> None:
            made, n = name, 2
            while made in flat:
                made, n = f"{name}#{n}", n + 1
            flat[made] = value

        def flatten(x, path: str) -> None:
            if isinstance(x, dict):
                for k, v in x.items():
                    flatten(v, f"{path}.{k}" if path else k)
            elif isinstance(x, list):
                if len(x) == 1:
                    flatten(x[0], path)
                else:
                    notes.append("PACKED")
                    put(path, render_json(x, None))
            else:
                put(path or "#text", "" if x is None else x if isinstance(x, (str, Number)) else str(x))

        flatten(one, "")
        rows.append(flat)
    columns = list(dict.fromkeys(k for r in rows for k in r))
    return columns, [[r.get(c, "") for c in columns] for r in rows], best[1], list(dict.fromkeys(notes))
