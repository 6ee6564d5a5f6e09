"""Tolerant HTML: a tokenizer of our own, so that repairs and unknown entities can be counted, then parts, text, tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.functions.docparts import Para, Part, Rule, Run, Table, to_markdown, to_text

#: Named entities that are read; others stay as they are and are counted (fixed values).
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "middot": "·", "bull": "•", "times": "×", "divide": "÷", "deg": "°",
    "plusmn": "±", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "larr": "←", "uarr": "↑", "rarr": "→", "darr": "↓",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noscript"}
DROPPED = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object", "xmp"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag of the first kind closes an open element of the second.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
MOST_SPAN = 1000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def decode_entities(text: str) -> tuple[str, int]:
    """Text, and how many entities weren't known."""
    unknown = 0

    def one(m: re.Match) -> str:
        nonlocal unknown
        name = m[1]
        if name[0] == "#":
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        if name in ENTITIES:
            return ENTITIES[name]
        unknown += 1
        return m[0]

    return re.sub(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", one, text), unknown


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def parse_html(text: str) -> tuple[Node, dict[str, int]]:
    """The element tree, and counts of repairs (unclosed and stray tags) and unknown entities."""
    root = Node("#root")
    stack, counts = [root], {"repaired": 0, "unknown_entities": 0}

    def add_text(raw: str, decode: bool = True) -> None:
        if raw:
            clean, unknown = decode_entities(raw) if decode else (raw, 0)
            counts["unknown_entities"] += unknown
            stack[-1].children.append(clean)

    at = 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        if not m:
            add_text(text[at:])
            break
        add_text(text[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add_text(m[0][9:].removesuffix("]]>"), False)
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if not depth:
                counts["repaired"] += 1
                continue
            counts["repaired"] += sum(n.tag not in ("p", "li", "td", "th", "tr", "dt", "dd", "tbody", "thead", "option") for n in stack[depth + 1 :])
            del stack[depth:]
            continue
        if tag in BLOCKS and stack[-1].tag == "p":
            stack.pop()
        closes = CLOSED_BY.get(tag, ())
        while stack[-1].tag in closes:
            stack.pop()
        node = Node(tag, {k.lower(): decode_entities(v[1:-1] if v[:1] in "\"'" and v else v)[0] for k, v in _ATTRIBUTE.findall(m[3])})
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            body = text[at : end.start()] if end else text[at:]
            stack.append(node)
            add_text(body, tag in ("title", "textarea"))
            stack.pop()
            counts["repaired"] += not end
            at = end.end() if end else len(text)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    counts["repaired"] += sum(n.tag not in ("html", "body", "p", "li", "td", "th", "tr", "dt", "dd") for n in stack[1:])
    return root, counts


def find_all(node: Node, tag: str) -> list[Node]:
    """Elements of a tag in document order, nested ones too."""
    out = []
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == tag:
                out.append(c)
            out += find_all(c, tag)
    return out


def text_of(node: Node, skip: frozenset[str] = frozenset(DROPPED)) -> str:
    """The element's text with a line end for breaks and blocks, spaces collapsed."""
    out: list[str] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"[ \t\n\r\f]+", " ", c))
            elif c.tag == "br":
                out.append("\n")
            elif c.tag not in skip:
                if c.tag in BLOCKS:
                    out.append("\n")
                walk(c)
                if c.tag in BLOCKS:
                    out.append("\n")

    walk(node)
    return re.sub(r" *\n[ \n]*", "\n", re.sub(" +", " ", "".join(out))).strip(" \n")


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(max(int(value), 1), MOST_SPAN) if value.isdigit() else 1


def table_rows(table: Node) -> tuple[bool, list[list[str]]]:
    """(whether the first row is a header, rows): a cell that spans stands at its first place, the covered ones are blank.
    Tables within cells come on their own; cells outside any row form one."""
    rows: list[list[Node]] = []

    def collect(node: Node, row: list[Node] | None) -> None:
        for c in node.children:
            if not isinstance(c, Node) or c.tag == "table":
                continue
            if c.tag == "tr":
                own: list[Node] = []
                rows.append(own)
                collect(c, own)
                loose.clear()
            elif c.tag in ("td", "th"):
                if row is not None:
                    row.append(c)
                else:
                    if not loose:
                        loose.append([])
                        rows.append(loose[0])
                    loose[0].append(c)
            else:
                collect(c, row)

    loose: list[list[Node]] = []
    collect(table, None)
    rows = [r for r in rows if r]
    grid: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for c in row:
            while (y, x) in grid:
                x += 1
            for dy in range(min(_span(c, "rowspan"), len(rows) - y)):
                for dx in range(_span(c, "colspan")):
                    grid[y + dy, x + dx] = text_of(c, frozenset(DROPPED | {"table"})) if not dy and not dx else ""
    width = max((x + 1 for _, x in grid), default=0)
    header = bool(rows) and all(c.tag == "th" for c in rows[0])
    return header, [[grid.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def html_tables(text: str) -> list[tuple[str, list[list[str]]]]:
    """(caption, rows) of every table with cells."""
    out = []
    for table in find_all(parse_html(text)[0], "table"):
        rows = table_rows(table)[1]
        caption = next((text_of(c) for c in table.children if isinstance(c, Node) and c.tag == "caption"), "")
        if rows:
            out.append((caption, rows))
    return out


def html_parts(text: str) -> tuple[list[Part], dict[str, int]]:
    """The document's parts, with counts of what was repaired, dropped or flattened."""
    root, counts = parse_html(text)
    counts |= {"dropped": 0, "images": 0, "links": 0, "forms": 0}
    parts: list[Part] = []
    own = Para()

    def flush(style: str = "body", indent: int = 0, bullet: bool | None = None) -> None:
        nonlocal own
        runs = own.runs
        while runs and not runs[0].text.strip(" \n"):
            runs = runs[1:]
        while runs and not runs[-1].text.strip(" \n"):
            runs = runs[:-1]
        if runs:
            runs = [Run(runs[0].text.lstrip(" "), *_look(runs[0])), *runs[1:]]
            runs[-1] = Run(runs[-1].text.rstrip(" "), *_look(runs[-1]))
            parts.append(Para(runs, own.style, own.indent, own.bullet))
        own = Para([], style, indent, bullet)

    def walk(n: Node, look: dict, style: str, depth: int, pre: bool) -> None:
        nonlocal own
        for c in n.children:
            if isinstance(c, str):
                clean = c if pre else re.sub(r"[ \t\n\r\f]+", " ", c)
                if not pre and clean.startswith(" ") and own.runs and own.runs[-1].text.endswith((" ", "\n")):
                    clean = clean[1:]
                if clean and (own.runs or clean.strip() or pre):
                    own.runs.append(Run(clean, **look))
                continue
            t = c.tag
            if t in DROPPED:
                counts["dropped"] += t != "head"
            elif t == "br":
                own.runs.append(Run("\n", **look))
            elif t == "hr":
                flush(style)
                parts.append(Rule())
            elif t == "img":
                counts["images"] += 1
                if c.attributes.get("alt"):
                    own.runs.append(Run(c.attributes["alt"], **look))
            elif t in ("input", "select", "button", "textarea"):
                counts["forms"] += 1
            elif t == "table":
                flush(style)
                header, rows = table_rows(c)
                if rows:
                    parts.append(Table(header, rows))
                for inner in find_all(c, "table"):
                    header, rows = table_rows(inner)
                    if rows:
                        parts.append(Table(header, rows))
            elif t in ("ul", "ol"):
                flush(style)
                walk(c, look, style, depth + 1, pre)
                flush(style)
            elif t == "li":
                flush(style, max(0, depth - 1), n.tag == "ol")
                walk(c, look, style, depth, pre)
                flush(style)
            elif re.fullmatch("h[1-6]", t) or t in ("pre", "blockquote"):
                inner = "code" if t == "pre" else "quote" if t == "blockquote" else t
                flush(inner)
                walk(c, look, inner, depth, t == "pre" or pre)
                flush(style)
            elif t in BLOCKS:
                keep = own if own.bullet is not None and not own.runs else None
                if keep is None:
                    flush(style)
                walk(c, look, style, depth, pre)
                flush(style)
            else:
                more = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "s": "strike", "del": "strike", "strike": "strike", "code": "mono", "kbd": "mono", "samp": "mono", "tt": "mono", "u": "underline", "ins": "underline"}.get(t)
                own_look = look | ({more: True} if more else {})
                if t == "a" and c.attributes.get("href"):
                    counts["links"] += 1
                    own_look = own_look | {"link": c.attributes["href"]}
                walk(c, own_look, style, depth, pre)

    walk(root, {}, "body", 0, False)
    flush()
    return parts, counts


def _look(r: Run) -> tuple:
    return r.bold, r.italic, r.strike, r.mono, r.underline, r.link


def html_to_text(text: str) -> str:
    return to_text(html_parts(text)[0])


def html_to_markdown(text: str) -> str:
    return to_markdown(html_parts(text)[0])


def html_title(text: str) -> str:
    found = find_all(parse_html(text)[0], "title")
    return " ".join(text_of(found[0], frozenset()).split()) if found else ""
