"""The document model that HTML, Markdown, office and e-book text meet in, and its renderers.

A document is a list of parts: paragraphs of runs with a style, rules, and tables of text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape


@dataclass(frozen=True)
class Run:
    text: str
    bold: bool = False
    italic: bool = False
    strike: bool = False
    mono: bool = False
    underline: bool = False
    link: str | None = None


@dataclass
class Para:
    """style: body, h1 to h6, quote or code. bullet: None, False for a dot, True for a number."""

    runs: list[Run] = field(default_factory=list)
    style: str = "body"
    indent: int = 0
    bullet: bool | None = None

    @property
    def text(self) -> str:
        return "".join(r.text for r in self.runs)


@dataclass
class Rule:
    pass


@dataclass
class Table:
    header: bool
    rows: list[list[str]]


Part = Para | Rule | Table


def square(rows: list[list[str]]) -> list[list[str]]:
    width = max(map(len, rows), default=0)
    return [[*row, *[""] * (width - len(row))] for row in rows]


def _numbers(parts: list[Part]) -> list[int]:
    """The number of each numbered paragraph: counting goes on while its list does."""
    out, counts = [], {}
    for p in parts:
        if isinstance(p, Para) and p.bullet is not None:
            counts = {k: v for k, v in counts.items() if k <= p.indent}
            if p.bullet:
                counts[p.indent] = counts.get(p.indent, 0) + 1
            else:
                counts.pop(p.indent, None)
            out.append(counts.get(p.indent, 0))
        else:
            counts = {}
            out.append(0)
    return out


def to_text(parts: list[Part]) -> str:
    blocks: list[tuple[str, str]] = []
    for p, n in zip(parts, _numbers(parts), strict=True):
        if isinstance(p, Rule):
            blocks.append(("rule", "-" * 20))
        elif isinstance(p, Table):
            blocks.append(("table", "\n".join("\t".join(" ".join(x.split()) for x in row) for row in square(p.rows))))
        elif p.bullet is not None:
            blocks.append(("list", "  " * p.indent + (f"{n}. " if p.bullet else "- ") + p.text))
        elif p.text.strip() or p.style == "code":
            blocks.append((p.style, p.text))
    out = ""
    for k, (kind, text) in enumerate(blocks):
        tight = k and kind == blocks[k - 1][0] and kind in ("list", "code")
        out += ("" if not k else "\n" if tight else "\n\n") + text
    return out + "\n" if out else ""


_MARKS = re.compile(r"([\\`*_\[\]<>])")


def _markdown_run(r: Run) -> str:
    if r.mono:
        ticks = "`" * (max(map(len, re.findall("`+", r.text)), default=0) + 1)
        pad = " " if r.text[:1] == "`" or r.text[-1:] == "`" else ""
        out = ticks + pad + r.text + pad + ticks
    else:
        out = _MARKS.sub(r"\\\1", r.text)
    lead, core, tail = re.fullmatch(r"(\s*)(.*?)(\s*)", out, re.S).groups()
    if core:
        core = f"**{core}**" if r.bold else core
        core = f"*{core}*" if r.italic else core
        core = f"~~{core}~~" if r.strike else core
        core = f"[{core}](<{r.link}>)" if r.link and re.search(r"[\s()]", r.link) else f"[{core}]({r.link})" if r.link else core
    return lead + core + tail


def joined(runs: list[Run]) -> list[Run]:
    """Neighbours of one look become one run."""
    out: list[Run] = []
    for r in runs:
        if out and (out[-1].bold, out[-1].italic, out[-1].strike, out[-1].mono, out[-1].underline, out[-1].link) == (r.bold, r.italic, r.strike, r.mono, r.underline, r.link):
            out[-1] = Run(out[-1].text + r.text, r.bold, r.italic, r.strike, r.mono, r.underline, r.link)
        elif r.text:
            out.append(r)
    return out


def to_markdown(parts: list[Part]) -> str:
    out: list[str] = []
    kinds: list[str] = []
    for p, n in zip(parts, _numbers(parts), strict=True):
        if isinstance(p, Rule):
            text, kind = "---", "rule"
        elif isinstance(p, Table):
            rows = [[re.sub(r"\s*\n\s*", "<br>", x).replace("|", "\\|") for x in row] for row in square(p.rows)]
            if not rows:
                continue
            head, body = (rows[0], rows[1:]) if p.header else ([""] * len(rows[0]), rows)
            text, kind = "\n".join("| " + " | ".join(row) + " |" for row in [head, ["---"] * len(head), *body]), "table"
        elif p.style == "code":
            if kinds and kinds[-1] == "code":
                out[-1] = out[-1][: -len("\n```")] + "\n" + p.text + "\n```"
                continue
            text, kind = f"```\n{p.text}\n```", "code"
        else:
            text, kind = "".join(map(_markdown_run, joined(p.runs))), p.style
            if not text.strip():
                continue
            if p.style[0] == "h":
                text = "#" * int(p.style[1]) + " " + text.replace("\n", " ")
            elif p.style == "quote":
                text = "> " + text.replace("\n", "\n> ")
            elif p.bullet is not None:
                text, kind = "  " * p.indent * (2 if p.bullet else 1) + (f"{n}. " if p.bullet else "- ") + text.replace("\n", " "), "list"
            else:
                text = re.sub(r"(?m)^(\s*)([#>+-]|\d+[.)])(?=\s)", r"\1\\\2", text).replace("\n", "  \n")
        out.append(text)
        kinds.append(kind)
    return "".join(("" if not k else "\n" if kinds[k] == kinds[k - 1] == "list" else "\n\n") + x for k, x in enumerate(out)) + ("\n" if out else "")


def _html_run(r: Run) -> str:
    out = escape(r.text, False).replace("\n", "<br>")
    for on, tag in ((r.mono, "code"), (r.bold, "strong"), (r.italic, "em"), (r.strike, "del"), (r.underline, "u")):
        out = f"<{tag}>{out}</{tag}>" if on else out
    return f'<a href="{escape(r.link)}">{out}</a>' if r.link else out


def to_html_body(parts: list[Part]) -> str:
    out: list[str] = []
    open_lists: list[str] = []

    def close(depth: int) -> None:
        while len(open_lists) > depth:
            out.append(f"</li></{open_lists.pop()}>")

    k = 0
    while k < len(parts):
        p = parts[k]
        if isinstance(p, Para) and p.bullet is not None:
            tag, depth = "ol" if p.bullet else "ul", p.indent + 1
            close(depth)
            if len(open_lists) == depth and open_lists[-1] != tag:
                close(depth - 1)
            if len(open_lists) == depth:
                out.append("</li>")
            while len(open_lists) < depth:
                out.append(f"<{tag}>" if len(open_lists) == depth - 1 else f"<{tag}><li>")
                open_lists.append(tag)
            out.append("<li>" + "".join(map(_html_run, joined(p.runs))))
            k += 1
            continue
        close(0)
        if isinstance(p, Rule):
            out.append("<hr>")
        elif isinstance(p, Table):
            rows = square(p.rows)
            out.append("<table>" + "".join("<tr>" + "".join(f"<{c}>{escape(x, False).replace(chr(10), '<br>')}</{c}>" for x in row) + "</tr>" for i, row in enumerate(rows) for c in ["th" if p.header and not i else "td"]) + "</table>")
        elif p.style == "code":
            lines = [p.text]
            while k + 1 < len(parts) and isinstance(parts[k + 1], Para) and parts[k + 1].style == "code":
                k += 1
                lines.append(parts[k].text)
            out.append("<pre><code>" + escape("\n".join(lines), False) + "</code></pre>")
        else:
            tag = p.style if p.style[0] == "h" else "blockquote" if p.style == "quote" else "p"
            inner = "".join(map(_html_run, joined(p.runs)))
            if inner:
                out.append(f"<{tag}>{inner}</{tag}>")
        k += 1
    close(0)
    return "\n".join(out)


def to_html(parts: list[Part], title: str = "") -> str:
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{escape(title, False)}</title></head>\n<body>\n{to_html_body(parts)}\n</body></html>\n'


def chapters(parts: list[Part]) -> list[tuple[str, list[Part]]]:
    """(title, parts) from each first-level heading on; what stands before the first has no title."""
    out: list[tuple[str, list[Part]]] = []
    for p in parts:
        if isinstance(p, Para) and p.style == "h1":
            out.append((p.text, []))
        elif not out:
            out.append(("", []))
        out[-1][1].append(p)
    return out
