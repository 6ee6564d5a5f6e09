"""Markdown - CommonMark's common part with tables, strikethrough and task lists - into document parts."""

from __future__ import annotations

import re

from tessera.functions.docparts import Para, Part, Rule, Run, Table, joined, to_html, to_text
from tessera.functions.htmltext import decode_entities

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3}|\t)?([-+*]|\d{1,9}[.)])([ \t]+|$)(.*)$")
_ALIGN = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*$")
_FRONT = re.compile(r"---[ \t]*\n((?:[ \t]*(?:[\w.-]+[ \t]*:.*|- .*|#.*|[ \t]+\S.*)?\n)*?)(?:---|\.\.\.)[ \t]*(?:\n|\Z)")


def split_cells(line: str) -> list[str]:
    body = line.strip().removeprefix("|")
    cells = re.split(r"(?<!\\)\|", body)
    if len(cells) > 1 and not cells[-1].strip():
        cells.pop()
    return [c.strip().replace("\\|", "|") for c in cells]


class _Inline:
    _TOKEN = re.compile(
        r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|<(?P<auto>(?:https?|ftp|mailto):[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>"
        r"|(?P<image>!)?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\(\s*<?(?P<target>[^\s<>()]*(?:\([^\s()]*\)[^\s<>()]*)*)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[(?P<ref>[^\]]*)\])?"
        r"|(?P<mark>\*+|_+|~~)|(?P<entity>&(?:#\d+|#[xX][\da-fA-F]+|\w+);)|(?P<br>(?: {2,}|\\)\n)|(?P<tag></?[A-Za-z][^<>]*>)",
        re.S,
    )

    def __init__(self, references: dict[str, str], notes: dict[str, int]):
        self.references, self.notes = references, notes

    def runs(self, text: str, look: dict | None = None) -> list[Run]:
        look = look or {}
        pieces: list = []  # runs, and open marks as [mark, runs so far, can open, can close]
        at = 0

        def plain(x: str) -> None:
            if x:
                pieces.append(Run(re.sub(r" *\n *", " ", x), **look))

        for m in self._TOKEN.finditer(text):
            plain(text[at : m.start()])
            at = m.end()
            if m["escaped"]:
                pieces.append(Run(m["escaped"], **look))
            elif m["code"] is not None:
                code = m["code"].replace("\n", " ")
                pieces.append(Run(code[1:-1] if code[0] == code[-1] == " " and code.strip() else code, **look | {"mono": True}))
            elif m["auto"]:
                pieces.append(Run(m["auto"], **look | {"link": m["auto"] if ":" in m["auto"] else f"mailto:{m['auto']}"}))
            elif m["label"] is not None:
                target = m["target"]
                if target is None:
                    target = self.references.get((m["ref"] or m["label"]).strip().lower())
                if target is None:
                    inner = self.runs(m["label"], look)
                    pieces += [Run(("!" if m["image"] else "") + "[", **look), *inner, Run("]" + (f"[{m['ref']}]" if m["ref"] is not None else ""), **look)]
                elif m["image"]:
                    self.notes["images"] = self.notes.get("images", 0) + 1
                    pieces += self.runs(m["label"], look)
                else:
                    self.notes["links"] = self.notes.get("links", 0) + 1
                    pieces += self.runs(m["label"], look | {"link": target})
            elif m["mark"]:
                before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                opens, closes = bool(after) and not after.isspace(), bool(before) and not before.isspace()
                if m["mark"][0] == "_":
                    opens, closes = opens and not before.isalnum(), closes and not after.isalnum()
                pieces.append([m["mark"], opens, closes])
            elif m["entity"]:
                pieces.append(Run(decode_entities(m["entity"])[0], **look))
            elif m["br"]:
                pieces.append(Run("\n", **look))
            else:
                self.notes["raw_html"] = self.notes.get("raw_html", 0) + 1
                if re.match(r"<br\s*/?>", m["tag"], re.I):
                    pieces.append(Run("\n", **look))
        plain(text[at:])
        return joined(self._marked(pieces, look))

    @staticmethod
    def _marked(pieces: list, look: dict) -> list[Run]:
        """Pairs closing marks with the nearest opening ones of their kind; marks without a partner are text."""
        k = 0
        while k < len(pieces):
            if isinstance(pieces[k], list) and pieces[k][2]:
                close = pieces[k]
                for j in range(k - 1, -1, -1):
                    if isinstance(pieces[j], list) and pieces[j][1] and pieces[j][0][0] == close[0][0] and pieces[j][0]:
                        n = 2 if close[0][0] == "~" or (len(close[0]) > 1 and len(pieces[j][0]) > 1) else 1
                        flag = "strike" if close[0][0] == "~" else "bold" if n == 2 else "italic"
                        for i in range(j + 1, k):
                            if isinstance(pieces[i], Run):
                                pieces[i] = Run(**{f: getattr(pieces[i], f) for f in Run.__dataclass_fields__} | {flag: True})
                        pieces[j][0], close[0] = pieces[j][0][n:], close[0][n:]
                        for i in range(j + 1, k):
                            if isinstance(pieces[i], list):
                                pieces[i][1] = pieces[i][2] = False
                        k -= bool(close[0])
                        break
            k += 1
        return [p if isinstance(p, Run) else Run(p[0], **look) for p in pieces if isinstance(p, Run) or p[0]]


def markdown_parts(text: str) -> tuple[list[Part], dict[str, int]]:
    """Parts, and counts of what was taken off or kept literally (front matter, links, images, raw HTML)."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    notes: dict[str, int] = {}
    front = _FRONT.match(text)
    if front and ":" in front[1]:
        text = text[front.end() :]
        notes["front_matter"] = 1
    lines = text.expandtabs(4).split("\n")
    references: dict[str, str] = {}
    kept = []
    fence = ""
    for line in lines:
        m = _FENCE.match(line)
        if m and not fence:
            fence = m[1]
        elif m and fence and m[1].startswith(fence) and not m[2].strip():
            fence = ""
        d = None if fence else _DEFINITION.match(line)
        if d and not d[1].startswith("^"):
            references.setdefault(d[1].strip().lower(), d[2])
        else:
            kept.append(line)
    inline = _Inline(references, notes)
    parts: list[Part] = []
    _blocks(kept, parts, inline, "body", 0, None)
    return parts, notes


def _blocks(lines: list[str], parts: list[Part], inline: _Inline, style: str, depth: int, bullet: bool | None) -> None:
    """Blocks of some lines; the first paragraph carries the list mark, if there is one."""
    k = 0
    first_bullet = bullet

    def para(text: str, own: str) -> None:
        nonlocal first_bullet
        runs = inline.runs(text.strip())
        if runs or first_bullet is not None:
            parts.append(Para(runs, own if first_bullet is None or own == "code" else style, depth if first_bullet is not None else 0, first_bullet))
            first_bullet = None

    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
            continue
        if m := _FENCE.match(line):
            k += 1
            body = []
            while k < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[k]):
                body.append(lines[k])
                k += 1
            k += 1
            parts.extend(Para([Run(x)] if x else [], "code") for x in ["\n".join(body)])
            continue
        if m := _HEADING.match(line):
            para(m[2] or "", f"h{len(m[1])}")
            k += 1
            continue
        if _RULE.match(line):
            parts.append(Rule())
            k += 1
            continue
        if re.match(r" {0,3}>", line):
            body = []
            while k < len(lines) and lines[k].strip() and (re.match(r" {0,3}>", lines[k]) or not _ITEM.match(lines[k])):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[k]))
                k += 1
            _blocks(body, parts, inline, "quote", depth, None)
            continue
        if (m := _ITEM.match(line)) and (m[4] or not m[3]):
            width = len(m[1] or "") + len(m[2]) + (len(m[3]) if len(m[3]) < 5 and m[4] else 1)
            body = [line[width:]]
            k += 1
            blank = False
            while k < len(lines):
                here = lines[k]
                if not here.strip():
                    blank = True
                elif len(here) - len(here.lstrip()) < width and (blank or _ITEM.match(here) or _HEADING.match(here) or _FENCE.match(here) or _RULE.match(here)):
                    break
                else:
                    blank = False
                body.append(here[min(width, len(here) - len(here.lstrip())) :])
                k += 1
            if task := re.match(r"\[([ xX])\]\s+", body[0]):
                body[0] = ("☑ " if task[1] in "xX" else "☐ ") + body[0][task.end() :]
            nested = bullet is not None or depth > 0
            _blocks(body, parts, inline, style, depth + 1 if nested else depth, m[2][0].isdigit())
            continue
        if line.startswith("    "):
            body = []
            while k < len(lines) and (lines[k].startswith("    ") or not lines[k].strip()):
                body.append(lines[k][4:])
                k += 1
            parts.append(Para([Run("\n".join(body).rstrip("\n"))], "code"))
            continue
        if k + 1 < len(lines) and "|" in line and _ALIGN.match(lines[k + 1]) and len(split_cells(line)) == len(split_cells(lines[k + 1])):
            width = len(split_cells(line))
            rows = [split_cells(line)]
            k += 2
            while k < len(lines) and lines[k].strip() and "|" in lines[k]:
                rows.append([*split_cells(lines[k])[:width], *[""] * (width - len(split_cells(lines[k])))])
                k += 1
            parts.append(Table(True, [["".join(r.text for r in inline.runs(c)) for c in row] for row in rows]))
            continue
        body = [line]
        k += 1
        own = "body"
        while k < len(lines) and lines[k].strip():
            if under := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[k]):
                own = "h1" if under[1][0] == "=" else "h2"
                k += 1
                break
            if _HEADING.match(lines[k]) or _FENCE.match(lines[k]) or _RULE.match(lines[k]) or re.match(r" {0,3}>", lines[k]) or ((i := _ITEM.match(lines[k])) and i[4] and (not i[2][0].isdigit() or i[2][:-1] == "1")):
                break
            body.append(lines[k])
            k += 1
        para("\n".join(x.lstrip() if n else x.lstrip() for n, x in enumerate(body)), own if own != "body" else style)


def markdown_to_html(text: str, title: str = "") -> str:
    return to_html(markdown_parts(text)[0], title)


def markdown_to_text(text: str) -> str:
    return to_text(markdown_parts(text)[0])
