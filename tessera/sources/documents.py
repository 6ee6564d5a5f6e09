"""Word-processor and slide files into document parts, and out of them: docx, odt, pptx, rtf."""

from __future__ import annotations

import re
from xml.etree.ElementTree import Element
from xml.sax.saxutils import escape, quoteattr

from tessera.functions.docparts import Para, Part, Rule, Run, Table, joined, square
from tessera.functions.tree import FormatError
from tessera.sources.sheets import _CONTROLS, _ODF, odf_escape, odf_package
from tessera.sources.xmlparts import Container, attribute, local, write_zip

Notes = dict[str, int]


def _child(node: Element | None, *names: str) -> Element | None:
    for name in names:
        if node is None:
            return None
        node = next((c for c in node if local(c.tag) == name), None)
    return node


def _value(node: Element | None, *names: str, default: str | None = None) -> str | None:
    found = _child(node, *names)
    return default if found is None else attribute(found, "val", default)


def _on(node: Element | None, name: str) -> bool:
    found = _child(node, name)
    return found is not None and attribute(found, "val", "1") not in ("0", "false", "none", "off")


# -- docx -------------------------------------------------------------------------------------------------------------


class _Docx:
    def __init__(self, data: bytes):
        z = Container(data)
        path = next((t for k, t in z.relations("").values() if k == "officeDocument"), "word/document.xml")
        self.root = z.xml(path)
        if self.root is None:
            raise FormatError("no document part")
        self.relations = z.relations(path)
        by_kind = {k: t for k, t in self.relations.values()}
        self.styles: dict[str, str] = {}
        styles = z.xml(by_kind["styles"]) if "styles" in by_kind else None
        for s in styles if styles is not None else ():
            if local(s.tag) == "style":
                level = _value(s, "pPr", "outlineLvl")
                name = (_value(s, "name") or "").lower()
                m = re.fullmatch(r"heading ([1-6])", name)
                own = f"h{m[1]}" if m else "h1" if name == "title" else f"h{int(level) + 1}" if level and level.isdigit() and int(level) < 6 else "quote" if "quote" in name else "code" if "code" in name or "preformatted" in name else ""
                if own:
                    self.styles[attribute(s, "styleId", "")] = own
        self.formats: dict[tuple[str, str], str] = {}
        numbering = z.xml(by_kind["numbering"]) if "numbering" in by_kind else None
        if numbering is not None:
            abstract = {attribute(a, "abstractNumId"): {attribute(v, "ilvl", "0"): _value(v, "numFmt", default="decimal") for v in a if local(v.tag) == "lvl"} for a in numbering if local(a.tag) == "abstractNum"}
            for n in (n for n in numbering if local(n.tag) == "num"):
                for level, kind in abstract.get(_value(n, "abstractNumId"), {}).items():
                    self.formats[attribute(n, "numId", ""), level] = kind
        self.notes: Notes = {}

    def note(self, code: str) -> None:
        self.notes[code] = self.notes.get(code, 0) + 1

    def runs(self, node: Element, link: str | None = None) -> list[Run]:
        out: list[Run] = []
        for c in node:
            kind = local(c.tag)
            if kind == "hyperlink":
                target = self.relations.get(next((v for k, v in c.attrib.items() if k.endswith("}id")), ""))
                self.note("LINKS" if target else "ANCHORS")
                out += self.runs(c, target[1] if target else None)
            elif kind in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "moveTo"):
                out += self.runs(c, link)
            elif kind in ("del", "moveFrom"):
                self.note("DELETED")
            elif kind == "r":
                look = _child(c, "rPr")
                font = _child(look, "rFonts")
                mono = font is not None and bool(re.search("courier|consolas|mono", attribute(font, "ascii", "") or "", re.I))
                text = ""
                for t in c:
                    name = local(t.tag)
                    if name == "t":
                        text += t.text or ""
                    elif name == "tab":
                        text += "\t"
                    elif name in ("br", "cr"):
                        text += "\n"
                    elif name == "noBreakHyphen":
                        text += "-"
                    elif name in ("drawing", "pict", "object"):
                        self.note("DRAWINGS")
                    elif name in ("footnoteReference", "endnoteReference", "commentReference"):
                        self.note("NOTE_REFERENCES")
                    elif name == "sym":
                        self.note("SYMBOLS")
                if text:
                    out.append(Run(text, _on(look, "b"), _on(look, "i"), _on(look, "strike"), mono, _on(look, "u"), link))
        return out

    def parts(self, node: Element) -> list[Part]:
        out: list[Part] = []
        for c in node:
            kind = local(c.tag)
            if kind == "p":
                look = _child(c, "pPr")
                style = self.styles.get(_value(look, "pStyle") or "", "body")
                ident, level = _value(look, "numPr", "numId"), _value(look, "numPr", "ilvl", default="0")
                bullet = None
                if ident and ident != "0":
                    form = self.formats.get((ident, level))
                    if form is None:
                        self.note("UNKNOWN_NUMBERING")
                    bullet = form not in (None, "bullet", "none")
                para = Para(joined(self.runs(c)), style, int(level) if bullet is not None else 0, bullet)
                if para.runs:
                    out.append(para)
            elif kind == "tbl":
                rows = []
                for tr in (r for r in c if local(r.tag) == "tr"):
                    row: list[str] = []
                    for tc in (t for t in tr if local(t.tag) == "tc"):
                        span = int(_value(tc, "tcPr", "gridSpan", default="1") or 1)
                        merged = _child(tc, "tcPr", "vMerge")
                        if any(local(x.tag) == "tbl" for x in tc):
                            self.note("NESTED_TABLES")
                        text = "" if merged is not None and attribute(merged, "val", "continue") == "continue" else "\n".join("".join(r.text for r in self.runs(p)) for p in tc if local(p.tag) == "p")
                        row += [text, *[""] * (span - 1)]
                    rows.append(row)
                header = any(_on(_child(tr, "trPr"), "tblHeader") for tr in c if local(tr.tag) == "tr")
                if rows:
                    out.append(Table(header, square(rows)))
            elif kind in ("sdt", "sdtContent", "body", "ins"):
                out += self.parts(c)
        return out


def read_docx(data: bytes) -> tuple[list[Part], Notes]:
    """Structure from styles and numbering only, never from sizes."""
    doc = _Docx(data)
    return doc.parts(doc.root), doc.notes


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _clean(text: str) -> str:
    return escape(_CONTROLS.sub("", text))


def write_docx(parts: list[Part]) -> bytes:
    links: list[str] = []

    def run(r: Run) -> str:
        look = "".join(x for on, x in ((r.mono, '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>'), (r.bold, "<w:b/>"), (r.italic, "<w:i/>"), (r.strike, "<w:strike/>"), (r.underline, '<w:u w:val="single"/>')) if on)
        pieces = re.split(r"([\n\t])", r.text)
        body = "".join("<w:br/>" if x == "\n" else "<w:tab/>" if x == "\t" else f'<w:t xml:space="preserve">{_clean(x)}</w:t>' for x in pieces if x)
        out = f"<w:r>{f'<w:rPr>{look}</w:rPr>' if look else ''}{body}</w:r>"
        if r.link:
            links.append(r.link)
            return f'<w:hyperlink r:id="link{len(links)}">{out}</w:hyperlink>'
        return out

    def para(p: Para) -> str:
        look = f'<w:pStyle w:val="{ {"quote": "Quote", "code": "Code"}.get(p.style, "Heading" + p.style[1:])}"/>' if p.style != "body" else ""
        look += f'<w:numPr><w:ilvl w:val="{min(p.indent, 8)}"/><w:numId w:val="{2 if p.bullet else 1}"/></w:numPr>' if p.bullet is not None else ""
        return f"<w:p>{f'<w:pPr>{look}</w:pPr>' if look else ''}{''.join(map(run, joined(p.runs)))}</w:p>"

    body = []
    for p in parts:
        if isinstance(p, Para):
            body.append(para(p))
        elif isinstance(p, Rule):
            body.append('<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="6"/></w:pBdr></w:pPr></w:p>')
        else:
            rows = "".join(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if p.header and not k else ''}{''.join(f'<w:tc>{para(Para([Run(x)] if x else []))}</w:tc>' for x in row)}</w:tr>" for k, row in enumerate(square(p.rows)))
            body.append(f"<w:tbl>{rows}</w:tbl>")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr></w:style>' for k in range(1, 7))
    styles += '<w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="Quote"/></w:style><w:style w:type="paragraph" w:styleId="Code"><w:name w:val="Code"/></w:style>'
    levels = ["".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{"•" if kind == "bullet" else f"%{k + 1}."}"/></w:lvl>' for k in range(9)) for kind in ("bullet", "decimal")]
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{k}">{x}</w:abstractNum>' for k, x in enumerate(levels)) + "".join(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(2))
    document = f'{_HEAD}<w:document xmlns:w="{_W}" xmlns:r="{_OFFICE}"><w:body>{"".join(body)}</w:body></w:document>'
    external = "".join(f'<Relationship Id="link{k}" Type="{_OFFICE}/hyperlink" Target={quoteattr(x)} TargetMode="External"/>' for k, x in enumerate(links, 1))
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    return write_zip([
        ("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{word}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{word}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{word}.numbering+xml"/></Types>'),
        ("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", document),
        ("word/styles.xml", f'{_HEAD}<w:styles xmlns:w="{_W}">{styles}</w:styles>'),
        ("word/numbering.xml", f'{_HEAD}<w:numbering xmlns:w="{_W}">{numbering}</w:numbering>'),
        ("word/_rels/document.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/styles" Target="styles.xml"/><Relationship Id="rId2" Type="{_OFFICE}/numbering" Target="numbering.xml"/>{external}</Relationships>'),
    ])


# -- odt --------------------------------------------------------------------------------------------------------------


def read_odt(data: bytes) -> tuple[list[Part], Notes]:
    z = Container(data)
    root = z.xml("content.xml")
    if root is None:
        raise FormatError("no content")
    notes: Notes = {}
    looks: dict[str, dict] = {}
    numbered: dict[str, list[bool]] = {}
    styles = z.xml("styles.xml")
    for tree in (styles, root):
        for s in tree.iter() if tree is not None else ():
            if local(s.tag) == "style":
                text = _child(s, "text-properties")
                found = dict(looks.get(attribute(s, "parent-style-name", ""), {}))
                if text is not None:
                    found |= {k: v for k, v in (("bold", attribute(text, "font-weight") == "bold"), ("italic", attribute(text, "font-style") == "italic"), ("underline", attribute(text, "text-underline-style", "none") != "none"), ("strike", attribute(text, "text-line-through-style", "none") != "none"), ("mono", bool(re.search("mono|courier", attribute(text, "font-name", "") or "", re.I)))) if v}
                looks[attribute(s, "name", "")] = found
            elif local(s.tag) == "list-style":
                numbered[attribute(s, "name", "")] = [local(v.tag) == "list-level-style-number" for v in s if local(v.tag).startswith("list-level-style")]

    def note(code: str) -> None:
        notes[code] = notes.get(code, 0) + 1

    def runs(node: Element, look: dict) -> list[Run]:
        out = [Run(node.text, **look)] if node.text else []
        for c in node:
            kind = local(c.tag)
            if kind == "span":
                out += runs(c, look | looks.get(attribute(c, "style-name", ""), {}))
            elif kind == "a":
                out += runs(c, look | {"link": attribute(c, "href")})
            elif kind == "s":
                out.append(Run(" " * int(attribute(c, "c", "1")), **look))
            elif kind == "tab":
                out.append(Run("\t", **look))
            elif kind == "line-break":
                out.append(Run("\n", **look))
            elif kind in ("note", "annotation", "frame", "math"):
                note(kind.upper())
            else:
                out += runs(c, look)
            if c.tail:
                out.append(Run(c.tail, **look))
        return out

    def parts(node: Element, depth: int = 0, style_name: str | None = None) -> list[Part]:
        out: list[Part] = []
        for c in node:
            kind = local(c.tag)
            if kind in ("p", "h"):
                level = attribute(c, "outline-level", "1")
                found = joined(runs(c, {k: v for k, v in looks.get(attribute(c, "style-name", ""), {}).items() if kind == "p"}))
                if found:
                    name = attribute(c, "style-name", "") or ""
                    style = f"h{min(int(level), 6)}" if kind == "h" else "quote" if "Quot" in name else "code" if "Preformatted" in name else "body"
                    levels = numbered.get(style_name or "", [])
                    bullet = (levels[depth - 1] if depth - 1 < len(levels) else False) if depth and not out else None
                    out.append(Para(found, style, max(0, depth - 1) if bullet is not None else 0, bullet))
            elif kind == "list":
                own = attribute(c, "style-name", style_name)
                for item in c:
                    out += parts(item, depth + 1, own)
            elif kind == "table":
                rows = []
                for row in (r for r in c.iter() if local(r.tag) == "table-row"):
                    cells: list[str] = []
                    for cell in (x for x in row if local(x.tag) in ("table-cell", "covered-table-cell")):
                        text = "\n".join("".join(r.text for r in runs(p, {})) for p in cell if local(p.tag) in ("p", "h")) if local(cell.tag) == "table-cell" else ""
                        cells += [text] * min(int(attribute(cell, "number-columns-repeated", "1")), 512)
                    rows.append(cells)
                header = any(local(x.tag) == "table-header-rows" for x in c)
                if rows:
                    out.append(Table(header, square(rows)))
            elif kind in ("section", "text", "table-of-content", "index-body", "body"):
                out += parts(c, depth, style_name)
            elif kind == "tracked-changes":
                note("REVISIONS")
        return out

    return parts(root), notes


def write_odt(parts: list[Part]) -> bytes:
    names: dict[tuple, str] = {}

    def run(r: Run) -> str:
        look = (r.bold, r.italic, r.strike, r.mono, r.underline)
        body = odf_escape(r.text)
        if any(look):
            body = f'<text:span text:style-name="{names.setdefault(look, f"T{len(names) + 1}")}">{body}</text:span>'
        return f"<text:a xlink:type=\"simple\" xlink:href={quoteattr(r.link)}>{body}</text:a>" if r.link else body

    body, k = [], 0
    while k < len(parts):
        p = parts[k]
        if isinstance(p, Rule):
            body.append('<text:p text:style-name="Horizontal_20_Line"/>')
        elif isinstance(p, Table):
            rows = ["".join(f'<table:table-cell office:value-type="string">{"".join(f"<text:p>{odf_escape(x)}</text:p>" for x in c.split(chr(10)))}</table:table-cell>' for c in row) for row in square(p.rows)]
            rows = [f"<table:table-row>{x}</table:table-row>" for x in rows]
            if p.header and rows:
                rows[0] = f"<table:table-header-rows>{rows[0]}</table:table-header-rows>"
            body.append(f"<table:table>{''.join(rows)}</table:table>")
        else:
            inner = "".join(map(run, joined(p.runs)))
            if p.bullet is not None:
                open_, close = '<text:list text:style-name="' + ("Number" if p.bullet else "Bullet") + '"><text:list-item>', "</text:list-item></text:list>"
                body.append(open_ * (p.indent + 1) + f"<text:p>{inner}</text:p>" + close * (p.indent + 1))
            elif p.style[0] == "h":
                body.append(f'<text:h text:outline-level="{p.style[1]}">{inner}</text:h>')
            else:
                style = {"quote": ' text:style-name="Quotations"', "code": ' text:style-name="Preformatted_20_Text"'}.get(p.style, "")
                body.append(f"<text:p{style}>{inner}</text:p>")
        k += 1
    looks = "".join(
        f'<style:style style:name="{name}" style:family="text"><style:text-properties{" fo:font-weight=" + chr(34) + "bold" + chr(34) if b else ""}{" fo:font-style=" + chr(34) + "italic" + chr(34) if i else ""}{" style:text-line-through-style=" + chr(34) + "solid" + chr(34) if s else ""}{" style:font-name=" + chr(34) + "Courier" + chr(34) if m else ""}{" style:text-underline-style=" + chr(34) + "solid" + chr(34) if u else ""}/></style:style>'
        for (b, i, s, m, u), name in names.items()
    )
    lists = "".join(f'<text:list-style style:name="{name}">' + "".join(f'<text:list-level-style-{kind} text:level="{n}" {more}/>' for n in range(1, 10)) + "</text:list-style>" for name, kind, more in (("Bullet", "bullet", 'text:bullet-char="•"'), ("Number", "number", 'style:num-format="1"')))
    return odf_package("text", f'{_HEAD}<office:document-content {_ODF}><office:automatic-styles>{looks}{lists}</office:automatic-styles><office:body><office:text>{"".join(body)}</office:text></office:body></office:document-content>')


# -- pptx -------------------------------------------------------------------------------------------------------------


def read_pptx(data: bytes) -> tuple[list[Part], Notes]:
    """Slides in their order: titles as second-level headings, text by level, tables; pictures and charts are counted."""
    z = Container(data)
    path = next((t for k, t in z.relations("").values() if k == "officeDocument"), "ppt/presentation.xml")
    root = z.xml(path)
    if root is None:
        raise FormatError("no presentation")
    relations = z.relations(path)
    notes: Notes = {}
    out: list[Part] = []

    def note(code: str) -> None:
        notes[code] = notes.get(code, 0) + 1

    def para(p: Element, title: bool, links: dict) -> Para:
        runs = []
        for r in p:
            kind = local(r.tag)
            if kind in ("r", "fld"):
                look = _child(r, "rPr")
                hit = _child(look, "hlinkClick")
                target = links.get(next((v for k, v in hit.attrib.items() if k.endswith("}id")), "")) if hit is not None else None
                text = "".join(t.text or "" for t in r if local(t.tag) == "t")
                flag = {} if look is None else {"bold": look.get("b") == "1", "italic": look.get("i") == "1", "strike": look.get("strike", "noStrike") != "noStrike", "underline": look.get("u", "none") != "none"}
                runs.append(Run(text, **flag, link=target[1] if target and target[0] == "hyperlink" else None))
            elif kind == "br":
                runs.append(Run("\n"))
        look = _child(p, "pPr")
        level = int(look.get("lvl", "0")) if look is not None else 0
        bullet = True if _child(look, "buAutoNum") is not None else False if _child(look, "buChar") is not None else None
        return Para(joined(runs), "h2" if title else "body", 0 if bullet is None else level, None if title else bullet)

    for n in (s for group in root if local(group.tag) == "sldIdLst" for s in group):
        _, slide_path = relations.get(next((v for k, v in n.attrib.items() if k.endswith("}id")), ""), ("", ""))
        slide = z.xml(slide_path) if slide_path else None
        if slide is None:
            note("MISSING_PART")
            continue
        links = z.relations(slide_path)
        for shape in slide.iter():
            kind = local(shape.tag)
            if kind == "sp":
                place = next((attribute(x, "type", "") for x in shape.iter() if local(x.tag) == "ph"), None)
                if place in ("sldNum", "dt", "ftr"):
                    note("FIELDS")
                    continue
                body = _child(shape, "txBody")
                out += [q for q in (para(p, place in ("title", "ctrTitle"), links) for p in (body if body is not None else ()) if local(p.tag) == "p") if q.text.strip()]
            elif kind == "tbl":
                rows = [["\n".join(para(p, False, links).text for p in tc.iter() if local(p.tag) == "p") if attribute(tc, "hMerge") is None and attribute(tc, "vMerge") is None else "" for tc in tr if local(tc.tag) == "tc"] for tr in shape if local(tr.tag) == "tr"]
                look = _child(shape, "tblPr")
                if rows:
                    out.append(Table(look is not None and look.get("firstRow") == "1", square(rows)))
            elif kind in ("pic", "chart", "oleObj"):
                note({"pic": "PICTURES", "chart": "CHARTS", "oleObj": "OBJECTS"}[kind])
    return out, notes


# -- rtf --------------------------------------------------------------------------------------------------------------

_RTF = re.compile(rb"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
_CHARS = {"par": "\n", "line": "\v", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}
_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "headerl", "headerr", "footerl", "footerr", "footnote", "annotation", "listtable", "listoverridetable", "themedata", "colorschememapping", "latentstyles", "datastore", "xmlnstbl", "generator", "fldinst", "rsidtbl"}


def read_rtf(data: bytes) -> tuple[list[Part], Notes]:
    """Paragraphs with bold, italic, underline and strike, outline levels, lists by their marks, and tables."""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise FormatError("no RTF")
    notes: Notes = {}
    page = int(m[1]) if (m := re.search(rb"\\ansicpg(\d+)", data[:4096])) else 1252
    try:
        b"".decode(f"cp{page}")
        codec = f"cp{page}"
    except LookupError:
        codec, notes["OTHER_CODEPAGE"] = "cp1252", 1
    # list styles: whether a list's first level is numbered
    table = data[m.start() :] if (m := re.search(rb"\{\\\*?\\?listtable", data)) else b""
    numbered = {x: not re.search(rb"\\levelnfcn?23", body) for body, x in re.findall(rb"\{\\list(?![a-z])(.*?)\\listid(-?\d+)", table, re.S)}
    overrides = {n: numbered.get(x, False) for x, n in re.findall(rb"\\listoverride\\listid(-?\d+).*?\\ls(\d+)", data, re.S)}

    look0 = {"b": False, "i": False, "ul": False, "strike": False}
    state = {"look": look0, "skip": False, "uc": 1}
    stack: list[dict] = []
    out: list[Part] = []
    runs: list[Run] = []
    para = {"outline": None, "ls": None, "level": 0, "table": False}
    row: list[str] = []
    cell: list[str] = []
    pending, waiting = b"", 0

    def text(x: str) -> None:
        nonlocal waiting
        if waiting:
            x, waiting = x[waiting:], max(0, waiting - len(x))
        if x and not state["skip"]:
            lk = state["look"]
            runs.append(Run(x, lk["b"], lk["i"], lk["strike"], False, lk["ul"]))

    def flush_bytes() -> None:
        nonlocal pending
        if pending:
            decoded = pending.decode(codec, "replace")
            if "�" in decoded:
                notes["UNDECODABLE"] = notes.get("UNDECODABLE", 0) + 1
            pending = b""
            text(decoded)

    def end_para() -> None:
        nonlocal runs
        if para["table"]:
            cell.append("".join(r.text for r in runs).replace("\v", "\n"))
        elif any(r.text.strip() for r in runs):
            style = f"h{para['outline'] + 1}" if para["outline"] is not None and para["outline"] < 6 else "body"
            bullet = overrides.get(para["ls"], False) if para["ls"] not in (None, b"0") else None
            if table_rows:
                end_table()
            out.append(Para(joined([Run(r.text.replace("\v", "\n"), r.bold, r.italic, r.strike, r.mono, r.underline, r.link) for r in runs]), style, para["level"] if bullet is not None else 0, bullet))
        runs = []

    table_rows: list[list[str]] = []

    def end_table() -> None:
        if table_rows:
            out.append(Table(False, square([*table_rows])))
            table_rows.clear()

    depth = 0
    for m in _RTF.finditer(data):
        word, number, hexed, symbol, brace, plain = m.groups()
        if hexed:
            if waiting:
                waiting -= 1
            else:
                pending += bytes([int(hexed, 16)])
            continue
        flush_bytes()
        if plain:
            text(plain.decode(codec, "replace"))
        elif brace == b"{":
            stack.append(state)
            state, depth = dict(state, look=dict(state["look"])), depth + 1
        elif brace == b"}":
            if stack:
                state, depth = stack.pop(), depth - 1
        elif symbol:
            s = symbol.decode("latin-1")
            if s == "*":
                state["skip"] = True
                notes["SKIPPED_GROUPS"] = notes.get("SKIPPED_GROUPS", 0) + 1
            elif s in "\\{}":
                text(s)
            elif s == "~":
                text("\xa0")
            elif s == "_":
                text("-")
            elif s in "\r\n":
                end_para()
        elif word:
            w, n = word.decode(), int(number) if number else None
            if w in _SKIPPED:
                state["skip"] = True
                if w in ("pict", "object", "footnote"):
                    notes[w.upper()] = notes.get(w.upper(), 0) + 1
            elif state["skip"]:
                continue
            elif w == "par" or w == "sect":
                end_para()
            elif w == "cell":
                end_para()
                row.append("\n".join(x for x in cell))
                cell.clear()
            elif w == "row":
                table_rows.append([*row])
                row.clear()
            elif w == "pard":
                para.update(outline=None, ls=None, level=0, table=False)
            elif w == "intbl":
                para["table"] = True
            elif w == "outlinelevel":
                para["outline"] = n
            elif w == "ls":
                para["ls"] = number
            elif w == "ilvl":
                para["level"] = n or 0
            elif w == "plain":
                state["look"] = dict(look0)
            elif w in ("b", "i", "strike"):
                state["look"][w] = n != 0
            elif w in ("ul", "ulnone"):
                state["look"]["ul"] = w == "ul" and n != 0
            elif w == "uc":
                state["uc"] = n or 0
            elif w == "u" and n is not None:
                code = n + 65536 if n < 0 else n
                text(chr(code) if code < 0x110000 else "�")
                waiting = state["uc"]
            elif w in _CHARS:
                text(_CHARS[w])
            elif w == "bin":
                notes["BINARY"] = notes.get("BINARY", 0) + 1
    flush_bytes()
    end_para()
    end_table()
    if depth:
        notes["TRUNCATED"] = 1
    # halves of a pair, each written as its own number, become one character
    for p in out:
        if isinstance(p, Para):
            p.runs = [Run(r.text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"), r.bold, r.italic, r.strike, r.mono, r.underline, r.link) for r in p.runs]
        elif isinstance(p, Table):
            p.rows = [[x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for x in r] for r in p.rows]
    return out, notes


def write_rtf(parts: list[Part]) -> str:
    """ASCII only; characters beyond are written as signed UTF-16 numbers."""

    def put(text: str) -> str:
        out = []
        for c in text:
            if c in "\\{}":
                out.append("\\" + c)
            elif c == "\n":
                out.append("\\line ")
            elif c == "\t":
                out.append("\\tab ")
            elif " " <= c <= "~":
                out.append(c)
            elif c >= "\x80":
                raw = c.encode("utf-16-le", "surrogatepass")
                out += [f"\\u{int.from_bytes(raw[k : k + 2], 'little', signed=True)}?" for k in range(0, len(raw), 2)]
        return "".join(out)

    def run(r: Run) -> str:
        look = "".join(x for on, x in ((r.bold, "\\b"), (r.italic, "\\i"), (r.strike, "\\strike"), (r.underline, "\\ul")) if on)
        return f"{{{look} {put(r.text)}}}" if look else put(r.text)

    out = ["{\\rtf1\\ansi\\ansicpg1252\\uc1"]
    out.append("{\\*\\listtable{\\list{\\listlevel\\levelnfc23}\\listid1}{\\list{\\listlevel\\levelnfc0}\\listid2}}{\\*\\listoverridetable{\\listoverride\\listid1\\ls1}{\\listoverride\\listid2\\ls2}}")
    for p in parts:
        if isinstance(p, Rule):
            out.append("\\pard\\brdrb\\brdrs\\par")
        elif isinstance(p, Table):
            for row in square(p.rows):
                out.append("\\trowd" + "".join(f"\\cellx{2000 * (k + 1)}" for k in range(len(row))) + "".join(f"\\pard\\intbl {put(x)}\\cell" for x in row) + "\\row")
        else:
            look = f"\\outlinelevel{int(p.style[1]) - 1}" if re.fullmatch("h[1-6]", p.style) else ""
            look += f"\\ls{2 if p.bullet else 1}\\ilvl{p.indent}" if p.bullet is not None else ""
            out.append(f"\\pard{look} {''.join(map(run, joined(p.runs)))}\\par")
    return "\n".join(out) + "\n}"
