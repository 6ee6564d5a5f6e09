"""Spreadsheets: xlsx and ods into sheets of text, and out of them."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from xml.etree.ElementTree import Element
from xml.sax.saxutils import escape

from tessera.functions.tree import FormatError
from tessera.sources.xmlparts import Container, attribute, local, write_zip

MOST_ROWS, MOST_COLUMNS, MOST_REPEAT = 1_048_576, 16_384, 4096
#: Of a repeated filled row so many copies are given, with a note.
MOST_ROW_REPEAT = 20_000
#: Built-in number formats that show dates or times (fixed values).
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}


@dataclass
class Sheet:
    name: str
    rows: list[list[str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def column_number(ref: str) -> int:
    """A1 -> 0, AA7 -> 26."""
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def serial_date(text: str, epoch_1904: bool = False) -> str:
    """ISO text of a day number; 60 is 1900-02-29; below 1 it is a time of day."""
    value = float(text)
    day, seconds = int(value // 1), round((value % 1) * 86400)
    if seconds == 86400:
        day, seconds = day + 1, 0
    clock = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    if day == 0 and not epoch_1904:
        return clock
    if epoch_1904:
        date = (datetime.date(1904, 1, 1) + datetime.timedelta(day)).isoformat()
    elif day == 60:
        date = "1900-02-29"
    else:
        date = (datetime.date(1899, 12, 31 if day < 60 else 30) + datetime.timedelta(day)).isoformat()
    return date if not seconds else f"{date} {clock}"


def _is_date(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())
    return bool(re.search("[ymdhs]", plain)) and "general" not in plain and not re.search("[#?]", plain)


def _text(node: Element) -> str:
    """All t elements below, but for phonetic readings."""
    if local(node.tag) == "t":
        return node.text or ""
    return "".join(_text(c) for c in node if local(c.tag) != "rPh")


def read_xlsx(data: bytes) -> list[Sheet]:
    z = Container(data)
    book_path = next((t for k, t in z.relations("").values() if k == "officeDocument"), "xl/workbook.xml") if "_rels/.rels" in z.names else "xl/workbook.xml"
    book = z.xml(book_path)
    if book is None:
        raise FormatError("no workbook")
    relations = z.relations(book_path)
    by_kind = {k: t for k, t in relations.values()}
    shared_root = z.xml(by_kind["sharedStrings"]) if "sharedStrings" in by_kind else None
    shared = [_text(si) for si in shared_root] if shared_root is not None else []
    styles = z.xml(by_kind["styles"]) if "styles" in by_kind else None
    dates: list[bool] = []
    if styles is not None:
        own = {int(attribute(n, "numFmtId", "0")): attribute(n, "formatCode", "") for n in styles.iter() if local(n.tag) == "numFmt"}
        for xfs in (n for n in styles if local(n.tag) == "cellXfs"):
            for xf in xfs:
                k = int(attribute(xf, "numFmtId", "0"))
                dates.append(_is_date(own[k]) if k in own else k in DATE_FORMATS)
    epoch_1904 = any(local(n.tag) == "workbookPr" and attribute(n, "date1904", "0") in ("1", "true") for n in book)
    out = []
    for n in (s for group in book if local(group.tag) == "sheets" for s in group):
        kind, path = relations.get(next((v for k, v in n.attrib.items() if k.endswith("}id")), ""), ("", ""))
        sheet = Sheet(attribute(n, "name", ""))
        root = z.xml(path) if kind == "worksheet" else None
        if root is None:
            sheet.notes.append("SHEET_MISSING")
        else:
            _fill(sheet, root, shared, dates, epoch_1904)
        out.append(sheet)
    return out


def _fill(sheet: Sheet, root: Element, shared: list[str], dates: list[bool], epoch_1904: bool) -> None:
    notes: dict[str, int] = {}

    def note(code: str) -> str:
        notes[code] = notes.get(code, 0) + 1
        return ""

    rows: dict[int, dict[int, str]] = {}
    at = -1
    for row in (r for group in root if local(group.tag) == "sheetData" for r in group if local(r.tag) == "row"):
        ref = attribute(row, "r")
        at = int(ref) - 1 if ref and ref.isdigit() else at + 1
        if at >= MOST_ROWS:
            note("CLIPPED")
            break
        x = -1
        for c in (c for c in row if local(c.tag) == "c"):
            ref = attribute(c, "r", "")
            x = column_number(ref) if re.match("[A-Za-z]", ref) else x + 1
            if x >= MOST_COLUMNS:
                note("CLIPPED")
                continue
            value = next((v.text or "" for v in c if local(v.tag) == "v"), None)
            kind = attribute(c, "t", "n")
            if kind == "inlineStr":
                text = "".join(_text(v) for v in c if local(v.tag) == "is")
            elif value is None:
                text = note("NO_CACHED_RESULT") if any(local(v.tag) == "f" for v in c) else ""
            elif kind == "s":
                text = shared[int(value)] if value.isdigit() and int(value) < len(shared) else note("BAD_SHARED_STRING")
            elif kind == "b":
                text = "TRUE" if value == "1" else "FALSE"
            elif kind == "n" and (style := attribute(c, "s", "0")).isdigit() and int(style) < len(dates) and dates[int(style)] and re.fullmatch(r"\d+(\.\d+)?([eE][-+]?\d+)?", value):
                text = serial_date(value, epoch_1904)
            else:
                text = value
            if text:
                rows.setdefault(at, {})[x] = text
    height = max(rows, default=-1) + 1
    width = max((max(r) for r in rows.values()), default=-1) + 1
    sheet.rows = [[rows.get(y, {}).get(x, "") for x in range(width)] for y in range(height)]
    sheet.notes += [f"{k}:{n}" for k, n in notes.items()]


_SPELLING = re.compile(r"-?(0|[1-9]\d*)(\.\d*[1-9])?")


def stays_number(text: str) -> bool:
    """Whether a cell may be stored as a number: its spelling comes back, and 15 digits at most."""
    return bool(_SPELLING.fullmatch(text)) and text != "-0" and sum(c.isdigit() for c in text) <= 15


def sheet_name(name: str, taken: set[str]) -> str:
    """A legal, unique sheet name of up to 31 characters."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name).strip("'")[:31] or "Sheet"
    made, n = base, 2
    while made.lower() in taken:
        made = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        n += 1
    taken.add(made.lower())
    return made


_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def write_xlsx(sheets: list[Sheet]) -> tuple[bytes, list[str]]:
    notes: dict[str, int] = {}
    taken: set[str] = set()
    names, members = [], []
    for k, sheet in enumerate(sheets, 1):
        name = sheet_name(sheet.name, taken)
        if name != sheet.name:
            notes["SHEET_RENAMED"] = notes.get("SHEET_RENAMED", 0) + 1
        names.append(name)
        rows = []
        for y, row in enumerate(sheet.rows, 1):
            cells = []
            for x, text in enumerate(row):
                ref = f"{column_letters(x)}{y}"
                if not text:
                    continue
                if stays_number(text):
                    notes["NUMBERS"] = notes.get("NUMBERS", 0) + 1
                    cells.append(f'<c r="{ref}"><v>{text}</v></c>')
                    continue
                clean = _CONTROLS.sub("", text)
                notes["CONTROLS_DROPPED"] = notes.get("CONTROLS_DROPPED", 0) + (clean != text)
                notes["FORMULA_LIKE"] = notes.get("FORMULA_LIKE", 0) + (text[0] in "=+-@")
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
            rows.append(f'<row r="{y}">{"".join(cells)}</row>')
        members.append((f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(rows)}</sheetData></worksheet>'))
    n = len(sheets)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, n + 1))
    listed = "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, x in enumerate(names, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    package = "http://schemas.openxmlformats.org/package/2006"
    data = write_zip([
        ("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>'),
        ("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>'),
        *members,
    ])
    return data, [f"{k}:{v}" for k, v in notes.items() if v]


# -- OpenDocument -----------------------------------------------------------------------------------------------------


def odf_text(node: Element) -> str:
    """The text of a paragraph: spaces, tabs and breaks have elements of their own; notes and annotations are left out."""
    out = [node.text or ""]
    for c in node:
        kind = local(c.tag)
        if kind == "s":
            out.append(" " * int(attribute(c, "c", "1")))
        elif kind == "tab":
            out.append("\t")
        elif kind == "line-break":
            out.append("\n")
        elif kind not in ("annotation", "note", "tracked-changes"):
            out.append(odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def read_ods(data: bytes) -> list[Sheet]:
    root = Container(data).xml("content.xml")
    if root is None:
        raise FormatError("no content")
    out = []
    for table in (n for n in root.iter() if local(n.tag) == "table"):
        sheet = Sheet(attribute(table, "name", ""))
        rows: list[list[str]] = []
        for row in (n for n in table.iter() if local(n.tag) == "table-row"):
            cells: list[str] = []
            for c in (c for c in row if local(c.tag) in ("table-cell", "covered-table-cell")):
                repeat = int(attribute(c, "number-columns-repeated", "1"))
                paragraphs = [odf_text(p) for p in c if local(p.tag) == "p"] if local(c.tag) == "table-cell" else []
                text = "\n".join(paragraphs) if paragraphs else ""
                if not paragraphs and local(c.tag) == "table-cell":
                    text = attribute(c, "date-value") or attribute(c, "time-value") or attribute(c, "string-value") or attribute(c, "value") or attribute(c, "boolean-value") or ""
                    if text:
                        sheet.notes.append("UNRENDERED_VALUE")
                if attribute(c, "formula") and not text:
                    sheet.notes.append("NO_CACHED_RESULT")
                if repeat > MOST_REPEAT:
                    sheet.notes.append("HUGE_REPEAT")
                    repeat = 1 if not text else MOST_REPEAT
                cells += [text] * repeat
            while cells and not cells[-1]:
                cells.pop()
            repeat = int(attribute(row, "number-rows-repeated", "1"))
            if repeat > MOST_ROW_REPEAT:
                if cells:
                    sheet.notes.append("HUGE_REPEAT")
                repeat = MOST_ROW_REPEAT if cells else 1
            rows += [cells] * repeat
        while rows and not rows[-1]:
            rows.pop()
        width = max(map(len, rows), default=0)
        sheet.rows = [[*r, *[""] * (width - len(r))] for r in rows]
        sheet.notes = sorted(set(sheet.notes))
        out.append(sheet)
    return out


_ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0" xmlns:xlink="http://www.w3.org/1999/xlink" office:version="1.2"'


def odf_escape(text: str) -> str:
    """Text with its tabs, breaks and runs of spaces as elements."""
    out = escape(_CONTROLS.sub("", text)).replace("\t", "<text:tab/>").replace("\n", "<text:line-break/>")
    return re.sub(r"(^ +)|(?<= )( +)", lambda m: f'<text:s text:c="{len(m[0])}"/>', out)


def odf_package(kind: str, content: str, extra: list[tuple[str, str]] | None = None) -> bytes:
    mime = f"application/vnd.oasis.opendocument.{kind}"
    manifest = f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return write_zip([("mimetype", mime), ("content.xml", content), *(extra or []), ("META-INF/manifest.xml", manifest)], ("mimetype",))


def write_ods(sheets: list[Sheet]) -> bytes:
    taken: set[str] = set()
    tables = []
    for sheet in sheets:
        rows = []
        for row in sheet.rows:
            cells = []
            for text in row:
                if not text:
                    cells.append("<table:table-cell/>")
                elif stays_number(text):
                    cells.append(f'<table:table-cell office:value-type="float" office:value="{text}"><text:p>{text}</text:p></table:table-cell>')
                else:
                    cells.append('<table:table-cell office:value-type="string">' + "".join(f"<text:p>{odf_escape(x)}</text:p>" for x in text.split("\n")) + "</table:table-cell>")
            rows.append(f"<table:table-row>{''.join(cells) or '<table:table-cell/>'}</table:table-row>")
        tables.append(f'<table:table table:name="{escape(sheet_name(sheet.name, taken), {chr(34): "&quot;"})}">{"".join(rows)}</table:table>')
    return odf_package("spreadsheet", f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {_ODF}><office:body><office:spreadsheet>{"".join(tables)}</office:spreadsheet></office:body></office:document-content>')
