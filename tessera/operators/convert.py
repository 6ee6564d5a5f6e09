"""Conversions of files: (file_id, name, content) in, one row for every output with its notes out, an error row for what is refused.

Kernels are plain functions from bytes to outputs; here they run in Arrow batches, whose size the session bounds in bytes, so a task
holds a few files at a time. A file that fails doesn't touch the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import charset, config, csvtext, docparts, htmltext, markdown, sniff, sqldump, subtitles, tree, xmltext, yamltext
from tessera.operators import audio, structure
from tessera.sources import archives, books, documents, flac, imagemeta, legacy, matroska, pdfpages, pdfread, pdfwrite, rasters, sevenzip, sheets

#: Texts over this many bytes are refused, as whole files are parsed in memory.
MOST_TEXT = 64 << 20

Output = tuple[str, bytes]  # suffix of the name, content
Kernel = Callable[..., tuple[list[Output], list[str]]]
KERNELS: dict[str, Kernel] = {}


def _stem(name: str) -> str:
    last = name.replace("\\", "/").rsplit("/", 1)[-1]
    return last.rpartition(".")[0] or last


def _text(data: bytes) -> str:
    if len(data) > MOST_TEXT:
        raise tree.FormatError("too large for a text")
    return charset.decode(data)[0]


def _one(ext: str, text: str | bytes, notes: list[str] | None = None) -> tuple[list[Output], list[str]]:
    return [(f".{ext}", text if isinstance(text, bytes) else text.encode())], notes or []


# -- trees and tables ---------------------------------------------------------------------------------------------------

PARSERS: dict[str, Callable[[str], object]] = {"json": tree.parse_json, "yaml": yamltext.parse_yaml, "toml": config.parse_toml, "ini": config.parse_ini, "xml": xmltext.parse_xml}


def _render(kind: str, x, indent: int = 2, root: str = "root") -> str:
    if kind == "json":
        return tree.render_json(x, indent) + "\n"
    if kind == "yaml":
        return yamltext.render_yaml(x, indent)
    if kind == "toml":
        return config.render_toml(x)
    return config.render_ini(x) if kind == "ini" else xmltext.render_xml(x, root or "root", "item", indent)


def _tree_to_tree(source: str, target: str) -> Kernel:
    def run(data: bytes, name: str, indent: int = 2, root: str = "") -> tuple[list[Output], list[str]]:
        found = PARSERS[source](_text(data))
        if source == "ini" and target == "toml" and isinstance(found.get(""), dict):
            found = {"global" if not k else k: v for k, v in found.items()}
        elif source == "ini" and target != "toml" and isinstance(found.get(""), dict):
            found = found.pop("") | found
        return _one(target, _render(target, found, indent, root))

    return run


def _rows_of(source: str, text: str) -> tuple[list[str], list[list[str]], list[str]]:
    found = PARSERS[source](text)
    if source == "xml":
        columns, rows, _, notes = xmltext.pick_rows(found)
        return columns, rows, notes
    if source == "toml" and isinstance(found, dict):
        arrays = [v for v in found.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)]
        if len(arrays) != 1:
            raise tree.FormatError("a table needs exactly one array of tables")
        found = arrays[0]
    return tree.to_table(found)


def _tree_to_csv(source: str) -> Kernel:
    def run(data: bytes, name: str, delimiter: str = ",", eol: str = "lf", quote_all: bool = False) -> tuple[list[Output], list[str]]:
        columns, rows, notes = _rows_of(source, _text(data))
        return _one("csv", csvtext.render_csv([columns, *rows], delimiter, charset.EOLS[eol], quote_all), notes)

    return run


def _tree_to_xlsx(source: str) -> Kernel:
    def run(data: bytes, name: str) -> tuple[list[Output], list[str]]:
        columns, rows, notes = _rows_of(source, _text(data))
        book, more = sheets.write_xlsx([sheets.Sheet(_stem(name), [columns, *rows])])
        return _one("xlsx", book, [*notes, *more])

    return run


for _a, _b in [("yaml", "json"), ("toml", "json"), ("json", "toml"), ("toml", "yaml"), ("yaml", "toml"), ("ini", "json"), ("json", "ini"), ("ini", "yaml"), ("yaml", "ini"), ("toml", "ini"), ("ini", "toml"), ("json", "yaml"), ("xml", "json"), ("json", "xml"), ("xml", "yaml"), ("yaml", "xml")]:
    KERNELS[f"{_a}_to_{_b}"] = _tree_to_tree(_a, _b)
for _a in ("json", "yaml", "toml", "xml"):
    KERNELS[f"{_a}_to_csv"] = _tree_to_csv(_a)
    KERNELS[f"{_a}_to_xlsx"] = _tree_to_xlsx(_a)


def kernel(f: Kernel) -> Kernel:
    KERNELS[f.__name__] = f
    return f


@kernel
def format_json(data: bytes, name: str, pretty: bool = True, indent: int = 2, sort_keys: bool = False, ascii_only: bool = False):
    return _one("json", tree.render_json(tree.parse_json(_text(data)), indent if pretty else None, sort_keys, ascii_only) + "\n")


def _records(data: bytes) -> tuple[list[list[str]], list[str]]:
    records = csvtext.parse_csv(_text(data))
    if not records:
        raise tree.FormatError("the table is empty")
    ragged = csvtext.ragged_rows(records)
    return records, [f"RAGGED:{len(ragged)}"] if ragged else []


@kernel
def csv_to_json(data: bytes, name: str, header: bool = True, infer: bool = False, indent: int = 2):
    records, notes = _records(data)
    return _one("json", tree.render_json(tree.from_records(records, header, infer), indent) + "\n", notes + ["SPELLING_LOST"] * infer)


@kernel
def csv_to_yaml(data: bytes, name: str, header: bool = True, indent: int = 2):
    records, notes = _records(data)
    return _one("yaml", yamltext.render_yaml(tree.from_records(records, header), indent), notes)


@kernel
def csv_to_xml(data: bytes, name: str, root: str = "rows", header: bool = True):
    records, notes = _records(data)
    rows = tree.from_records(records, header)
    return _one("xml", xmltext.render_xml([x if isinstance(x, dict) else {f"c{k}": v for k, v in enumerate(x, 1)} for x in rows], root or "rows", "row"), notes)


@kernel
def csv_to_html(data: bytes, name: str, title: str = "", header: bool = True):
    records, notes = _records(data)
    return _one("html", docparts.to_html([docparts.Table(header, records)], title or _stem(name)), notes)


@kernel
def csv_to_xlsx(data: bytes, name: str):
    records, notes = _records(data)
    book, more = sheets.write_xlsx([sheets.Sheet(_stem(name), records)])
    return _one("xlsx", book, notes + more)


@kernel
def csv_to_ods(data: bytes, name: str):
    records, notes = _records(data)
    return _one("ods", sheets.write_ods([sheets.Sheet(_stem(name), records)]), notes)


@kernel
def sql_to_csv(data: bytes, name: str, table: str = ""):
    tables, notes = sqldump.parse_dump(_text(data))
    tables = [t for t in tables if not table or t.name == table]
    if not tables:
        raise tree.FormatError("no table")
    return [(f"_{t.name}.csv", t.to_csv().encode()) for t in tables], notes


# -- text ---------------------------------------------------------------------------------------------------------------


@kernel
def convert_text_encoding(data: bytes, name: str, source: str | None = None, target: str = "utf-8", bom: bool = False, eol: str = "lf"):
    text, found, notes = charset.decode(data, source)
    if any(n.startswith("REPLACED") for n in notes):
        raise tree.FormatError(f"not every byte is {found}")
    return _one("txt", charset.encode(charset.to_eol(text, eol), target, bom), notes)


@kernel
def convert_subtitle(data: bytes, name: str, target: str = "srt", source: str | None = None):
    cues = subtitles.parse_cues(charset.decode(data, source)[0])
    return _one(target, subtitles.render_cues(cues, target), subtitles.cue_notes(cues, target))


@kernel
def extract_subtitles(data: bytes, name: str):
    return _one("srt", subtitles.render_cues(matroska.read_subtitles(data), "srt"))


@kernel
def html_to_csv(data: bytes, name: str, delimiter: str = ",", eol: str = "lf"):
    found = htmltext.html_tables(_text(data))
    if not found:
        raise tree.FormatError("no table")
    return [(f"_{k}.csv", csvtext.render_csv(rows, delimiter, charset.EOLS[eol]).encode()) for k, (_, rows) in enumerate(found, 1)], []


def _pdf_lines(data: bytes) -> list[dict]:
    pages = pdfread.read_pdf(data)
    lines = [dict(line, page=k) for k, words in enumerate(pages, 1) for line in pdfread.lines_of(words)]
    if not lines:
        raise tree.FormatError("the PDF has no text layer")
    return lines


def _pdf_parts(data: bytes) -> tuple[list[docparts.Part], dict[str, int]]:
    return structure.lines_to_parts(_pdf_lines(data)), {}


@kernel
def pdf_to_text(data: bytes, name: str):
    lines = _pdf_lines(data)
    pages = [[x["text"] for x in lines if x["page"] == k] for k in range(1, max(x["page"] for x in lines) + 1)]
    return _one("txt", "\f".join("\n".join(p) + "\n" for p in pages))


def _pdf_tables(data: bytes) -> list[list[list[str]]]:
    found = [t for words in pdfread.read_pdf(data) for t in structure.page_tables([(w["text"], w["left"], w["right"], w["top"], w["bottom"]) for w in words])]
    if not found:
        raise tree.FormatError("no table is found")
    return found


@kernel
def pdf_to_csv(data: bytes, name: str, delimiter: str = ",", eol: str = "lf"):
    return [(f"_{k}.csv", csvtext.render_csv(t, delimiter, charset.EOLS[eol]).encode()) for k, t in enumerate(_pdf_tables(data), 1)], []


@kernel
def pdf_to_xlsx(data: bytes, name: str):
    book, notes = sheets.write_xlsx([sheets.Sheet(f"Table {k}", t) for k, t in enumerate(_pdf_tables(data), 1)])
    return _one("xlsx", book, notes)


def _one_pdf(pages: list[pdfpages.Page], properties: dict[str, str] | None = None) -> tuple[list[Output], list[str]]:
    return _one("pdf", pdfpages.build(pages, properties))


@kernel
def extract_pdf_pages(data: bytes, name: str, spec: str = "1-"):
    pages = pdfpages.read(data)
    return _one_pdf([pages[k] for k in pdfpages.parse_spec(spec, len(pages))])


@kernel
def pdf_reorder(data: bytes, name: str, spec: str = "1-"):
    return extract_pdf_pages(data, name, spec)


@kernel
def remove_pdf_pages(data: bytes, name: str, spec: str = "1"):
    pages = pdfpages.read(data)
    gone = set(pdfpages.parse_spec(spec, len(pages)))
    return _one_pdf([p for k, p in enumerate(pages) if k not in gone])


@kernel
def rotate_pdf_pages(data: bytes, name: str, spec: str = "1-", degrees: int = 90):
    pages = pdfpages.read(data)
    return _one_pdf(pdfpages.rotated(pages, set(pdfpages.parse_spec(spec, len(pages))), degrees))


@kernel
def split_pdf_into_parts(data: bytes, name: str, parts: int = 2):
    pages = pdfpages.read(data)
    n = min(max(parts, 1), len(pages))
    cuts = [k * (len(pages) // n) + min(k, len(pages) % n) for k in range(n + 1)]
    return [(f"_part{k:02d}.pdf", pdfpages.build(pages[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1)], []


@kernel
def split_pdf_by_size(data: bytes, name: str, target_bytes: int = 8 << 20):
    groups = pdfpages.by_size(pdfpages.read(data), target_bytes)
    built = [pdfpages.build(g) for g in groups]
    return [(f"_part{k:02d}.pdf", b) for k, b in enumerate(built, 1)], [f"OVER_TARGET:{n}" for n in [sum(len(b) > target_bytes for b in built)] if n]


@kernel
def split_pdf_by_outline(data: bytes, name: str):
    pages, marks = pdfpages.read(data), pdfpages.outline(data)
    if not marks:
        raise tree.FormatError("the PDF has no bookmarks")
    marks = [("front", 0)] * (marks[0][1] > 0) + marks
    ends = [k for _, k in marks[1:]] + [len(pages)]
    names = archives.unique_entry_names([re.sub(r'[<>:"/\\|?*\x00-\x1f]', "", t).strip() or "part" for t, _ in marks])
    return [(f"_{t}.pdf", pdfpages.build(pages[a:b])) for t, (_, a), b in zip(names, marks, ends, strict=True)], []


@kernel
def insert_blank_pages(data: bytes, name: str, after: str = "0"):
    pages = pdfpages.read(data)
    places = {int(x) for x in re.split(r"[,，\s]+", after.strip()) if x}
    if not all(0 <= k <= len(pages) for k in places):
        raise tree.FormatError(f"there are {len(pages)} pages")
    out = []
    for k in range(len(pages) + 1):
        out += [pages[k - 1]] if k else []
        if k in places:
            doc, like = pages[max(k - 1, 0)]
            out.append((doc, {"MediaBox": pdfpages.box_of((doc, like)), "Resources": {}}))
    return _one_pdf(out)


@kernel
def crop_pdf_pages(data: bytes, name: str, margin: float = 36):
    return _one_pdf(pdfpages.cropped(pdfpages.read(data), margin))


@kernel
def resize_pdf_pages(data: bytes, name: str, paper: str = "a4", mode: str = "contain"):
    return _one_pdf(pdfpages.resized(pdfpages.read(data), paper, mode))


@kernel
def add_page_numbers(data: bytes, name: str, spec: str = "1-", style: str = "plain", spot: str = "bottom_center", first: int = 1, size: float = 11, margin: float = 20):
    pages = pdfpages.read(data)
    chosen = set(pdfpages.parse_spec(spec, len(pages)))
    texts = {k: f"{first + k} / {len(pages)}" if style == "total" else f"{first + k}" for k in chosen}
    return _one_pdf(pdfpages.stamped(pages, texts, size, spot, margin))


@kernel
def pdf_watermark(data: bytes, name: str, text: str = "", columns: int = 1, rows: int = 1, tilt: float = 45, grey: float = 0.75):
    if not text.strip():
        raise tree.FormatError("the text is empty")
    return _one_pdf(pdfpages.watermarked(pdfpages.read(data), text, columns, rows, tilt, grey))


@kernel
def pdf_metadata(data: bytes, name: str, mode: str = "edit", title: str = "", author: str = "", subject: str = "", keywords: str = "", keep_dates: bool = False):
    now = pdfpages.information(data)
    given = {"Title": title, "Author": author, "Subject": subject, "Keywords": keywords}
    dates = {k: v for k, v in now.items() if k in ("CreationDate", "ModDate")}
    if mode == "edit":
        now |= {k: v.strip()[:400] for k, v in given.items() if v.strip()}
    elif mode == "clear":
        now = dates if keep_dates else {}
    else:
        now = {k: v for k, v in now.items() if k not in (*given, "Creator", "Producer", "CreationDate", "ModDate")} | (dates if keep_dates else {})
    return _one_pdf(pdfpages.read(data), now)


@kernel
def extract_pdf_images(data: bytes, name: str, min_edge: int = 0):
    doc = pdfread.Document(data)
    out, other = [], 0
    for number, x in sorted(doc.objects.items()):
        if not isinstance(x, pdfread.Stream) or x.head.get("Subtype") != "Image":
            continue
        width, height = (int(doc.get(x.head.get(k)) or 0) for k in ("Width", "Height"))
        if min(width, height) < max(min_edge, 1):
            continue
        kinds = doc.get(x.head.get("Filter"))
        kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
        space, depth = doc.get(x.head.get("ColorSpace")), doc.get(x.head.get("BitsPerComponent"))
        if kinds == ["DCTDecode"]:
            out.append((f"_{number}.jpg", x.raw))
        elif set(kinds) <= {"FlateDecode"} and depth == 8 and space in ("DeviceRGB", "DeviceGray"):
            parts = 3 if space == "DeviceRGB" else 1
            raw = np.frombuffer(doc.decoded(x), np.uint8)[: width * height * parts].reshape(height, width, parts)
            pixels = np.full((height, width, 4), 255, dtype=np.uint8)
            pixels[:, :, :3] = raw
            out.append((f"_{number}.png", rasters.write_png(pixels)))
        else:
            other += 1
    if not out:
        raise tree.FormatError("no picture that can be taken out")
    return out, [f"OTHER_PICTURES:{other}"] if other else []


def _codes(notes: dict[str, int]) -> list[str]:
    return [f"{k.upper()}:{n}" for k, n in notes.items() if n]


def _plain_parts(data: bytes) -> tuple[list[docparts.Part], dict[str, int]]:
    """Text of any kind: HTML and Markdown by their marks, a table if all rows are of one width, else paragraphs."""
    text = _text(data)
    if sniff.sniff(data[: sniff.HEAD]) == "html":
        return htmltext.html_parts(text)
    if any(markdown._HEADING.match(x) or markdown._FENCE.match(x) or markdown._ITEM.match(x) for x in text.split("\n")[:400]):
        return markdown.markdown_parts(text)
    records = csvtext.parse_csv(text) if any(d in text[:4096] for d in csvtext.DELIMITERS) else []
    if len(records) >= 2 and len(records[0]) >= 2 and not csvtext.ragged_rows(records):
        return [docparts.Table(True, records)], {}
    return [docparts.Para([docparts.Run(x)]) for x in charset.to_eol(text, "lf").split("\n") if x.strip()], {}


READERS: dict[str, Callable[[bytes], tuple[list[docparts.Part], dict[str, int]]]] = {
    "html": lambda d: htmltext.html_parts(_text(d)), "md": lambda d: markdown.markdown_parts(_text(d)), "docx": documents.read_docx, "odt": documents.read_odt,
    "pptx": documents.read_pptx, "rtf": documents.read_rtf, "text": _plain_parts,
    "epub": lambda d: (lambda found: (books.book_parts(found[1]), found[2]))(books.read_epub(d)), "mobi": lambda d: htmltext.html_parts(books.read_mobi(d)[1]), "pdf": lambda d: _pdf_parts(d),
}
WRITERS: dict[str, tuple[str, Callable[[list[docparts.Part], str], str | bytes]]] = {
    "text": ("txt", lambda p, n: docparts.to_text(p)), "markdown": ("md", lambda p, n: docparts.to_markdown(p)), "html": ("html", lambda p, n: docparts.to_html(p, n)),
    "docx": ("docx", lambda p, n: documents.write_docx(p)), "odt": ("odt", lambda p, n: documents.write_odt(p)), "rtf": ("rtf", lambda p, n: documents.write_rtf(p)),
    "epub": ("epub", lambda p, n: books.write_epub(p, n)),
}


def _document(source: str, target: str) -> Kernel:
    def run(data: bytes, name: str, title: str = "", author: str = "") -> tuple[list[Output], list[str]]:
        parts, notes = READERS[source](data)
        ext, write = WRITERS[target]
        if target == "epub":
            return _one(ext, books.write_epub(parts, title or _stem(name), author), _codes(notes))
        return _one(ext, write(parts, title or _stem(name)), _codes(notes))

    return run


for _a, _b in [
    ("md", "html"), ("md", "text"), ("html", "text"), ("html", "markdown"), ("text", "docx"), ("text", "odt"), ("text", "rtf"), ("text", "epub"), ("epub", "text"), ("epub", "markdown"),
    ("epub", "docx"), ("mobi", "text"), ("mobi", "epub"), ("docx", "text"), ("docx", "markdown"), ("docx", "html"), ("odt", "text"), ("odt", "markdown"), ("odt", "html"), ("odt", "docx"),
    ("pptx", "text"), ("pptx", "markdown"), ("pptx", "html"), ("pptx", "docx"), ("rtf", "text"), ("rtf", "markdown"), ("rtf", "html"), ("rtf", "docx"), ("pdf", "docx"), ("pdf", "html"), ("pdf", "epub"),
]:
    KERNELS[f"{_a}_to_{_b}"] = _document(_a, _b)


@kernel
def office_to_text(data: bytes, name: str):
    kind = sniff.refine(sniff.sniff(data[: sniff.HEAD]), data)
    if kind not in ("docx", "pptx"):
        raise tree.FormatError(f"{kind} is neither docx nor pptx")
    return KERNELS[f"{kind}_to_text"](data, name)


@kernel
def doc_to_text(data: bytes, name: str):
    text, notes = legacy.read_doc(data)
    return _one("txt", text, notes)


@kernel
def ppt_to_text(data: bytes, name: str):
    text, notes = legacy.read_ppt(data)
    return _one("txt", text, notes)


# -- sheets -------------------------------------------------------------------------------------------------------------


SHEET_READERS = {"xlsx": sheets.read_xlsx, "ods": sheets.read_ods, "xls": legacy.read_xls}


def _sheets(source: str, data: bytes) -> tuple[list[sheets.Sheet], list[str]]:
    found = SHEET_READERS[source](data)
    filled = [s for s in found if s.rows]
    if not filled:
        raise tree.FormatError("every sheet is empty")
    return filled, [*(n for s in found for n in s.notes), *(f"EMPTY_SHEET:{s.name}" for s in found if not s.rows)]


def _sheet_to(source: str, target: str) -> Kernel:
    def run(data: bytes, name: str, delimiter: str = ",", eol: str = "lf") -> tuple[list[Output], list[str]]:
        found, notes = _sheets(source, data)
        if target == "csv":
            return [(f"_{s.name}.csv" if len(found) > 1 else ".csv", csvtext.render_csv(s.rows, delimiter, charset.EOLS[eol]).encode()) for s in found], notes
        if target == "xlsx":
            book, more = sheets.write_xlsx(found)
            return _one("xlsx", book, notes + more)
        parts: list[docparts.Part] = []
        for s in found:
            parts += [*([docparts.Para([docparts.Run(s.name)], "h2")] if len(found) > 1 else []), docparts.Table(False, s.rows)]
        return _one("html", docparts.to_html(parts, _stem(name)), notes) if target == "html" else _one("md", docparts.to_markdown(parts), notes)

    return run


for _a, _b in [("xlsx", "csv"), ("xlsx", "html"), ("xlsx", "markdown"), ("ods", "csv"), ("ods", "xlsx"), ("ods", "html"), ("xls", "csv"), ("xls", "xlsx")]:
    KERNELS[f"{_a}_to_{_b}"] = _sheet_to(_a, _b)


# -- archives -----------------------------------------------------------------------------------------------------------


def _unpacked(entries: list[archives.Entry]) -> tuple[list[Output], list[str]]:
    kept = [e for e in entries if not e.is_dir and e.content is not None]
    reasons = [e.skip_reason for e in entries if e.skip_reason]
    names = archives.unique_entry_names([e.name.replace("\\", "/").strip("/").replace("/", "_") for e in kept])
    return [(f"_{n}", e.content) for n, e in zip(names, kept, strict=True)], [f"SKIPPED_{r.upper()}:{reasons.count(r)}" for r in dict.fromkeys(reasons)]


@kernel
def unpack_zip(data: bytes, name: str):
    return _unpacked(archives.read_zip(data))


@kernel
def unpack_seven_z(data: bytes, name: str):
    return _unpacked(sevenzip.read_7z(data))


@kernel
def untar(data: bytes, name: str):
    if sniff.sniff(data[: sniff.HEAD]) == "gzip":
        try:
            return _unpacked(archives.read_tar(data))
        except tree.FormatError:
            return _unpacked([archives.read_gzip(data, name)])
    return _unpacked(archives.read_tar(data))


# -- sound and pictures -------------------------------------------------------------------------------------------------


def _ranges(spec: str) -> list[tuple[float, float | None]]:
    out = []
    for part in re.split("[,，]", spec):
        first, _, last = part.strip().partition("-")
        bounds = [_seconds(x) if x.strip() else None for x in (first, last)]
        if bounds[0] is not None and (bounds[1] is None or bounds[1] > bounds[0]):
            out.append((bounds[0], bounds[1]))
    return out


def _seconds(text: str) -> float:
    parts = [float(x) for x in text.strip().split(":")]
    if len(parts) > 3 or min(parts) < 0:
        raise tree.FormatError(f"{text} is no time")
    return sum(x * 60**k for k, x in enumerate(reversed(parts)))


@kernel
def convert_audio(data: bytes, name: str, target: str = "flac"):
    p = audio.read_wav(data)
    if target not in ("wav", "flac"):
        raise tree.FormatError(f"no codec for {target}")
    return _one(target, flac.write_flac(p.rate, p.channels, p.samples) if target == "flac" else audio.write_wav(p))


@kernel
def audio_volume(data: bytes, name: str, percent: int = 150):
    return _one("wav", audio.write_wav(audio.gain(audio.read_wav(data), percent)))


@kernel
def audio_denoise(data: bytes, name: str, level: int = 1):
    return _one("wav", audio.write_wav(audio.denoise(audio.read_wav(data), level)))


@kernel
def audio_trim(data: bytes, name: str, spec: str = "0-"):
    return _one("wav", audio.write_wav(audio.trim(audio.read_wav(data), _ranges(spec))))


@kernel
def clean_metadata(data: bytes, name: str):
    out, notes = imagemeta.clean(data)
    return [(f".{sniff.sniff(data[: sniff.HEAD])}", out)], notes


@kernel
def ico_to_images(data: bytes, name: str):
    return [(f"_{w}x{h}_{k}.png", body) for k, (w, h, body) in enumerate(imagemeta.icon_images(data), 1)], []


def _picture(data: bytes, pixels, target: str = "") -> tuple[list[Output], list[str]]:
    kind = target or sniff.sniff(data[: sniff.HEAD])
    body, notes = rasters.write_picture(pixels, kind)
    return [(f".{kind}", body)], notes


@kernel
def convert_image(data: bytes, name: str, target: str = "png", most_edge: int = 0):
    return _picture(data, rasters.shrunk(rasters.read_picture(data), most_edge), target)


@kernel
def flip_image(data: bytes, name: str, mode: int = 0):
    pixels = rasters.read_picture(data)
    return _picture(data, pixels[:: -1 if mode else 1, :: -1 if mode != 1 else 1])


@kernel
def rotate_image(data: bytes, name: str, degrees: int = 90):
    if degrees % 90:
        raise tree.FormatError("only quarter turns keep every pixel")
    return _picture(data, np.rot90(rasters.read_picture(data), -(degrees // 90) % 4))


@kernel
def crop_image(data: bytes, name: str, rect: str = "", aspect: str = ""):
    pixels = rasters.read_picture(data)
    left, top, right, bottom = rasters.crop_box(pixels.shape[1], pixels.shape[0], rect, aspect)
    return _picture(data, pixels[top:bottom, left:right])


@kernel
def gif_to_images(data: bytes, name: str, first_only: bool = False):
    frames = rasters.read_gif(data)
    return [(f"_{k}.png", rasters.write_png(p)) for k, (p, _) in enumerate(frames[: 1 if first_only else None], 1)], []


@kernel
def compress_gif(data: bytes, name: str, most_edge: int = 0, most_fps: int = 0):
    frames = rasters.read_gif(data)
    kept: list = []
    for pixels, delay in frames:
        if kept and most_fps and kept[-1][1] < 1000 / most_fps:
            kept[-1] = (kept[-1][0], kept[-1][1] + delay)
        else:
            kept.append((rasters.shrunk(pixels, most_edge), delay))
    body, notes = rasters.write_gif(kept)
    return _one("gif", body, notes + [f"FRAMES_DROPPED:{len(frames) - len(kept)}"] * (len(kept) < len(frames)))


@kernel
def text_to_pdf(data: bytes, name: str, paper: str = "a4", size: int = 11, margin: int = 56):
    body, notes = pdfwrite.text_pdf(_plain_parts(data)[0], paper, size, margin)
    return _one("pdf", body, notes)


@kernel
def image_to_ico(data: bytes, name: str):
    return _one("ico", imagemeta.icon_of([data]))


# -- frames -------------------------------------------------------------------------------------------------------------

FILES = "file_id long, part_no int, name string, content binary, notes array<string>, error string"
_names = ["file_id", "part_no", "name", "content", "notes", "error"]
_kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.string()]


def convert(files: DataFrame, operation: str, **parameters) -> DataFrame:
    """Outputs (part_no from 1) of an operation on files: file_id, name, content. What a kernel refuses is an error row."""
    run_one = KERNELS[operation]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    rows.append((file_id, 0, name, None, [], "no content"))
                    continue
                try:
                    outputs, notes = run_one(data, name or "", **parameters)
                    rows += [(file_id, k, _stem(name or "") + suffix, content, notes, None) for k, (suffix, content) in enumerate(outputs, 1)]
                except Exception as e:  # whatever a damaged file does to a kernel, it mustn't stop the others
                    rows.append((file_id, 0, name, None, [], str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_kinds)], names=_names)

    return files.select(F.col("file_id").cast("long"), F.col("name").cast("string"), F.col("content").cast("binary")).mapInArrow(run, FILES)


def convert_text(texts: DataFrame, operation: str, key: str, text: str, **parameters) -> DataFrame:
    """(key, output, notes, error) of an operation with one text output, on a text column."""
    files = texts.select(F.col(key).alias("file_id"), F.lit("text").alias("name"), F.encode(F.col(text), "UTF-8").alias("content"))
    out = convert(files, operation, **parameters).where("part_no <= 1")
    return out.select(F.col("file_id").alias(key), F.decode("content", "UTF-8").alias("output"), "notes", "error")


def _kind(data: bytes) -> str:
    kind = sniff.sniff(data[: sniff.HEAD])
    try:
        return sniff.refine(kind, data)
    except Exception:  # a damaged container stays what its head says
        return kind


def sniffed(files: DataFrame) -> DataFrame:
    """file_id, name, kind, family and size of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            kinds = ["unknown" if d is None else _kind(d) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds), pa.array([sniff.family(k) for k in kinds]), pa.array([None if d is None else len(d) for d in data], pa.int64())], names=["file_id", "name", "kind", "family", "size"])

    return files.select(F.col("file_id").cast("long"), F.col("name").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "file_id long, name string, kind string, family string, size long")


def _animation(files: list[tuple[str, bytes]]) -> bytes:
    """Pictures, each centred on a canvas of the largest width and height, as frames of a second."""
    pictures = [rasters.read_picture(d) for _, d in files]
    height, width = (max(p.shape[k] for p in pictures) for k in (0, 1))
    frames = []
    for p in pictures:
        canvas = np.zeros((height, width, 4), dtype=np.uint8)
        top, left = (height - p.shape[0]) // 2, (width - p.shape[1]) // 2
        canvas[top : top + p.shape[0], left : left + p.shape[1]] = p
        frames.append((canvas, 1000))
    return rasters.write_gif(frames)[0]


def packed(files: DataFrame, batch: str, kind: str = "zip") -> DataFrame:
    """One output for each batch of files (batch, file_id, name, content) in order of file_id: zip, tar, one WAV, icon, PDF of pictures, animation or merged PDF.
    Batches beyond the archive limits and files that don't go together are refused."""
    write = {"zip": archives.pack_zip, "tar": archives.pack_tar, "wav": lambda files: audio.write_wav(audio.join([audio.read_wav(d) for _, d in files])), "ico": lambda files: imagemeta.icon_of([d for _, d in files]), "pdf": lambda files: pdfwrite.images_pdf([d for _, d in files]), "gif": _animation, "merged_pdf": lambda files: pdfpages.build([p for _, d in files for p in pdfpages.read(d)])}[kind]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["file_id"])
        files = [(r["name"] or "", r["content"] or b"") for r in rows]
        content = error = None
        try:
            if sum(len(d) for _, d in files) > archives.MOST_TOTAL:
                raise tree.FormatError("too_large")
            content = write(files)
        except ValueError as e:
            error = str(e)
        return pa.table([pa.array([rows[0]["batch"]], pa.int64()), pa.array([content], pa.binary()), pa.array([len(files)], pa.int64()), pa.array([error], pa.string())], names=["batch", "content", "files", "error"])

    return files.select(F.col(batch).cast("long").alias("batch"), "file_id", "name", "content").groupBy("batch").applyInArrow(run, "batch long, content binary, files long, error string")
