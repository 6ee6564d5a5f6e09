"""Containers: round trips, and the standard library as the other side."""

import io
import tarfile
import zipfile

import numpy as np
import pytest

from tessera.functions import docparts, markdown
from tessera.functions.tree import FormatError
from tessera.operators import audio
from tessera.operators import structure as geometry
from tessera.sources import archives, books, documents, imagemeta, sheets

TEXT = "# T\n\nPara **b** *i* [l](http://x.y) é😀\n\n- a\n- b\n  - c\n\n1. n\n2. m\n\n| h | k |\n| --- | --- |\n| 1 | 2 |\n\n## Two\n\n> q\n"
PARTS = markdown.markdown_parts(TEXT)[0]


@pytest.mark.parametrize("write, read", [(documents.write_docx, documents.read_docx), (documents.write_odt, documents.read_odt)])
def test_documents_come_back(write, read):
    assert docparts.to_markdown(read(write(PARTS))[0]) == docparts.to_markdown(PARTS)
    for bad in (b"", b"PK\x03\x04junk", archives.pack_zip([("x", b"y")])):
        with pytest.raises(FormatError):
            read(bad)


def test_rtf_comes_back():
    parts, notes = documents.read_rtf(documents.write_rtf(PARTS).encode())
    text = docparts.to_text(parts)
    assert "Para b i l é😀" in text and "- a\n- b\n  - c\n1. n\n2. m" in text and "h\tk\n1\t2" in text
    assert [p.style for p in parts if isinstance(p, docparts.Para)][0] == "h1"
    cut = rb"{\rtf1\ansicpg936 {\fonttbl x}\'d6\'d0" + b"\\" + rb"u20013 ?\par {\b b}"
    assert documents.read_rtf(cut)[1].get("TRUNCATED") == 1 and documents.read_rtf(cut)[0][0].text == chr(20013) * 2
    with pytest.raises(FormatError):
        documents.read_rtf(b"text")


def test_epub_comes_back():
    book = books.write_epub(PARTS, "Title", "Me")
    assert book == books.write_epub(PARTS, "Title", "Me")
    assert zipfile.ZipFile(io.BytesIO(book)).infolist()[0].filename == "mimetype"
    title, pages, notes = books.read_epub(book)
    assert title == "Title" and docparts.to_markdown(books.book_parts(pages)) == docparts.to_markdown(PARTS) and not notes


def test_mobi():
    def palm(text, packing):
        body = text if packing == 1 else b"".join(bytes([1, c]) if c < 9 or c >= 0x80 else bytes([c]) for c in text)
        head = packing.to_bytes(2, "big") + b"\0\0" + len(text).to_bytes(4, "big") + (1).to_bytes(2, "big") + b"\x10\0" + b"\0\0\0\0"
        start = 78 + 16 + 2
        offsets = [start, start + len(head)]
        table = b"".join(o.to_bytes(4, "big") + bytes(4) for o in offsets)
        return b"Book".ljust(32, b"\0") + bytes(28) + b"TEXtREAd" + bytes(8) + (2).to_bytes(2, "big") + table + b"\0\0" + head + body

    for packing in (1, 2):
        assert books.read_mobi(palm(b"<p>caf\xe9</p>", packing)) == ("Book", "<p>café</p>")
    assert books._unpack_palmdoc(b"abc" + bytes([0x80 | 3 >> 5, (3 << 3 & 0xFF) | 0]) + bytes([0xC0 | ord("x") & 0x7F])) == b"abcabc x"
    with pytest.raises(FormatError):
        books.read_mobi(b"no")


def test_sheets_come_back():
    made = [sheets.Sheet("A/b", [["id", "v"], ["007", "1.50"], ["2.5", "=1+1"], ["", "x\ny"]]), sheets.Sheet("a/B", [["9"]])]
    book, notes = sheets.write_xlsx(made)
    assert notes == ["SHEET_RENAMED:2", "FORMULA_LIKE:1", "NUMBERS:2"] or "FORMULA_LIKE:1" in notes
    for found in (sheets.read_xlsx(book), sheets.read_ods(sheets.write_ods(made))):
        assert [(s.name, s.rows) for s in found] == [("A_b", made[0].rows), ("a_B_2", made[1].rows)]


def test_sheet_numbers():
    assert [sheets.serial_date(x) for x in ("1", "59", "60", "61", "45000.5", "0.25")] == ["1900-01-01", "1900-02-28", "1900-02-29", "1900-03-01", "2023-03-15 12:00:00", "06:00:00"]
    assert sheets.serial_date("0", True) == "1904-01-01" and sheets.column_number("XFD12") == 16383 and sheets.column_letters(16383) == "XFD"
    assert [sheets.stays_number(x) for x in ("1", "1.5", "-3", "007", "1.50", "-0", "1e5", "1234567890123456", "")] == [True, True, True, False, False, False, False, False, False]


def test_archives():
    files = [("a.txt", b"1"), ("d/a.txt", b"22"), ("a.txt", b"333")]
    assert [(e.name, e.content) for e in archives.read_zip(archives.pack_zip(files))] == [("a.txt", b"1"), ("d/a.txt", b"22"), ("a_2.txt", b"333")]
    assert [(e.name, e.content) for e in archives.read_tar(archives.pack_tar(files))][2] == ("a_2.txt", b"333")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        t.addfile(link)
        info = tarfile.TarInfo("f")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    assert [(e.name, e.skip_reason, e.content) for e in archives.read_tar(out.getvalue())] == [("l", "link", None), ("f", None, b"ok")]
    import gzip

    named = io.BytesIO()
    with gzip.GzipFile("inner.txt", "wb", fileobj=named, mtime=0) as g:
        g.write(b"x")
    assert archives.read_gzip(named.getvalue(), "o.gz").name == "inner.txt"
    for bad in (b"", b"x" * 600, archives.pack_zip([])):
        with pytest.raises(FormatError):
            archives.read_zip(bad)


def test_image_metadata_and_icons():
    picture = imagemeta.png(2, 2, bytes(range(16)))
    text = b"\0\0\0\x04tEXta\0bc" + __import__("zlib").crc32(b"tEXta\0bc").to_bytes(4, "big")
    tagged = picture[:33] + text + picture[33:]
    assert imagemeta.clean(tagged) == (picture, ["REMOVED_TEXT:1"])
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1\x00\x06Exif\xff\xda\x00\x02pixels\xff\xd9"
    assert imagemeta.clean(jpeg) == (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02pixels\xff\xd9", ["REMOVED_EXIF_XMP:1"])
    assert imagemeta.icon_images(imagemeta.icon_of([picture])) == [(2, 2, picture)]
    for bad in (b"", b"\xff\xd8\xff\xe0\xff\xff", tagged[:40]):
        with pytest.raises(FormatError):
            imagemeta.segments(bad)


def test_audio():
    p = audio.Pcm(1000, 2, np.array([1000, -1000, 30000, 5, -2, 7], dtype=np.int16))
    back = audio.read_wav(audio.write_wav(p))
    assert (back.rate, back.channels, back.samples.tolist()) == (1000, 2, p.samples.tolist())
    assert audio.gain(p, 150).samples.tolist() == [1500, -1500, 32767, 8, -3, 11] and audio.denoise(p, 1).samples.tolist()[:4] == [1000, -1000, 29995, 0]
    assert audio.trim(p, [(0.001, 0.002), (0, 0.001)]).samples.tolist() == [30000, 5, 1000, -1000] and audio.join([p, p]).frames == 6
    with pytest.raises(FormatError):
        audio.join([p, audio.Pcm(8000, 2, p.samples)])


def test_geometry():
    words = [("Name", 10, 40, 0, 10), ("Qty", 100, 120, 1, 11), ("foo", 10, 30, 15, 25), ("bar", 33, 50, 15, 25), ("3", 100, 106, 15, 25), ("alone", 10, 40, 30, 40)]
    assert geometry.page_tables(words) == [[["Name", "Qty"], ["foo bar", "3"]]] and geometry.page_tables([]) == []
    lines = []
    for page in range(4):
        lines.append({"page": page, "text": f"Page {page}", "size": 8.0, "bold": False, "left": 0, "right": 20, "top": 0, "height": 8})
        lines.append({"page": page, "text": "Heading", "size": 20.0, "bold": True, "left": 0, "right": 50, "top": 20 + page, "height": 20} if not page else {"page": page, "text": f"unique {'x' * page}", "size": 10.0, "bold": False, "left": 0, "right": 40, "top": 20, "height": 10})
        lines += [{"page": page, "text": f"body line {'abcd'[page]} that ends with a hy-", "size": 10.0, "bold": False, "left": 0, "right": 100, "top": 60, "height": 10}, {"page": page, "text": f"phen {'abcd'[page]}.", "size": 10.0, "bold": False, "left": 0, "right": 50, "top": 72, "height": 10}]
    text = docparts.to_text(geometry.lines_to_parts(lines))
    assert "Page" not in text and text.startswith("Heading\n\nbody line a that ends with a hyphen a.\n")
