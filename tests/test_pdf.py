"""PDF text: files written here, by hand and by the writer."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions.docparts import Para, Run, Table
from tessera.functions.tree import FormatError
from tessera.operators import geometry
from tessera.operators.convert import KERNELS
from tessera.sources import pdfread, pdfwrite


def by_hand(content: bytes, packed=False) -> bytes:
    cmap = b"begincmap 2 beginbfchar <0001> <00480069> <0002> <D83DDE00> endbfchar 1 beginbfrange <0003> <0005> <0061> endbfrange"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 200] /Resources << /Font << /A 5 0 R /B 6 0 R >> /XObject << /X 9 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Bold /Encoding << /Differences [65 /eacute /uni4E2D] >> /FirstChar 32 /Widths [250] >>",
        6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R /DescendantFonts [8 0 R] >>", 8: b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [1 [1200 500] 3 5 400] >>",
    }
    streams = {4: (content, b""), 7: (cmap, b""), 9: (b"BT /A 8 Tf 5 5 Td (form) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] ")}
    out = b"%PDF-1.7\n"
    if packed:
        body = b"".join(b"%d %d " % (k, sum(len(objects[j]) + 1 for j in objects if j < k)) for k in objects) + b"\n"
        inner = b" ".join(objects[k] for k in sorted(objects))
        raw = zlib.compress(body + inner)
        out += b"20 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(objects), len(body), len(raw)) + raw + b"\nendstream\nendobj\n"
    else:
        out += b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in objects.items())
    for k, (body, head) in streams.items():
        raw = zlib.compress(body)
        out += b"%d 0 obj\n<< %s/Filter /FlateDecode /Length %d >>\nstream\n" % (k, head, len(raw)) + raw + b"\nendstream\nendobj\n"
    return out + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


CONTENT = b"q 1 0 0 1 10 0 cm BT /A 10 Tf 0 150 Td (x\\050AB\\) ) Tj [(one) -400 (two) 20 (s)] TJ 0 -20 TD (next) ' ET Q BT /B 10 Tf 1 0 0 1 10 80 Tm <000100020003> Tj ET /X Do BI /W 1 ID \xff(\xfe EI BT /A 10 Tf 10 20 Td (end) Tj ET"


@pytest.mark.parametrize("packed", [False, True])
def test_words_and_places(packed):
    words = pdfread.read_pdf(by_hand(CONTENT, packed))[0]
    assert [w["text"] for w in words] == ["x(é中)", "one", "twos", "next", "Hi😀a", "form", "end"]
    first, form = words[0], next(w for w in words if w["text"] == "form")
    assert first["left"] == 10 and first["bold"] and abs(first["bottom"] - 52) < 1e-6 and form["left"] == 105


def test_the_writer_is_read_back():
    parts = [Para([Run("A Heading")], "h1"), Para([Run("Some words of a paragraph, with (brackets) and é.")]), Table(True, [["name", "qty"], ["apple", "3"], ["pear", "44"]])]
    data, _ = pdfwrite.text_pdf(parts, number_pages=False)
    text = KERNELS["pdf_to_text"](data, "a.pdf")[0][0][1].decode()
    assert text.split("\n")[:2] == ["A Heading", "Some words of a paragraph, with (brackets) and é."]
    html = KERNELS["pdf_to_html"](data, "a.pdf")[0][0][1].decode()
    assert "<h1>A Heading</h1>" in html and "paragraph" in html
    for name in ("pdf_to_docx", "pdf_to_epub"):
        assert KERNELS[name](data, "a.pdf")[0][0][1].startswith(b"PK")


def test_tables_of_a_page(spark):
    rows = b"".join(b"1 0 0 1 %d %d Tm (%s) Tj " % (x, y, t) for y, row in ((150, (b"name", b"qty")), (130, (b"apple", b"3")), (110, (b"pear", b"44"))) for x, t in zip((10, 120), row, strict=True))
    data = by_hand(b"BT /A 10 Tf " + rows + b"ET")
    assert KERNELS["pdf_to_csv"](data, "a.pdf")[0][0][1] == b"name,qty\napple,3\npear,44\n"
    files = spark.createDataFrame([(1, data), (2, b"no pdf"), (3, None)], "file_id long, content binary")
    words = geometry.words_from_files(files)
    assert words.where("error IS NULL").agg(F.count("*"), F.max("file_id")).first()[:] == (6, 1)
    assert sorted(r.file_id for r in words.where("error IS NOT NULL").collect()) == [2, 3]  # what can't be read is a row with its error
    assert [r.cells for r in geometry.tables_from_words(words).orderBy("row_no").collect()] == [["name", "qty"], ["apple", "3"], ["pear", "44"]]


def test_what_is_refused():
    good = by_hand(CONTENT)
    for bad in (b"", b"%PDF-1.4", good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), good.replace(b"/Kids [3 0 R]", b"/Kids []")):
        with pytest.raises(FormatError):
            pdfread.read_pdf(bad)


def book(n=5):
    return pdfwrite.text_pdf([Para([Run(f"page {k} " + "words " * 700)]) for k in range(1, n + 1)], size=12, number_pages=False)[0]


def first_words(data):
    return [" ".join(w["text"] for w in page[:2]) for page in pdfread.read_pdf(data)]


def run(name, data, **parameters):
    return [body for _, body in KERNELS[name](data, "b.pdf", **parameters)[0]]


def test_pages_are_chosen_split_and_joined(spark):
    data = book()
    pages = first_words(data)
    n = len(pages)
    assert first_words(run("extract_pdf_pages", data, spec="3,1-2,3")[0]) == [pages[2], pages[0], pages[1], pages[2]]
    assert first_words(run("pdf_reorder", data, spec=f"{n}-1")[0]) == pages[::-1] and first_words(run("remove_pdf_pages", data, spec="2-")[0]) == pages[:1]
    parts = run("split_pdf_into_parts", data, parts=3)
    assert [len(first_words(p)) for p in parts] == [n // 3 + (k < n % 3) for k in range(3)] and sum(map(first_words, parts), []) == pages
    groups = run("split_pdf_by_size", data, target_bytes=len(run("extract_pdf_pages", data, spec="1-2")[0]) + 10)
    assert sum(map(first_words, groups), []) == pages and len(groups) < n
    assert len(run("split_pdf_by_size", data, target_bytes=10)) == n
    with pytest.raises(FormatError):
        run("extract_pdf_pages", data, spec=f"{n + 1}")
    from tessera.operators.convert import packed

    files = spark.createDataFrame([(1, 2, "b", data), (1, 1, "a", parts[0]), (2, 1, "x", b"no")], "batch long, file_id long, name string, content binary")
    merged = {r.batch: r for r in packed(files, "batch", "merged_pdf").collect()}
    assert first_words(bytes(merged[1].content)) == pages[: n // 3 + (n % 3 > 0)] + pages and merged[2].error


def test_pages_are_changed():
    data = book(2)
    pages = pdfread.Document(run("rotate_pdf_pages", data, spec="1", degrees=270)[0]).pages
    assert pages[0]["Rotate"] == 270 and pages[1].get("Rotate", 0) == 0
    assert pdfread.Document(run("crop_pdf_pages", data, margin=50)[0]).pages[0]["MediaBox"] == [50, 50, 545, 792]
    small = pdfread.Document(run("resize_pdf_pages", data, paper="a5")[0])
    assert small.pages[0]["MediaBox"] == [0, 0, 420, 595]
    word, before = pdfread.page_words(small, small.pages[0])[0], pdfread.read_pdf(data)[0][0]
    assert abs(word["size"] - before["size"] * min(420 / 595, 595 / 842)) < 1e-3
    blank = run("insert_blank_pages", data, after="0,1")[0]
    assert [len(p) > 0 for p in pdfread.read_pdf(blank)][:4] == [False, True, False, True]
    numbered = pdfread.read_pdf(run("add_page_numbers", data, style="total", first=1)[0])
    assert [w["text"] for w in numbered[1][-3:]] == ["2", "/", str(len(numbered))]
    marked = pdfread.read_pdf(run("pdf_watermark", data, text="DRAFT", columns=2, rows=2, tilt=0)[0])
    assert [w["text"] for w in marked[0]].count("DRAFT") == 4
    titled = run("pdf_metadata", data, title="Tïtle")[0]
    assert b"/Info" in titled and KERNELS["pdf_metadata"](titled, "x", mode="clear")[0][0][1].count(b"/Info") == 0
    from tessera.sources import pdfpages

    assert pdfpages.information(titled) == {"Title": "Tïtle"}


def test_pictures_come_out():
    import numpy as np

    from tessera.sources import rasters

    p = np.random.default_rng(1).integers(0, 256, (3, 4, 4), dtype=np.uint8)
    p[:, :, 3] = 255
    found = KERNELS["extract_pdf_images"](pdfwrite.images_pdf([rasters.write_png(p)]), "x")[0]
    assert len(found) == 1 and np.array_equal(rasters.read_png(found[0][1]), p)


def test_bookmarks_split():
    data = book(2)
    n = len(pdfread.read_pdf(data))
    kids = [int(x) for x in __import__("re").findall(rb"(\d+) 0 R", __import__("re").search(rb"/Kids \[(.*?)\]", data)[1])]
    marked = data.replace(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Catalog /Pages 2 0 R /Outlines 900 0 R >>") + b"900 0 obj << /First 901 0 R >> endobj 901 0 obj << /Title (One) /Dest [%d 0 R /Fit] /Next 902 0 R >> endobj 902 0 obj << /Title (Two) /Dest [%d 0 R /Fit] >> endobj" % (kids[1], kids[2])
    out = KERNELS["split_pdf_by_outline"](marked, "b.pdf")[0]
    assert [s for s, _ in out] == ["_front.pdf", "_One.pdf", "_Two.pdf"] and [len(pdfread.read_pdf(b)) for _, b in out] == [1, 1, n - 2]
