"""Queries that take files through conversions and back: documents, sheets, books, PDF pages, pictures, sound, subtitles, archives.

Each supplier (or vector) has a file made of its columns; SQL gives what has to come out at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audio
from tessera.operators import convert as V
from tessera.plans import samples
from tessera.plans.format_queries import _text
from tessera.plans.relational_queries import table
from tessera.sources import rasters

Query = Callable[[SparkSession, str], DataFrame]
Step = str | tuple[str, dict]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_N = "chr(10)"


def query(name: str, run: Query, sql: str) -> None:
    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = sql


def _through(files: DataFrame, steps: tuple[Step, ...]) -> DataFrame:
    for step in steps:
        operation, parameters = (step, {}) if isinstance(step, str) else step
        files = V.convert(files, operation, **parameters)
    return files


def _written(files: DataFrame) -> DataFrame:
    return files.select(F.col("file_id").alias("s_suppkey"), F.col("part_no").cast("int").alias("part_no"), F.decode("content", "UTF-8").alias("output"))


def _of_text(name: str, parts: tuple[str, ...], steps: tuple[Step, ...], sql: str) -> None:
    """A text of literal pieces and columns for each supplier, through conversions; sql: the text at the end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.lit("s").alias("name"), F.encode(_text(*parts), "UTF-8").alias("content"))
        return _written(_through(files, steps))

    query(name, run, f"SELECT s_suppkey, 1 AS part_no, {sql} AS output FROM supplier")


def _made(spark: SparkSession, sf_dir: str, make: Callable[[int, str], bytes]) -> DataFrame:
    """A file for each supplier, made of its key and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["s"] * b.num_rows), pa.array([make(k, n) for k, n in zip(keys, names, strict=True)], pa.binary())], names=["file_id", "name", "content"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").mapInArrow(run, "file_id long, name string, content binary")


def _of_file(name: str, make: Callable[[int, str], bytes], steps: tuple[Step, ...], sql: str) -> None:
    query(name, lambda spark, sf_dir: _written(_through(_made(spark, sf_dir, make), steps)), f"SELECT s_suppkey, 1 AS part_no, {sql} AS output FROM supplier")


# -- documents ----------------------------------------------------------------------------------------------------------

_MARKDOWN = ("# Supplier\n\nkey **", "{s_suppkey}", "** of *", "{s_nationkey}", "*\n\n- ", "{s_name}", "\n- x\n")
_AS_MARKDOWN = f"'# Supplier' || {_N} || {_N} || 'key **' || s_suppkey || '** of *' || s_nationkey || '*' || {_N} || {_N} || '- ' || s_name || {_N} || '- x' || {_N}"
_AS_TEXT = f"'Supplier' || {_N} || {_N} || 'key ' || s_suppkey || ' of ' || s_nationkey || {_N} || {_N} || '- ' || s_name || {_N} || '- x' || {_N}"
_PAGE = f"'<!DOCTYPE html>' || {_N} || '<html><head><meta charset=\"utf-8\"><title>s</title></head>' || {_N} || '<body>' || {_N} || "
_PAGE_END = f" || {_N} || '</body></html>' || {_N}"
_AS_HTML = f"{_PAGE}'<h1>Supplier</h1>' || {_N} || '<p>key <strong>' || s_suppkey || '</strong> of <em>' || s_nationkey || '</em></p>' || {_N} || '<ul>' || {_N} || '<li>' || s_name || {_N} || '</li>' || {_N} || '<li>x' || {_N} || '</li></ul>'{_PAGE_END}"
for _kind in ("docx", "odt", "rtf", "epub"):
    _of_text(f"{_kind}_to_text", _MARKDOWN, (f"text_to_{_kind}", f"{_kind}_to_text"), _AS_TEXT)
for _kind in ("odt", "rtf"):
    _of_text(f"{_kind}_to_html", _MARKDOWN, (f"text_to_{_kind}", f"{_kind}_to_html"), _AS_HTML)
for _kind in ("rtf", "epub"):
    _of_text(f"{_kind}_to_docx", _MARKDOWN, (f"text_to_{_kind}", f"{_kind}_to_docx", "docx_to_markdown"), _AS_MARKDOWN)
_of_text("md_to_html", _MARKDOWN, ("md_to_html",), _AS_HTML)
_of_text("html_to_text", _MARKDOWN, ("md_to_html", "html_to_text"), _AS_TEXT)
_of_text("office_to_text", _MARKDOWN, ("text_to_docx", "office_to_text"), _AS_TEXT)
_of_file("doc_to_text", samples.doc, ("doc_to_text",), f"s_name || {_N} || 'key ' || s_suppkey || {_N}")
_of_file("ppt_to_text", samples.ppt, ("ppt_to_text",), f"s_name || {_N} || {_N} || 'key ' || s_suppkey || {_N}")
_of_file("mobi_to_text", samples.mobi, ("mobi_to_text",), f"'Book' || {_N} || {_N} || s_name || ' has key ' || s_suppkey || {_N}")
_of_file("mobi_to_epub", samples.mobi, ("mobi_to_epub", "epub_to_markdown"), f"'# Book' || {_N} || {_N} || s_name || ' has key ' || s_suppkey || {_N}")
_SLIDES = f"'{{0}}First' || {_N} || {_N} || s_name || {_N} || {_N} || '{{0}}Last' || {_N} || {_N} || 'key ' || s_suppkey || {_N}"
_of_file("pptx_to_text", samples.pptx, ("pptx_to_text",), _SLIDES.format(""))
_of_file("pptx_to_markdown", samples.pptx, ("pptx_to_markdown",), _SLIDES.format("## "))
_of_file("pptx_to_docx", samples.pptx, ("pptx_to_docx", "docx_to_markdown"), _SLIDES.format("## "))
_of_file("pptx_to_html", samples.pptx, ("pptx_to_html",), f"{_PAGE}'<h2>First</h2>' || {_N} || '<p>' || s_name || '</p>' || {_N} || '<h2>Last</h2>' || {_N} || '<p>key ' || s_suppkey || '</p>'{_PAGE_END}")

# -- sheets and trees ---------------------------------------------------------------------------------------------------

_CSV = ("id,name\n", "{s_suppkey}", ",", "{s_name}", "\n")
_AS_CSV = f"'id,name' || {_N} || s_suppkey || ',' || s_name || {_N}"
_AS_TABLE = f"{_PAGE}'<table><tr><td>id</td><td>name</td></tr><tr><td>' || s_suppkey || '</td><td>' || s_name || '</td></tr></table>'{_PAGE_END}"
_of_text("xlsx_to_html", _CSV, ("csv_to_xlsx", "xlsx_to_html"), _AS_TABLE)
_of_text("ods_to_html", _CSV, ("csv_to_ods", "ods_to_html"), _AS_TABLE)
_of_text("xlsx_to_markdown", _CSV, ("csv_to_xlsx", "xlsx_to_markdown"), f"'|  |  |' || {_N} || '| --- | --- |' || {_N} || '| id | name |' || {_N} || '| ' || s_suppkey || ' | ' || s_name || ' |' || {_N}")
_of_text("ods_to_xlsx", _CSV, ("csv_to_ods", "ods_to_xlsx", "xlsx_to_csv"), _AS_CSV)
_of_file("xls_to_csv", samples.xls, ("xls_to_csv",), _AS_CSV)
_of_file("xls_to_xlsx", samples.xls, ("xls_to_xlsx", "xlsx_to_csv"), _AS_CSV)
_JSON = ('[{"id": ', "{s_suppkey}", ', "name": "', "{s_name}", '"}]')
_of_text("json_table_to_csv", _JSON, ("json_to_csv",), _AS_CSV)
_of_text("json_to_xlsx", _JSON, ("json_to_xlsx", "xlsx_to_csv"), _AS_CSV)
_of_text("yaml_to_xlsx", ("- id: ", "{s_suppkey}", "\n  name: ", "{s_name}", "\n"), ("yaml_to_xlsx", "xlsx_to_csv"), _AS_CSV)
_of_text("toml_to_xlsx", ("[[s]]\nid = ", "{s_suppkey}", "\nname = '", "{s_name}", "'\n"), ("toml_to_xlsx", "xlsx_to_csv"), _AS_CSV)
_of_text("xml_to_xlsx", ("<r><s><id>", "{s_suppkey}", "</id><name>", "{s_name}", "</name></s><s><id>0</id><name>x</name></s></r>"), ("xml_to_xlsx", "xlsx_to_csv"), f"{_AS_CSV} || '0,x' || {_N}")
_of_text("yaml_to_ini", ("id: ", "{s_suppkey}", "\ns:\n  name: ", "{s_name}", "\n"), ("yaml_to_ini",), f"'id = ' || s_suppkey || {_N} || {_N} || '[s]' || {_N} || 'name = ' || s_name || {_N}")

# -- PDF ----------------------------------------------------------------------------------------------------------------

_LINES = ("{s_name}", "\nkey ", "{s_suppkey}", "\n\nnation ", "{s_nationkey}", "\n")
_of_text("pdf_to_text", _LINES, ("text_to_pdf", "pdf_to_text"), f"s_name || {_N} || 'key ' || s_suppkey || {_N} || 'nation ' || s_nationkey || {_N} || '1' || {_N}")
_of_text("pdf_to_html", _LINES, ("text_to_pdf", "pdf_to_html"), f"{_PAGE}'<p>' || s_name || '</p>' || {_N} || '<p>key ' || s_suppkey || '</p>' || {_N} || '<p>nation ' || s_nationkey || '</p>' || {_N} || '<p>1</p>'{_PAGE_END}")
for _kind in ("docx", "epub"):
    _of_text(f"pdf_to_{_kind}", _LINES, ("text_to_pdf", f"pdf_to_{_kind}", f"{_kind}_to_text"), f" || {_N} || {_N} || ".join(["s_name", "'key ' || s_suppkey", "'nation ' || s_nationkey", "'1'"]) + f" || {_N}")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF of three pages for each supplier, merged of one for each page."""
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"))
    files = pages.select(F.struct("s_suppkey", "page").alias("own"), F.encode(_text("{s_name}", " page ", "{page}"), "UTF-8").alias("content"))
    files = files.select((F.col("own.s_suppkey") * 4 + F.col("own.page")).alias("file_id"), F.lit("p").alias("name"), "content")
    single = V.convert(files, "text_to_pdf").withColumn("batch", F.floor(F.col("file_id") / 4))
    return V.packed(single, "batch", "merged_pdf").select(F.col("batch").alias("file_id"), F.lit("b").alias("name"), "content")


def _leaf(n: int, more: str = "") -> str:
    return f"s_name || ' page {n}' || {_N} || '1'{more} || {_N}"


def _of_pages(name: str, steps: tuple[Step, ...], *outputs: list[str]) -> None:
    """Books through conversions and to text; outputs: for each file that comes out its pages."""
    rows = " UNION ALL ".join(f"SELECT s_suppkey, {' || chr(12) || '.join(pages)} AS output FROM supplier" for pages in outputs)
    query(name, lambda spark, sf_dir: _written(V.convert(_through(_books(spark, sf_dir), steps), "pdf_to_text")).select("s_suppkey", "output"), rows)


_of_pages("merge_pdfs", (), [_leaf(1), _leaf(2), _leaf(3)])
_of_pages("extract_pdf_pages", (("extract_pdf_pages", {"spec": "2-3"}),), [_leaf(2), _leaf(3)])
_of_pages("pdf_reorder", (("pdf_reorder", {"spec": "3,1,2"}),), [_leaf(3), _leaf(1), _leaf(2)])
_of_pages("remove_pdf_pages", (("remove_pdf_pages", {"spec": "2"}),), [_leaf(1), _leaf(3)])
_of_pages("rotate_pdf_pages", (("rotate_pdf_pages", {"spec": "1-", "degrees": 180}),), [_leaf(1), _leaf(2), _leaf(3)])
_of_pages("split_pdf_into_parts", (("split_pdf_into_parts", {"parts": 2}),), [_leaf(1), _leaf(2)], [_leaf(3)])
_of_pages("split_pdf_by_size", (("split_pdf_by_size", {"target_bytes": 1}),), [_leaf(1)], [_leaf(2)], [_leaf(3)])
_of_pages("insert_blank_pages", (("insert_blank_pages", {"after": "1"}),), [_leaf(1), _N, _leaf(2), _leaf(3)])
_of_pages("crop_pdf_pages", (("crop_pdf_pages", {"margin": 20}),), [_leaf(1), _leaf(2), _leaf(3)])
_of_pages("resize_pdf_pages", (("resize_pdf_pages", {"paper": "a5"}),), [_leaf(1), _leaf(2), _leaf(3)])
_of_pages("add_page_numbers", (("add_page_numbers", {}),), *[[_leaf(n, f" || {_N} || '{n}'") for n in (1, 2, 3)]])
_of_pages("pdf_metadata", (("pdf_metadata", {"title": "T"}),), [_leaf(1), _leaf(2), _leaf(3)])

# -- pictures -----------------------------------------------------------------------------------------------------------

_WIDTH, _HEIGHT = 3, 2


def _picture(key: int, name: str) -> bytes:
    """A bitmap of three by two pixels: red by the key, green by the place."""
    red, green = key % 256, np.arange(_WIDTH * _HEIGHT)
    pixels = np.stack([np.full_like(green, red), green, np.zeros_like(green), np.full_like(green, 255)], axis=1)
    return rasters.write_bmp(pixels.reshape(_HEIGHT, _WIDTH, 4).astype(np.uint8))


def _pixels(files: DataFrame) -> DataFrame:
    """Width, height and the pixels' red, green, blue and alpha in hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rasters.read_picture(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([p.shape[k] for p in found], pa.int32()) for k in (1, 0)), pa.array([p.tobytes().hex() for p in found])], names=["s_suppkey", "part_no", "width", "height", "pixels"])

    return files.select("file_id", F.col("part_no").cast("int"), "content").mapInArrow(run, "s_suppkey long, part_no int, width int, height int, pixels string")


def _dots(*places: int) -> str:
    return " || ".join(f"lpad(lower(to_hex(s_suppkey % 256)), 2, '0') || '0{k}00ff'" for k in places)


def _of_picture(name: str, steps: tuple[Step, ...], size: tuple[int, int], *places: int) -> None:
    query(name, lambda spark, sf_dir: _pixels(_through(_made(spark, sf_dir, _picture), steps)), f"SELECT s_suppkey, 1 AS part_no, {size[0]} AS width, {size[1]} AS height, {_dots(*places)} AS pixels FROM supplier")


_of_picture("convert_image", ("convert_image", ("convert_image", {"target": "gif"}), ("convert_image", {"target": "bmp"})), (3, 2), *range(6))
_of_picture("flip_image", (("flip_image", {"mode": 0}),), (3, 2), 2, 1, 0, 5, 4, 3)
_of_picture("rotate_image", (("rotate_image", {"degrees": 90}),), (2, 3), 3, 0, 4, 1, 5, 2)
_of_picture("crop_image", (("crop_image", {"rect": "1,0,2,2"}),), (2, 2), 1, 2, 4, 5)
_of_picture("clean_metadata", ("convert_image", "clean_metadata"), (3, 2), *range(6))
_of_picture("image_to_ico", ("convert_image", "image_to_ico", "ico_to_images"), (3, 2), *range(6))
_of_picture("gif_to_images", (("convert_image", {"target": "gif"}), "gif_to_images"), (3, 2), *range(6))


def _two(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A batch of two pictures for each supplier: as it is, and flipped."""
    files = V.convert(_made(spark, sf_dir, _picture), "convert_image")
    flipped = V.convert(files, "flip_image")
    both = files.select(F.col("file_id").alias("batch"), (F.col("file_id") * 2).alias("file_id"), "name", "content").union(flipped.select(F.col("file_id").alias("batch"), F.col("file_id") * 2 + 1, "name", "content"))
    return V.packed(both, "batch", kind).select(F.col("batch").alias("file_id"), F.lit("b").alias("name"), "content")


def _of_two(name: str, kind: str, steps: tuple[Step, ...]) -> None:
    rows = " UNION ALL ".join(f"SELECT s_suppkey, {k} AS part_no, 3 AS width, 2 AS height, {_dots(*places)} AS pixels FROM supplier" for k, places in ((1, range(6)), (2, (2, 1, 0, 5, 4, 3))))
    query(name, lambda spark, sf_dir: _pixels(_through(_two(spark, sf_dir, kind), steps)), rows)


_of_two("images_to_gif", "gif", ("gif_to_images",))
_of_two("compress_gif", "gif", ("compress_gif", "gif_to_images"))
_of_two("images_to_pdf", "pdf", ("extract_pdf_images",))
_of_two("icon_of_images", "ico", ("ico_to_images",))

# -- sound, subtitles, archives -----------------------------------------------------------------------------------------

_SAMPLES = "list_transform(embedding, lambda x: floor(x::DOUBLE * 10000)::INT)"


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as WAV files, with the vector's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(["v"] * b.num_rows), pa.array([audio.write_wav(audio.Pcm(8000, 1, np.array(x, dtype=np.int16))) for x in b.column(1).to_pylist()], pa.binary())], names=["file_id", "batch", "name", "content"])

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("int")), F.col("label").cast("long"))
    return vectors.mapInArrow(run, "file_id long, batch long, name string, content binary")


def _samples(files: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([audio.read_wav(x).samples.astype(np.int32) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=[key, "samples"])

    return files.select("file_id", "content").mapInArrow(run, f"{key} long, samples array<int>")


query("convert_audio", lambda spark, sf_dir: _samples(_through(_waves(spark, sf_dir), (("convert_audio", {"target": "wav"}),)), "vec_id"), f"SELECT vec_id, {_SAMPLES} AS samples FROM embeddings")
query("audio_trim", lambda spark, sf_dir: _samples(_through(_waves(spark, sf_dir), (("audio_trim", {"spec": "0.001-0.002,0-0.0005"}),)), "vec_id"), f"SELECT vec_id, {_SAMPLES}[9:16] || {_SAMPLES}[1:4] AS samples FROM embeddings")
query("audio_merge", lambda spark, sf_dir: _samples(V.packed(_waves(spark, sf_dir), "batch", "wav").select(F.col("batch").alias("file_id"), "content"), "label"), f"SELECT label::BIGINT AS label, flatten(list({_SAMPLES} ORDER BY vec_id)) AS samples FROM embeddings GROUP BY 1")
query(
    "audio_denoise", lambda spark, sf_dir: _samples(_through(_waves(spark, sf_dir), ("audio_denoise",)), "vec_id"),
    f"""WITH RECURSIVE v AS (SELECT vec_id, {_SAMPLES} AS x FROM embeddings),
    y AS (SELECT vec_id, x, 1 AS k, x[1]::BIGINT AS y FROM v UNION ALL SELECT vec_id, x, k + 1, x[k + 1] - x[k] + sign(y)::BIGINT * (abs(y) * 995 // 1000) FROM y WHERE k < len(x))
    SELECT vec_id, list(CASE WHEN abs(y) < 200 THEN 0 ELSE least(greatest(y, -32768), 32767) END::INT ORDER BY k) AS samples FROM y GROUP BY 1""",
)

_of_file("extract_subtitles", samples.matroska, ("extract_subtitles",), f"'1' || {_N} || '00:00:01,010 --> 00:00:02,510' || {_N} || s_name || {_N} || {_N} || '2' || {_N} || '00:00:05,000 --> 00:00:07,000' || {_N} || 'key ' || s_suppkey || {_N} || {_N}")
query(
    "unpack_seven_z", lambda spark, sf_dir: _through(_made(spark, sf_dir, samples.seven_z), ("unpack_seven_z",)).select(F.col("file_id").alias("s_suppkey"), F.col("part_no").cast("int").alias("part_no"), F.decode("content", "UTF-8").alias("output")),
    "SELECT s_suppkey, 1 AS part_no, s_name AS output FROM supplier UNION ALL SELECT s_suppkey, 2, s_suppkey::VARCHAR FROM supplier",
)
