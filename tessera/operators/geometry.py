"""Tables and structure out of positioned text: words into rows and columns, lines into paragraphs and headings.

words: file_id, page, text, left, right, top, bottom. lines: file_id, page, text, size, bold, left, right, top, height. A group is one
page or one file, so a task holds one at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.docparts import to_html, to_markdown, to_text
from tessera.operators.structure import lines_to_parts, page_tables
from tessera.sources import books, documents, pdfread

def tables_from_words(words: DataFrame) -> DataFrame:
    """(file_id, page, table_no, row_no, cells) of every page."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = page_tables([(r["text"], r["left"], r["right"], r["top"], r["bottom"]) for r in table.to_pylist()])
        rows = [(key[0].as_py(), key[1].as_py(), t, y, cells) for t, rows in enumerate(found, 1) for y, cells in enumerate(rows, 1)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file_id", "page", "table_no", "row_no", "cells"])

    typed = words.where(F.col("text").isNotNull()).select(F.col("file_id").cast("long"), F.col("page").cast("int"), "text", *(F.col(c).cast("double") for c in ("left", "right", "top", "bottom")))
    return typed.groupBy("file_id", "page").applyInArrow(run, "file_id long, page int, table_no int, row_no int, cells array<string>")


def documents_from_lines(lines: DataFrame, target: str = "html") -> DataFrame:
    """(file_id, content) of every file: html, markdown, text, docx or epub."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = lines_to_parts(table.to_pylist())
        made = {"html": to_html, "markdown": to_markdown, "text": to_text, "docx": documents.write_docx, "epub": lambda p: books.write_epub(p, f"{key[0].as_py()}")}[target](parts)
        return pa.table({"file_id": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([made if isinstance(made, bytes) else made.encode()], pa.binary())})

    typed = lines.select(F.col("file_id").cast("long"), F.col("page").cast("int"), "text", F.col("bold").cast("boolean"), *(F.col(c).cast("double") for c in ("size", "left", "right", "top", "height")))
    return typed.groupBy("file_id").applyInArrow(run, "file_id long, content binary")


def words_from_files(files: DataFrame) -> DataFrame:
    """(file_id, page, text, left, right, top, bottom, size, bold, error) of the text layer of PDF files; a file that can't be read is a
    row with its error and nothing else."""

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.bool_(), pa.string()]
        names = ["file_id", "page", "text", "left", "right", "top", "bottom", "size", "bold", "error"]
        for batch in batches:
            rows = []
            for file_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = pdfread.read_pdf(data or b"")
                except Exception as e:  # a damaged file must not stop the others
                    rows.append((file_id, *[None] * 8, str(e) or type(e).__name__))
                    continue
                rows += [(file_id, k, *(w[x] for x in names[2:-1]), None) for k, words in enumerate(pages, 1) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return files.select(F.col("file_id").cast("long"), F.col("content").cast("binary")).mapInArrow(run, "file_id long, page int, text string, left double, right double, top double, bottom double, size double, bold boolean, error string")
