"""Damaged input: kernels give outputs or raise, and never hang; on Spark every damaged file becomes an error row."""

import random

import numpy as np
import pytest

from tessera.functions import docparts, markdown
from tessera.operators import audio
from tessera.operators import convert as V
from tessera.sources import archives, books, documents, rasters, sheets

PARTS = markdown.markdown_parts("# T\n\na **b**\n\n- x\n\n| h |\n|---|\n| 1 |\n")[0]
GOOD = {
    "json_to_csv": b'[{"a":1.50,"b":[1]}]', "yaml_to_json": b"a: [1, {b: c}]\nd:\n- e\n- |\n  f\n", "toml_to_json": b'a = 1\n[[b]]\nc = "x"\n', "xml_to_json": b"<a b='1'><c>x</c><c/></a>", "ini_to_json": b"a=1\n[s]\nb=2\n",
    "sql_to_csv": b"CREATE TABLE t (a INT); INSERT INTO t VALUES (1, 'x');", "convert_subtitle": b"1\n00:00:01,500 --> 00:00:03,000\nHi\n", "html_to_markdown": b"<p>a <b>b</b><table><tr><td>1</table>", "md_to_html": b"# a\n\n- b\n\n`c`\n",
    "docx_to_text": documents.write_docx(PARTS), "odt_to_text": documents.write_odt(PARTS), "rtf_to_text": documents.write_rtf(PARTS).encode(), "epub_to_text": books.write_epub(PARTS, "t"),
    "xlsx_to_csv": sheets.write_xlsx([sheets.Sheet("s", [["a", "1"]])])[0], "ods_to_csv": sheets.write_ods([sheets.Sheet("s", [["a", "1"]])]), "unpack_zip": archives.pack_zip([("a", b"x" * 50)]), "untar": archives.pack_tar([("a", b"x" * 50)]),
    "audio_volume": audio.write_wav(audio.Pcm(8000, 1, np.arange(50, dtype=np.int16))), "flip_image": rasters.write_png(np.full((3, 4, 4), 9, np.uint8)), "gif_to_images": rasters.write_gif([(np.full((3, 4, 4), 255, np.uint8), 10)])[0],
    "text_to_pdf": b"some text\n", "clean_metadata": rasters.write_png(np.zeros((2, 2, 4), np.uint8)), "format_json": b'{"a":1}',
}


@pytest.mark.parametrize("name", sorted(GOOD))
def test_good_input_and_any_damage(name):
    good = GOOD[name]
    assert V.KERNELS[name](good, "f.x")[0]
    rng = random.Random(name)
    for _ in range(150):
        data = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            what = rng.random()
            at = rng.randrange(len(data) + 1)
            if what < 0.4 and data:
                data[min(at, len(data) - 1)] = rng.randrange(256)
            elif what < 0.7:
                del data[at : at + rng.randint(1, 20)]
            else:
                data[at:at] = bytes(rng.choices(range(256), k=rng.randint(1, 8)))
        try:
            V.KERNELS[name](bytes(data), "f.x")
        except Exception as e:
            assert not isinstance(e, MemoryError | AssertionError)


def test_error_rows(spark):
    rows = [(k, "f", bytes(random.Random(k).choices(range(256), k=60))) for k in range(20)] + [(99, "f", GOOD["docx_to_text"])]
    files = spark.createDataFrame(rows, "file_id long, name string, content binary")
    for name in ("docx_to_text", "yaml_to_json", "xlsx_to_csv", "gif_to_images"):
        out = V.convert(files, name).collect()
        assert {r.file_id for r in out} == {r[0] for r in rows}
    assert V.sniffed(files).where("file_id = 99").first().kind == "docx" and docparts.to_text(PARTS)
