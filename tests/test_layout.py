"""Wrapping, EXIF fields, recognised pages and release assets."""

import struct

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import layout
from tessera.operators import relational as R
from tessera.sources import imagemeta


def test_wrapping():
    assert layout.wrap("one two three", 0.55 * 7) == ["one two", "three"]
    assert layout.wrap("中文字符，测试", 4) == ["中文字符，", "测试"] and layout.wrap("中文（字符）", 3) == ["中文", "（字符）"]
    assert layout.wrap("abcdefghij k", 0.55 * 4) == ["abcd", "efgh", "ij k"] and layout.wrap("a\n\nb", 5) == ["a", "", "b"]
    for text in ("word " * 50, "混合 text 与中文 mixed " * 9):
        assert all(layout.width_of(x) <= 6 + 1 for x in layout.wrap(text, 6)) and "".join("".join(layout.wrap(text, 6)).split()) == "".join(text.split())


def tiff(order):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    text = b"Camera X\0"
    entries = [(0x0110, 2, len(text), 100), (0x0112, 3, 1, struct.pack(order + "HH", 6, 0)), (0x8769, 4, 1, 140), (0x8825, 4, 1, 180)]
    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + (v if isinstance(v, bytes) else struct.pack(order + "I", v)) for t, k, n, v in entries)
    out = (mark + struct.pack(order + "I", 8) + body).ljust(100, b"\0") + text
    out = out.ljust(140, b"\0") + struct.pack(order + "HHHII", 1, 0x829A, 5, 1, 170)
    out = out.ljust(170, b"\0") + struct.pack(order + "II", 4_000_000_000, 1)
    return out.ljust(180, b"\0") + struct.pack(order + "HHHI", 1, 1, 2, 2) + b"N\0\0\0"


def test_exif():
    want = {"Model": "Camera X", "Orientation": "6", "ExposureTime": "4000000000/1", "GPSLatitudeRef": "N"}
    for order in "<>":
        assert imagemeta.exif_fields(tiff(order)) == want
    segment = b"Exif\0\0" + tiff("<")
    jpeg = b"\xff\xd8\xff\xe1" + (len(segment) + 2).to_bytes(2, "big") + segment + b"\xff\xda\x00\x02pixels\xff\xd9"
    assert imagemeta.exif_fields(jpeg) == want and imagemeta.exif_fields(imagemeta.clean(jpeg)[0]) == {}


def test_pages_and_assets(spark):
    rows = spark.createDataFrame([(1, "a \r\n"), (2, " ")], "n int, x string").select("n", C.ocr_page(F.col("n"), F.lit(2), F.col("x")).alias("p")).orderBy("n").collect()
    assert [r.p for r in rows] == ["===== page 1 / 2 =====\na", "===== page 2 / 2 =====\n(no text)"]
    assets = spark.createDataFrame([(1, "app-debug.apk", 5), (1, "App-Release.apk", 9), (1, "app-release-x.apk", 8), (2, "b", 2), (2, "a", 2)], "r int, name string, size long")
    assert sorted(map(tuple, R.pick_asset(assets, "r", "name", "size").collect())) == [(1, "app-release-x.apk", 8), (2, "a", 2)]
