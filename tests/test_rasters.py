"""Pixels: round trips, filters, and the structure of written PDFs by the media sniffer's rules."""

import re
import struct
import zlib

import numpy as np
import pytest

from tessera.functions.docparts import Para, Run, Table
from tessera.functions.tree import FormatError
from tessera.operators.convert import KERNELS
from tessera.sources import pdfwrite, rasters


def picture(seed=1, height=7, width=5, colours=6):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    table[:, 3] = 255
    return table[rng.integers(0, colours, (height, width))]


def test_round_trips():
    p = picture()
    assert np.array_equal(rasters.read_png(rasters.write_png(p)), p) and np.array_equal(rasters.read_bmp(rasters.write_bmp(p)), p)
    p[2, 3] = 0
    body, notes = rasters.write_gif([(p, 50), (picture(2), 120)])
    frames = rasters.read_gif(body)
    assert not notes and [d for _, d in frames] == [50, 120] and np.array_equal(frames[0][0], p)
    wide = picture(3, 60, 70, 4000)
    body, notes = rasters.write_gif([(wide, 100)])
    assert notes == ["COLOURS_REDUCED:1"] and np.abs(rasters.read_gif(body)[0][0].astype(int) - wide).max() <= 64
    exact = picture(4, 90, 80, 255)
    assert np.array_equal(rasters.read_gif(rasters.write_gif([(exact, 10)])[0])[0][0], exact)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    p = picture(5, 6, 4, 200)
    flat = p.reshape(6, 16).astype(int)
    rows = []
    for y in range(6):
        left = np.concatenate([np.zeros(4, int), flat[y, :-4]])
        up = flat[y - 1] if y else np.zeros(16, int)
        corner = np.concatenate([np.zeros(4, int), up[:-4]])
        guess = left + up - corner
        best = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
        rows.append(bytes([kind]) + ((flat[y] - [0, left, up, (left + up) // 2, best][kind]) % 256).astype(np.uint8).tobytes())

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert np.array_equal(rasters.read_png(data), p)


def test_picture_operations():
    p = picture()
    png = rasters.write_png(p)
    run = lambda name, **k: KERNELS[name](png, "p.png", **k)[0][0][1]
    assert np.array_equal(rasters.read_png(run("flip_image", mode=0)), p[:, ::-1]) and np.array_equal(rasters.read_png(run("rotate_image", degrees=90)), np.rot90(p, -1))
    assert np.array_equal(rasters.read_png(run("crop_image", rect="1,2,3,99")), p[2:, 1:4]) and rasters.read_png(run("crop_image", aspect="1:1")).shape == (5, 5, 4)
    assert np.array_equal(rasters.read_bmp(run("convert_image", target="bmp")), p)
    gif = rasters.write_gif([(p, 50), (picture(2), 70)])[0]
    assert [s for s, _ in KERNELS["gif_to_images"](gif, "g.gif")[0]] == ["_1.png", "_2.png"]
    for bad in ("1,2,3", "1,2%,3,4", "9,9,1,1", "x"):
        with pytest.raises(FormatError):
            run("crop_image", rect=bad)
    for bad in (b"", png[:40], b"GIF89a" + bytes(20), b"BM" + bytes(60)):
        with pytest.raises((FormatError, struct.error, ValueError)):
            rasters.read_picture(bad)


def test_pdfs():
    book = pdfwrite.images_pdf([rasters.write_png(picture()), rasters.write_bmp(picture(2))])
    text, notes = pdfwrite.text_pdf([Para([Run("Title (x)")], "h1"), Para([Run("word " * 900 + "中")]), Table(True, [["a", "b"], ["1", "2"]])])
    for data in (book, text):
        start = int(re.search(rb"startxref\n(\d+)", data)[1])
        places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
        assert data[start : start + 4] == b"xref" and all(data[p:].startswith(b"%d 0 obj" % k) for k, p in enumerate(places, 1))
    assert notes == ["CHARACTERS_LOST:1"] and book.count(b"/Type /Page /") == 2
    pages = [zlib.decompress(x) for x in re.findall(rb"FlateDecode /Length \d+ >>\nstream\n(.*?)\nendstream", text, re.S)]
    assert b"(Title \\(x\\))" in pages[0] and len(pages) > 1
