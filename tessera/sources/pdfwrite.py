"""PDF files written from text and pictures: standard fonts, JPEG as it is, pixels by Flate."""

from __future__ import annotations

import struct
import zlib

from tessera.functions.docparts import Para, Part, Rule, Table, square
from tessera.functions.tree import FormatError
from tessera.sources import rasters

#: Points (fixed values).
PAPERS = {"a4": (595, 842), "letter": (612, 792), "a5": (420, 595), "a3": (842, 1191)}


def _file(objects: list[bytes]) -> bytes:
    """Objects numbered from 1, of which the first is the catalogue."""
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def _stream(body: bytes, head: bytes = b"") -> bytes:
    return b"<< " + head + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream"


def _jpeg_size(data: bytes) -> tuple[int, int, int]:
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack_from(">HHB", data, at + 5)
            return width, height, parts
        at += 2 + n
    raise FormatError("the JPEG has no frame")


def images_pdf(pictures: list[bytes], paper: str = "a4", margin: int = 0) -> bytes:
    """A page for each picture, fitted into the paper and centred; landscape pictures turn the paper."""
    objects: list[bytes] = [b"", b""]
    pages = []
    for data in pictures:
        if data[:3] == b"\xff\xd8\xff":
            width, height, parts = _jpeg_size(data)
            space = {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}.get(parts)
            if space is None:
                raise FormatError("the JPEG's colours are odd")
            objects.append(_stream(data, b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /DCTDecode " % (width, height, space)))
        else:
            pixels = rasters.read_picture(data)
            height, width = pixels.shape[:2]
            body, mask = zlib.compress(pixels[:, :, :3].tobytes()), b""
            if (pixels[:, :, 3] < 255).any():
                objects.append(_stream(zlib.compress(pixels[:, :, 3].tobytes()), b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode " % (width, height)))
                mask = b"/SMask %d 0 R " % len(objects)
            objects.append(_stream(body, b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode " % (width, height) + mask))
        image = len(objects)
        w, h = sorted(PAPERS[paper], reverse=width > height)
        scale = min((w - 2 * margin) / width, (h - 2 * margin) / height)
        if scale <= 0:
            raise FormatError("the margins leave no room")
        x, y = (w - width * scale) / 2, (h - height * scale) / 2
        objects.append(_stream(b"q %.3f 0 0 %.3f %.3f %.3f cm /I Do Q" % (width * scale, height * scale, x, y)))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (w, h, image, len(objects)))
        pages.append(len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % p for p in pages) + b"] /Count %d >>" % len(pages)
    return _file(objects)


def _lines(parts: list[Part], units: float) -> list[tuple[str, str, str]]:
    """(text, font, style) of lines wrapped to a width in average characters; tables become columns of Courier."""
    out: list[tuple[str, str, str]] = []

    def wrap(text: str, font: str, style: str, room: float) -> None:
        for paragraph in text.split("\n"):
            line = ""
            for word in paragraph.split(" "):
                while len(word) > room:
                    if line:
                        out.append((line, font, style))
                        line = ""
                    out.append((word[: int(room)], font, style))
                    word = word[int(room) :]
                if line and len(line) + 1 + len(word) > room:
                    out.append((line, font, style))
                    line = word
                else:
                    line = f"{line} {word}" if line else word
            out.append((line, font, style))

    number = 0
    for p in parts:
        if isinstance(p, Rule):
            out.append(("-" * int(units), "F3", "body"))
        elif isinstance(p, Table):
            rows = square(p.rows)
            widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))] if rows else []
            for row in rows:
                wrap("  ".join(c.replace("\n", " ").ljust(w) for c, w in zip(row, widths, strict=True)).rstrip(), "F3", "body", units * 0.85)
        elif isinstance(p, Para):
            number = number + 1 if p.bullet else 0
            lead = "  " * p.indent + (f"{number}. " if p.bullet else "- ") if p.bullet is not None else ""
            heading = p.style[0] == "h"
            wrap(lead + p.text, "F2" if heading else "F3" if p.style == "code" else "F1", p.style, units * (0.7 if heading else 0.85 if p.style == "code" else 1))
            if p.bullet is None:
                out.append(("", "F1", "body"))
    return out


def text_pdf(parts: list[Part], paper: str = "a4", size: int = 11, margin: int = 56, line_height: float = 1.4, number_pages: bool = True) -> tuple[bytes, list[str]]:
    """Paged text in the standard fonts; characters that Windows-1252 lacks are counted and shown as `?`."""
    width, height = PAPERS[paper]
    units = max(8.0, (width - 2 * margin) / (0.5 * size))
    lost = 0
    pages: list[list[bytes]] = [[]]
    y = height - margin - size
    for text, font, style in _lines(parts, units):
        own = size * {"h1": 1.8, "h2": 1.5, "h3": 1.25}.get(style, 1.0)
        if y < margin:
            pages.append([])
            y = height - margin - size
        raw = text.encode("cp1252", "replace")
        lost += sum(1 for c in text if c != "?" and c.encode("cp1252", "replace") == b"?")
        if text:
            escaped = raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            pages[-1].append(b"BT /%s %.1f Tf %d %.1f Td (%s) Tj ET" % (font.encode(), own, margin, y, escaped))
        y -= own * line_height
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    fonts = []
    for name in (b"Helvetica", b"Helvetica-Bold", b"Courier"):
        objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name)
        fonts.append(len(objects))
    resources = b"<< /Font << /F1 %d 0 R /F2 %d 0 R /F3 %d 0 R >> >>" % tuple(fonts)
    kids = []
    for k, page in enumerate(pages, 1):
        if number_pages:
            page.append(b"BT /F1 9 Tf %d %.1f Td (%d) Tj ET" % (width // 2, margin / 2, k))
        objects.append(_stream(zlib.compress(b"\n".join(page)), b"/Filter /FlateDecode "))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources %s /Contents %d 0 R >>" % (width, height, resources, len(objects)))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % p for p in kids) + b"] /Count %d >>" % len(kids)
    return _file(objects), [f"CHARACTERS_LOST:{lost}"] if lost else []
