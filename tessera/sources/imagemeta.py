"""Image containers without their pixels: identifying segments listed and cut out byte for byte, icons taken apart and put together."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from tessera.functions.tree import FormatError

#: JPEG segments and PNG and WebP chunks that may identify a person, a place or a device (fixed values).
JPEG_IDENTIFYING = {0xE1: "exif_xmp", 0xED: "photoshop", 0xFE: "comment"}
PNG_IDENTIFYING = {b"tEXt": "text", b"zTXt": "text", b"iTXt": "text", b"eXIf": "exif", b"tIME": "time"}
WEBP_IDENTIFYING = {b"EXIF": "exif", b"XMP ": "xmp"}


@dataclass
class Segment:
    kind: str
    offset: int
    length: int
    identifying: bool


def segments(data: bytes) -> list[Segment]:
    """All segments up to the pixels' end; damaged structure is refused."""
    out: list[Segment] = []
    if data.startswith(b"\xff\xd8\xff"):
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise FormatError("a JPEG segment doesn't begin with its marker")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            n = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            if kind == 0xDA:
                out.append(Segment("scan", at, len(data) - at, False))
                return out
            if at + n > len(data):
                raise FormatError("a JPEG segment is cut off")
            name = JPEG_IDENTIFYING.get(kind, f"app{kind - 0xE0}" if 0xE0 <= kind <= 0xEF else f"{kind:02x}")
            out.append(Segment(name, at, n, kind in JPEG_IDENTIFYING or (0xE3 <= kind <= 0xEC)))
            at += n
        raise FormatError("the JPEG has no scan")
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        at = 8
        while at + 12 <= len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            if at + 12 + n > len(data) or zlib.crc32(data[at + 4 : at + 8 + n]) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
                raise FormatError("a PNG chunk is damaged")
            out.append(Segment(PNG_IDENTIFYING.get(kind, kind.decode("latin-1")), at, n + 12, kind in PNG_IDENTIFYING))
            at += n + 12
            if kind == b"IEND":
                return out
        raise FormatError("the PNG has no end")
    if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
        at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
        while at + 8 <= end:
            kind, n = struct.unpack_from("<4sI", data, at)
            size = 8 + n + n % 2
            if at + 8 + n > len(data):
                raise FormatError("a WebP chunk is cut off")
            out.append(Segment(WEBP_IDENTIFYING.get(kind, kind.decode("latin-1").strip()), at, size, kind in WEBP_IDENTIFYING))
            at += size
        return out
    raise FormatError("neither JPEG, PNG nor WebP")


def clean(data: bytes) -> tuple[bytes, list[str]]:
    """The image without identifying segments, every other byte as it was; an orientation that goes with EXIF is reported."""
    found = segments(data)
    gone = [s for s in found if s.identifying]
    out = bytearray()
    at = 0
    for s in gone:
        out += data[at : s.offset]
        at = s.offset + s.length
    out += data[at:]
    if data.startswith(b"RIFF"):
        out[4:8] = (len(out) - 8).to_bytes(4, "little")
        if out[12:16] == b"VP8X":
            out[20] &= ~0x0C  # no EXIF, no XMP
    kinds = [s.kind for s in gone]
    return bytes(out), [f"REMOVED_{k.upper()}:{kinds.count(k)}" for k in dict.fromkeys(kinds)]


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG of RGBA rows."""
    rows = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def _bitmap(data: bytes) -> bytes:
    """An icon's bitmap of 1, 4, 8, 24 or 32 bits as PNG; the mask below it gives transparency where the pixels have none."""
    head, width, double, planes, depth = struct.unpack_from("<IiiHH", data)
    height = double // 2
    if head < 40 or depth not in (1, 4, 8, 24, 32) or not 0 < width <= 1024 or not 0 < height <= 1024:
        raise FormatError("the icon's bitmap is not supported")
    colours = int.from_bytes(data[32:36], "little") or (1 << depth if depth <= 8 else 0)
    palette = data[head : head + 4 * colours]
    at, stride, mask_stride = head + 4 * colours, (width * depth + 31) // 32 * 4, (width + 31) // 32 * 4
    if len(data) < at + stride * height:
        raise FormatError("the icon's bitmap is cut off")
    mask = data[at + stride * height : at + (stride + mask_stride) * height]
    alpha = depth == 32 and any(data[at + 3 : at + stride * height : 4])
    out = bytearray()
    for y in range(height - 1, -1, -1):
        row = data[at + y * stride : at + (y + 1) * stride]
        for x in range(width):
            if depth >= 24:
                b, g, r = row[x * depth // 8 : x * depth // 8 + 3]
            else:
                index = row[x * depth // 8] >> (8 - depth - x * depth % 8) & ((1 << depth) - 1)
                b, g, r = (palette[4 * index : 4 * index + 3] + b"\0\0\0")[:3]
            hidden = mask and len(mask) == mask_stride * height and mask[y * mask_stride + x // 8] >> (7 - x % 8) & 1
            out += bytes((r, g, b, row[4 * x + 3] if alpha else 0 if hidden else 255))
    return png(width, height, bytes(out))


def icon_images(data: bytes) -> list[tuple[int, int, bytes]]:
    """(width, height, PNG) of an icon's pictures."""
    zero, kind, count = struct.unpack_from("<HHH", data) if len(data) >= 6 else (1, 0, 0)
    if zero or kind != 1 or not count or len(data) < 6 + 16 * count:
        raise FormatError("no icon")
    out = []
    for k in range(count):
        width, height, _, _, _, _, size, at = struct.unpack_from("<BBBBHHII", data, 6 + 16 * k)
        body = data[at : at + size]
        if len(body) < size:
            raise FormatError("a picture is cut off")
        out.append((width or 256, height or 256, body if body.startswith(b"\x89PNG") else _bitmap(body)))
    return out


def icon_of(pictures: list[bytes]) -> bytes:
    """An icon of PNG pictures of up to 256 by 256."""
    out, at, bodies = struct.pack("<HHH", 0, 1, len(pictures)), 6 + 16 * len(pictures), b""
    for p in pictures:
        if not p.startswith(b"\x89PNG\r\n\x1a\n") or len(p) < 24:
            raise FormatError("no PNG")
        width, height = struct.unpack_from(">II", p, 16)
        if not (0 < width <= 256 and 0 < height <= 256):
            raise FormatError("an icon's picture has up to 256 by 256 pixels")
        out += struct.pack("<BBBBHHII", width % 256, height % 256, 0, 0, 1, 32, len(p), at + len(bodies))
        bodies += p
    return out + bodies


# -- EXIF ---------------------------------------------------------------------------------------------------------------

#: Names of the usual tags (fixed values).
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime",
    0x829D: "FNumber", 0x8827: "ISO", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "FocalLength", 0xA430: "CameraOwner", 0xA431: "BodySerialNumber", 0xA434: "LensModel",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def tiff_fields(data: bytes) -> dict[str, str]:
    """Named fields of a TIFF structure's directories; unsigned rationals are read as such."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise FormatError("no TIFF structure")
    out: dict[str, str] = {}
    seen: set[int] = set()

    def directory(at: int, names: dict[int, str]) -> None:
        if at in seen or not 8 <= at <= len(data) - 2:
            return
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            place = at + 2 + 12 * k
            if place + 12 > len(data):
                return
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            size = _SIZES.get(kind, 0) * count
            start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            if not size or start + size > len(data):
                continue
            if tag in (0x8769, 0x8825) and kind == 4:
                directory(struct.unpack_from(order + "I", data, start)[0], GPS_TAGS if tag == 0x8825 else TAGS)
            elif tag in names:
                if kind in (2, 7):
                    value = data[start : start + size].split(b"\0")[0].decode("utf-8", "replace").strip()
                elif kind in (5, 10):
                    parts = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, start)
                    value = " ".join(f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2], strict=True))
                else:
                    value = " ".join(map(str, struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, start)))
                if value:
                    out[names[tag]] = value

    directory(struct.unpack_from(order + "I", data, 4)[0], TAGS)
    return out


def exif_fields(data: bytes) -> dict[str, str]:
    """The EXIF fields of a JPEG, PNG, WebP or TIFF; none where the picture has no EXIF."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return tiff_fields(data)
    for s in segments(data):
        body = data[s.offset : s.offset + s.length]
        if s.kind == "exif_xmp" and body[4:10] == b"Exif\0\0":
            return tiff_fields(body[10:])
        if s.kind == "exif":
            return tiff_fields(body[8:].removeprefix(b"Exif\0\0"))
    return {}
