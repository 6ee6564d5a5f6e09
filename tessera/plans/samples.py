"""Small files of formats that nothing here writes, made around a key and a name: inputs of queries and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file: large streams in sectors, small ones in the mini stream."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(body: bytes) -> int:
        if not body:
            return 0xFFFFFFFE
        first = len(sectors)
        count = -(-len(body) // 512)
        for k in range(count):
            sectors.append(body[k * 512 : (k + 1) * 512].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < count else 0xFFFFFFFE)
        return first

    pool, mini_fat, entries = b"", [], []
    for name, body in streams.items():
        if len(body) >= 4096:
            entries.append((name, 2, put(body), len(body)))
        else:
            first, count = len(mini_fat), -(-len(body) // 64)
            pool += body.ljust(count * 64, b"\0")
            mini_fat += [first + k + 1 if k + 1 < count else 0xFFFFFFFE for k in range(count)]
            entries.append((name, 2, first, len(body)))
    entries.insert(0, ("Root Entry", 5, put(pool), len(pool)))
    mini = put(b"".join(struct.pack("<I", x) for x in mini_fat))
    rows = b"".join((n.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBBIII", len(n) * 2 + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", start, size) for n, kind, start, size in entries)
    directory = put(rows)
    tables = -(-(len(fat) + 2) // 127)
    at = len(sectors)
    fat += [0xFFFFFFFD] * tables
    packed = b"".join(struct.pack("<I", x) for x in fat).ljust(tables * 512, b"\xff")
    sectors += [packed[k * 512 : (k + 1) * 512] for k in range(tables)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", tables, directory, 0, 4096, mini, 1, 0xFFFFFFFE, 0)
    return head + b"".join(struct.pack("<I", at + k if k < tables else 0xFFFFFFFF) for k in range(109)) + b"".join(sectors)


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def xls(key: int, name: str) -> bytes:
    """A workbook of one sheet: id and name, then the key as a number and the name as shared text."""
    texts = ["id", "name", name]
    shared = struct.pack("<II", 3, 3) + b"".join(struct.pack("<HB", len(x), 1) + x.encode("utf-16-le") for x in texts)
    begin = lambda kind: _record(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    head = begin(5) + _record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + _record(0xFC, shared)
    head += _record(0x85, struct.pack("<IBBBB", len(head) + 4 + 8 + 1 + 4, 0, 0, 1, 0) + b"S") + _record(0x0A, b"")
    cells = [_record(0xFD, struct.pack("<HHHI", 0, k, 0, k)) for k in (0, 1)] + [_record(0x203, struct.pack("<HHHd", 1, 0, 0, key)), _record(0xFD, struct.pack("<HHHI", 1, 1, 0, 2))]
    return compound({"Workbook": head + begin(16) + b"".join(cells) + _record(0x0A, b"")})


def doc(key: int, name: str) -> bytes:
    """A document of two paragraphs, the name in one-byte and the key in two-byte characters."""
    one, two = name + "\r", f"key {key}\r"
    pieces = struct.pack("<III", 0, len(one), len(one) + len(two)) + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0) + struct.pack("<HIH", 0, 0x500, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    main = bytearray(0x600)
    main[:2] = b"\xec\xa5"
    struct.pack_into("<H", main, 0x0A, 0x200)
    struct.pack_into("<I", main, 0x4C, len(one) + len(two))
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    main[0x400 : 0x400 + len(one)] = one.encode("cp1252")
    main[0x500 : 0x500 + 2 * len(two)] = two.encode("utf-16-le")
    return compound({"WordDocument": bytes(main), "1Table": clx})


def ppt(key: int, name: str) -> bytes:
    """Slides with the name as title and the key as text."""

    def atom(kind: int, body: bytes, container: int = 0) -> bytes:
        return struct.pack("<HHI", container, kind, len(body)) + body

    return compound({"PowerPoint Document": atom(0x0FF0, atom(0x0FA0, name.encode("utf-16-le")) + atom(0x0FA8, f"key {key}".encode()), 0xF)})


def mobi(key: int, name: str) -> bytes:
    """A book of one stored record of HTML."""
    text = f"<h1>Book</h1><p>{name} has key {key}</p>".encode()
    head = b"\0\1\0\0" + struct.pack(">IHHI", len(text), 1, 4096, 0)
    start = 78 + 16 + 2
    table = b"".join(struct.pack(">II", x, 0) for x in (start, start + len(head)))
    return b"Book".ljust(32, b"\0") + bytes(28) + b"TEXtREAd" + bytes(8) + struct.pack(">H", 2) + table + b"\0\0" + head + text


def matroska(key: int, name: str) -> bytes:
    """A track of two subtitles: the name from 1.01 to 2.51 s and the key from 5 s."""

    def element(ident: int, body: bytes) -> bytes:
        return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (0x10000000 | len(body)).to_bytes(4, "big") + body

    track = element(0xAE, element(0xD7, b"\x02") + element(0x83, b"\x11") + element(0x86, b"S_TEXT/UTF8"))
    group = element(0xA0, element(0xA1, b"\x82\x00\x0a\x00" + name.encode()) + element(0x9B, b"\x05\xdc"))
    cluster = element(0x1F43B675, element(0xE7, b"\x03\xe8") + group + element(0xA3, b"\x82\x0f\xa0\x00" + f"key {key}".encode()))
    return element(0x1A45DFA3, b"") + element(0x18538067, element(0x1549A966, element(0x2AD7B1, b"\x0f\x42\x40")) + element(0x1654AE6B, track) + cluster)


def seven_z(key: int, name: str) -> bytes:
    """An archive of two stored files, n.txt with the name and k.txt with the key."""
    files = [("n.txt", name.encode()), ("k.txt", str(key).encode())]
    body = b"".join(d for _, d in files)
    streams = b"\x06\0\1\x09" + bytes([len(body)]) + b"\0\x07\x0b\x01\0\x01\x01\0\x0c" + bytes([len(body)]) + b"\0"
    streams += b"\x08\x0d\x02\x09" + bytes([len(files[0][1])]) + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(d)) for _, d in files) + b"\0\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in files)
    head = b"\x01\x04" + streams + b"\x05\x02\x11" + bytes([len(names)]) + names + b"\0\0"
    start = struct.pack("<QQI", len(body), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + head


def pptx(key: int, name: str) -> bytes:
    """Two slides: a title and a text each."""
    p, a, r = ("http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships")

    def shape(kind: str, text: str) -> str:
        place = f'<p:nvSpPr><p:cNvPr id="1" name="x"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>'
        return f"<p:sp>{place}<p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"

    def relations(*rows: tuple[str, str, str]) -> str:
        return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{r}/{t}" Target="{x}"/>' for i, t, x in rows) + "</Relationships>"

    slide = lambda title, text: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{shape("title", title)}{shape("body", text)}</p:spTree></p:cSld></p:sld>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, body in {
            "_rels/.rels": relations(("r1", "officeDocument", "ppt/presentation.xml")),
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": relations(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
            "ppt/slides/slide1.xml": slide("Last", f"key {key}"),
            "ppt/slides/slide2.xml": slide("First", name),
        }.items():
            z.writestr(zipfile.ZipInfo(path), body)
    return out.getvalue()
