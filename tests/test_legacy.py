"""Binary office formats and Matroska, from files built here."""

import struct

import pytest

from tessera.functions.subtitles import Cue
from tessera.functions.tree import FormatError
from tessera.operators.convert import KERNELS
from tessera.plans.samples import compound
from tessera.sources import legacy, matroska


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def workbook(pad=0):
    text = "Grüße"
    sst = struct.pack("<II", 3, 3) + struct.pack("<HB", 5, 0) + text.encode("latin-1") + struct.pack("<HB", 4, 1) + "ab".encode("utf-16-le")
    rest = b"\0cd" + struct.pack("<HBH", 1, 8, 1) + b"z" + bytes(4)  # goes on in a continuation, narrow now; then a formatted one
    head = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)) + record(0x41E, struct.pack("<HHB", 164, 10, 0) + b"yyyy-mm-dd") + record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + record(0xE0, struct.pack("<HH", 0, 164) + bytes(16)) + record(0xFC, sst) + record(0x3C, rest)
    name = b"Sheet"
    size = len(head) + 4 + 8 + len(name) + 4
    head += record(0x85, struct.pack("<IBBBB", size, 0, 0, len(name), 0) + name) + record(0x0A, b"")
    cells = [
        (0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), (0xFD, struct.pack("<HHHI", 0, 1, 0, 1)), (0xFD, struct.pack("<HHHI", 0, 2, 0, 2)), (0x203, struct.pack("<HHHd", 1, 0, 0, 1.5)), (0x203, struct.pack("<HHHd", 1, 1, 1, 45000.0)),
        (0x27E, struct.pack("<HHHI", 1, 2, 0, (123456 << 2) | 3)), (0xBD, struct.pack("<HHHIHIH", 2, 0, 0, (7 << 2) | 2, 0, ((-5 & 0x3FFFFFFF) << 2) | 2, 1)), (0x205, struct.pack("<HHHBB", 2, 2, 0, 1, 0)),
        (0x06, struct.pack("<HHH", 3, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)), (0x207, struct.pack("<HB", 2, 0) + b"ok"), (0x06, struct.pack("<HHHd", 3, 1, 0, 1e21) + bytes(8)), (0x204, struct.pack("<HHHHB", 3, 2, 0, 1, 0) + b"L"),
    ]
    return head + record(0x809, struct.pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + b"".join(record(k, b) for k, b in cells) + record(0x0A, b"") + bytes(pad)


@pytest.mark.parametrize("pad", [0, 5000])
def test_xls(pad):
    sheet = legacy.read_xls(compound({"Workbook": workbook(pad)}))[0]
    assert sheet.name == "Sheet"
    assert sheet.rows == [["Grüße", "abcd", "z"], ["1.5", "2023-03-15", "1234.56"], ["7", "-5", "TRUE"], ["ok", "1000000000000000000000", "L"]]
    assert KERNELS["xls_to_csv"](compound({"Workbook": workbook(pad)}), "b.xls")[0][0][1].startswith("Grüße,abcd,z\n".encode())


def test_doc():
    text = "One\rTwo \x13 HYPERLINK x \x14link\x15 é\x07b\x07\x07"
    narrow, wide = text[:4].encode("cp1252"), text[4:].encode("utf-16-le")
    pieces = struct.pack("<III", 0, 4, len(text)) + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0) + struct.pack("<HIH", 0, 0x500, 0)
    clx = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(pieces)) + pieces
    main = bytearray(0x600)
    main[:2] = b"\xec\xa5"
    struct.pack_into("<H", main, 0x0A, 0x200)
    struct.pack_into("<I", main, 0x4C, len(text))
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    main[0x400 : 0x400 + len(narrow)] = narrow
    main[0x500 : 0x500 + len(wide)] = wide
    assert legacy.read_doc(compound({"WordDocument": bytes(main), "1Table": clx})) == ("One\nTwo link é\tb\n", [])


def test_ppt():
    def atom(kind, body):
        return struct.pack("<HHI", 0, kind, len(body)) + body

    inner = atom(0x0FA0, "Títle\r2".encode("utf-16-le")) + atom(0x0FA8, b"body") + atom(0x0FA8, b"again") + atom(0x0FA8, b"body")
    body = struct.pack("<HHI", 0xF, 0x0FF0, len(inner)) + inner
    assert legacy.read_ppt(compound({"PowerPoint Document": body})) == ("Títle\n2\n\nagain\n\nbody\n", ["REPEATED:1"])


def test_what_is_refused():
    for read in (legacy.read_xls, legacy.read_doc, legacy.read_ppt):
        for bad in (b"", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(10), compound({"Other": b"x"})):
            with pytest.raises(FormatError):
                read(bad)


def element(ident, body):
    raw = ident.to_bytes((ident.bit_length() + 7) // 8, "big")
    return raw + (0x10000000 | len(body)).to_bytes(4, "big") + body


def test_matroska():
    track = element(0xAE, element(0xD7, b"\x02") + element(0x83, b"\x11") + element(0x86, b"S_TEXT/UTF8"))
    group = element(0xA0, element(0xA1, b"\x82\x00\x0a\x00Hi\nyou") + element(0x9B, b"\x05\xdc"))
    cluster = element(0x1F43B675, element(0xE7, b"\x03\xe8") + group + element(0xA3, b"\x82\x0f\xa0\x00later") + element(0xA3, b"\x81\x00\x00\x00video"))
    data = element(0x1A45DFA3, b"") + element(0x18538067, element(0x1549A966, element(0x2AD7B1, b"\x0f\x42\x40")) + element(0x1654AE6B, track) + cluster)
    assert matroska.read_subtitles(data) == [Cue(1010, 2510, ("Hi", "you")), Cue(5000, 7000, ("later",))]
    with pytest.raises(FormatError):
        matroska.read_subtitles(data[:4])
