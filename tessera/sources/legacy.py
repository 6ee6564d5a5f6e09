"""The binary office formats: compound files, and in them sheets of BIFF5 and BIFF8, Word 97 text and slide text."""

from __future__ import annotations

import re
import struct
from decimal import Decimal

from tessera.functions.tree import FormatError
from tessera.sources.sheets import DATE_FORMATS, Sheet, _is_date, serial_date

_END = 0xFFFFFFFE


class Compound:
    """A compound file's streams by name."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
            raise FormatError("no compound file")
        self.data = data
        self.sector = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        directory, _, self.cutoff, mini_first, _, more, _ = struct.unpack_from("<IIIIIII", data, 48)
        if self.sector not in (512, 4096):
            raise FormatError("the sector size is odd")
        tables = list(struct.unpack_from("<109I", data, 76))
        while more < _END and len(tables) < 1 << 20:
            block = self._sector(more)
            tables += struct.unpack(f"<{self.sector // 4 - 1}I", block[:-4])
            more = struct.unpack("<I", block[-4:])[0]
        self.fat: list[int] = []
        for t in tables:
            if t < _END - 1:
                self.fat += struct.unpack(f"<{self.sector // 4}I", self._sector(t).ljust(self.sector, b"\xff"))
        self.mini_fat = [x for x in struct.iter_unpack("<I", self._chain(mini_first))]
        self.entries: dict[str, tuple[int, int]] = {}
        self.root: tuple[int, int] = (_END, 0)
        listed = self._chain(directory)
        for at in range(0, len(listed) - 127, 128):
            size, kind = struct.unpack_from("<HB", listed, at + 64)
            start, length = struct.unpack_from("<IQ", listed, at + 116)
            length &= 0xFFFFFFFF if self.sector == 512 else (1 << 64) - 1
            if kind == 5:
                self.root = (start, length)
            elif kind == 2 and 2 <= size <= 64:
                self.entries.setdefault(listed[at : at + size - 2].decode("utf-16-le", "replace"), (start, length))

    def _sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.sector : (k + 2) * self.sector]

    def _chain(self, start: int, most: int | None = None) -> bytes:
        out, seen = [], set()
        while start < len(self.fat) and start not in seen and (most is None or len(out) * self.sector < most):
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start, size)[:size]
        pool, out, seen = self._chain(*self.root), [], set()
        while start < len(self.mini_fat) and start not in seen:
            seen.add(start)
            out.append(pool[start * self.mini : (start + 1) * self.mini])
            start = self.mini_fat[start][0]
        return b"".join(out)[:size]


# -- sheets -----------------------------------------------------------------------------------------------------------


def _spell(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e300 else format(Decimal(repr(x)), "f")


def _rk(raw: int) -> float:
    value = float((raw >> 2) - (1 << 30 if raw >> 31 else 0)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class _Strings:
    """Reads strings that may run over from one record into its continuations."""

    def __init__(self, chunks: list[bytes]):
        self.chunks, self.k, self.at = chunks, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.k >= len(self.chunks):
                raise FormatError("the string table is cut off")
            piece = self.chunks[self.k][self.at : self.at + n - len(out)]
            out += piece
            self.at += len(piece)
            if self.at >= len(self.chunks[self.k]) and len(out) < n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.at >= len(self.chunks[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1  # a continuation says anew how wide its characters are
            width = 2 if wide else 1
            part = min(n, (len(self.chunks[self.k]) - self.at) // width)
            if not part:
                raise FormatError("the string table is cut off")
            out += self.take(part * width).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= part
        if runs or extra:
            self.take(4 * runs + extra)
        return out


def _label(data: bytes, at: int, biff8: bool, codec: str) -> str:
    n = struct.unpack_from("<H", data, at)[0]
    if not biff8:
        return data[at + 2 : at + 2 + n].decode(codec, "replace")
    wide = data[at + 2] & 1
    return data[at + 3 : at + 3 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


def read_xls(data: bytes) -> list[Sheet]:
    """Sheets of a BIFF5 or BIFF8 workbook; numbers in plain notation, dates by format, formulas by their cached results."""
    book = Compound(data)
    body = book.stream("Workbook") or book.stream("Book")
    if body is None:
        raise FormatError("no workbook")
    records: list[tuple[int, int, list[bytes]]] = []
    at = 0
    while at + 4 <= len(body):
        kind, n = struct.unpack_from("<HH", body, at)
        if kind == 0x3C and records:
            records[-1][2].append(body[at + 4 : at + 4 + n])
        else:
            records.append((at, kind, [body[at + 4 : at + 4 + n]]))
        at += 4 + n
    if not records or records[0][1] != 0x809:
        raise FormatError("no BIFF5 or BIFF8")
    biff8 = struct.unpack_from("<H", records[0][2][0])[0] >= 0x600
    codec, epoch_1904, shared, formats, styles, places = "cp1252", False, [], {}, [], []
    for _, kind, chunks in records:
        d = chunks[0]
        if kind == 0x2F:
            raise FormatError("the workbook is encrypted")
        if kind == 0x42:
            page = struct.unpack_from("<H", d)[0]
            try:
                b"".decode(f"cp{page}")
                codec = f"cp{page}"
            except LookupError:
                codec = "utf-16-le" if page == 1200 else "cp1252"
        elif kind == 0x22:
            epoch_1904 = d[:1] == b"\1"
        elif kind == 0x85:
            n, flags = d[6], d[7] if biff8 else 0
            name = d[8 : 8 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1", "replace") if biff8 else d[7 : 7 + n].decode(codec, "replace")
            places.append((struct.unpack_from("<I", d)[0], d[5], name))
        elif kind == 0xFC:
            count = struct.unpack_from("<I", d, 4)[0]
            reader = _Strings([d[8:], *chunks[1:]])
            shared = [reader.string() for _ in range(min(count, len(body)))]
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", d)[0]] = _label(d, 2, biff8, codec) if biff8 else d[3 : 3 + d[2]].decode(codec, "replace")
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", d, 2)[0])

    def number(x: float, style: int) -> str:
        form = styles[style] if style < len(styles) else 0
        dated = _is_date(formats[form]) if form in formats else form in DATE_FORMATS
        return serial_date(repr(x), epoch_1904) if dated and 0 <= x < 2_958_466 else _spell(x)

    out = []
    index = {offset: k for k, (offset, _, _) in enumerate(records)}
    for offset, kind, name in places:
        sheet = Sheet(name)
        out.append(sheet)
        if kind or offset not in index:
            sheet.notes.append("SHEET_MISSING" if not kind else "CHART_SHEET")
            continue
        cells: dict[tuple[int, int], str] = {}
        waiting, depth = None, 0
        for _, what, chunks in records[index[offset] :]:
            d = chunks[0]
            if what == 0x809:
                depth += 1
            elif what == 0x0A:
                depth -= 1
                if not depth:
                    break
            elif depth > 1:
                continue
            elif what == 0x207 and waiting:
                cells[waiting] = _label(b"".join(chunks), 0, biff8, codec)
                waiting = None
            elif what in (0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x205) and len(d) >= 6:
                y, x, style = struct.unpack_from("<HHH", d)
                if what == 0xFD:
                    k = struct.unpack_from("<I", d, 6)[0]
                    if k >= len(shared):
                        sheet.notes.append("BAD_SHARED_STRING")
                    else:
                        cells[y, x] = shared[k]
                elif what == 0x204:
                    cells[y, x] = _label(d, 6, biff8, codec)
                elif what == 0x203:
                    cells[y, x] = number(struct.unpack_from("<d", d, 6)[0], style)
                elif what == 0x27E:
                    cells[y, x] = number(_rk(struct.unpack_from("<I", d, 6)[0]), style)
                elif what == 0xBD:
                    for k in range((len(d) - 6) // 6):
                        style, raw = struct.unpack_from("<HI", d, 4 + 6 * k)
                        cells[y, x + k] = number(_rk(raw), style)
                elif what == 0x205:
                    cells[y, x] = ("TRUE" if d[6] else "FALSE") if not d[7] else {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}.get(d[6], "#ERR")
                elif d[12:14] != b"\xff\xff":
                    cells[y, x] = number(struct.unpack_from("<d", d, 6)[0], style)
                elif d[6] == 0:
                    waiting = (y, x)
                elif d[6] == 1:
                    cells[y, x] = "TRUE" if d[8] else "FALSE"
        cells = {k: v for k, v in cells.items() if v}
        height, width = max((y for y, _ in cells), default=-1) + 1, max((x for _, x in cells), default=-1) + 1
        sheet.rows = [[cells.get((y, x), "") for x in range(width)] for y in range(height)]
        sheet.notes = sorted(set(sheet.notes))
    return out


# -- text -------------------------------------------------------------------------------------------------------------


def read_doc(data: bytes) -> tuple[str, list[str]]:
    """The main text of a Word 97 file by its piece table: cells by tabs, field results without their codes."""
    book = Compound(data)
    main = book.stream("WordDocument")
    if main is None or len(main) < 0x1AA or main[:2] != b"\xec\xa5":
        raise FormatError("no Word 97 document")
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    if flags & 0x100:
        raise FormatError("the document is encrypted")
    table = book.stream("1Table" if flags & 0x200 else "0Table") or b""
    length = struct.unpack_from("<I", main, 0x4C)[0]
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx, k = table[at : at + size], 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k + 5 > len(clx) or clx[k] != 2:
        raise FormatError("no piece table")
    plc = clx[k + 5 : k + 5 + struct.unpack_from("<I", clx, k + 1)[0]]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for p in range(n):
        place = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * p + 2)[0]
        count = min(ends[p + 1], length) - ends[p]
        if count <= 0:
            break
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(main[start : start + count].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * count].decode("utf-16-le", "replace"))
    text = "".join(out)
    notes = [f"PICTURES:{n}" for n in [text.count("\x01") + text.count("\x08")] if n]
    before = None
    while before != text:  # inner fields first
        before, text = text, re.sub(r"\x13[^\x13\x14\x15]*(?:\x14([^\x13\x15]*))?\x15", lambda m: m[1] or "", text)
    text = text.replace("\x07\x07", "\n").replace("\x07", "\t").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").replace("\x1e", "-").replace("\x1f", "").replace("\xa0", " ")
    return re.sub("[\x00-\x08\x0e-\x1f]", "", re.sub(r"\t+\n", "\n", text)).strip("\n") + "\n", notes


def read_ppt(data: bytes) -> tuple[str, list[str]]:
    """Texts of a slide file in their order; of equal texts the last stays."""
    body = Compound(data).stream("PowerPoint Document")
    if body is None:
        raise FormatError("no slide file")
    texts: list[str] = []

    def walk(at: int, end: int, depth: int) -> None:
        while at + 8 <= end:
            version, kind, n = struct.unpack_from("<HHI", body, at)
            start, stop = at + 8, min(at + 8 + n, end)
            if version & 0xF == 0xF and depth < 32:
                walk(start, stop, depth + 1)
            elif kind == 0x0FA0:
                texts.append(body[start:stop].decode("utf-16-le", "replace"))
            elif kind == 0x0FA8:
                texts.append(body[start:stop].decode("latin-1"))
            at = at + 8 + n

    walk(0, len(body), 0)
    clean = [re.sub("[\x00-\x08\x0e-\x1f]", "", t.replace("\r", "\n").replace("\x0b", "\n")).strip() for t in texts]
    last = {t: k for k, t in enumerate(clean) if t}
    kept = [t for k, t in enumerate(clean) if t and last[t] == k]
    if not kept:
        raise FormatError("no text")
    dropped = sum(bool(t) for t in clean) - len(kept)
    return "\n\n".join(kept) + "\n", [f"REPEATED:{dropped}"] if dropped else []
