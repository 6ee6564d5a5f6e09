"""7z archives: headers parsed here, streams by the standard library's codecs (LZMA, LZMA2, BCJ, delta, deflate, bzip2, copy)."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

from tessera.functions.tree import FormatError
from tessera.sources.archives import MOST_ENTRY, MOST_TOTAL, Entry, _refuse

#: Method ids of the format (fixed values).
COPY, DELTA, X86, LZMA, LZMA2, DEFLATE, BZIP2, AES = b"\0", b"\3", b"\3\3\1\3", b"\3\1\1", b"\x21", b"\4\1\x08", b"\4\2\2", b"\6\xf1\7\1"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise FormatError("the 7z header is cut off")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """A number whose first byte's leading ones tell how many bytes follow."""
        first = self.byte()
        more = 8 - (~first & 0xFF).bit_length() if first != 0xFF else 8
        low = int.from_bytes(self.take(more), "little")
        return low if more == 8 else low | (first & ((1 << (7 - more)) - 1)) << (8 * more)

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[k // 8] >> (7 - k % 8) & 1) for k in range(n)]

    def digests(self, n: int) -> list[int | None]:
        known = [True] * n if self.byte() else self.bits(n)
        return [struct.unpack("<I", self.take(4))[0] if k else None for k in known]


def _streams(r: _Reader) -> dict:
    """Packed sizes, folders (coders, sizes, digest) and the files' sizes and digests in each."""
    out: dict = {"start": 0, "packed": [], "folders": [], "files": []}
    while (kind := r.byte()) != 0:
        if kind == 0x06:
            out["start"], n = r.number(), r.number()
            while (own := r.byte()) != 0:
                if own == 0x09:
                    out["packed"] = [r.number() for _ in range(n)]
                elif own == 0x0A:
                    r.digests(n)
        elif kind == 0x07:
            if r.byte() != 0x0B:
                raise FormatError("the 7z header has no folders")
            n = r.number()
            if r.byte():
                raise FormatError("external 7z headers are not supported")
            for _ in range(n):
                coders = []
                for _ in range(r.number()):
                    flags = r.byte()
                    ident = r.take(flags & 15)
                    ins, outs = (r.number(), r.number()) if flags & 16 else (1, 1)
                    coders.append((ident, ins, outs, r.take(r.number()) if flags & 32 else b""))
                total_in, total_out = sum(c[1] for c in coders), sum(c[2] for c in coders)
                pairs = [(r.number(), r.number()) for _ in range(total_out - 1)]
                loose = total_in - len(pairs)
                if loose > 1:
                    for _ in range(loose):
                        r.number()
                out["folders"].append({"coders": coders, "pairs": pairs, "loose": loose, "digest": None})
            if r.byte() != 0x0C:
                raise FormatError("the 7z header has no sizes")
            for f in out["folders"]:
                f["sizes"] = [r.number() for c in f["coders"] for _ in range(c[2])]
            while (own := r.byte()) != 0:
                if own == 0x0A:
                    for f, d in zip(out["folders"], r.digests(n), strict=True):
                        f["digest"] = d
        elif kind == 0x08:
            counts = [1] * len(out["folders"])
            own = r.byte()
            if own == 0x0D:
                counts = [r.number() for _ in counts]
                own = r.byte()
            sizes = []
            for f, n in zip(out["folders"], counts, strict=True):
                whole = _whole(f)
                parts = [r.number() for _ in range(n - 1)] if own == 0x09 and n else []
                sizes.append([*parts, whole - sum(parts)] if n else [])
            if own == 0x09:
                own = r.byte()
            wanted = [(k, j) for k, s in enumerate(sizes) for j in range(len(s)) if not (len(s) == 1 and out["folders"][k]["digest"] is not None)]
            crc: dict = {}
            while own != 0:
                if own == 0x0A:
                    crc = dict(zip(wanted, r.digests(len(wanted)), strict=True))
                own = r.byte()
            out["files"] = [[(n, crc.get((k, j), out["folders"][k]["digest"] if len(s) == 1 else None)) for j, n in enumerate(s)] for k, s in enumerate(sizes)]
    if not out["files"]:
        out["files"] = [[(_whole(f), f["digest"])] for f in out["folders"]]
    return out


def _whole(folder: dict) -> int:
    """The size of the stream that no other coder takes."""
    bound = {o for _, o in folder["pairs"]}
    return next(n for k, n in enumerate(folder["sizes"]) if k not in bound)


def _unpacked(folder: dict, data: bytes) -> bytes:
    coders = folder["coders"]
    if any(c[0] == AES for c in coders):
        raise PermissionError("password")
    if folder["loose"] != 1 or any(c[1:3] != (1, 1) for c in coders):
        raise FormatError("this 7z coder graph is not supported")
    feeds = dict(folder["pairs"])  # what comes in at a coder -> whose output it is
    k = next(k for k in range(len(coders)) if k not in feeds.values())
    chain = [k]
    while k in feeds:
        k = feeds[k]
        chain.append(k)
    filters: list[dict] = []
    sizes = folder["sizes"]
    for k in reversed(chain):  # from the packed stream on
        ident, _, _, props = coders[k]
        if ident == LZMA:
            first, size = props[0], struct.unpack("<I", props[1:5])[0]
            filters = [{"id": lzma.FILTER_LZMA1, "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45, "dict_size": max(size, 4096)}]
        elif ident == LZMA2:
            p = props[0]
            filters = [{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, 0xFFFFFFFF if p == 40 else (2 | p & 1) << (p // 2 + 11))}]
        elif ident in (X86, DELTA) and filters:
            filters.insert(0, {"id": lzma.FILTER_X86} if ident == X86 else {"id": lzma.FILTER_DELTA, "dist": props[0] + 1})
        elif ident == DEFLATE:
            data = zlib.decompressobj(-15).decompress(data)
        elif ident == BZIP2:
            data = bz2.decompress(data)
        elif ident != COPY:
            raise FormatError("a 7z method is not supported")
    if filters:
        data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, max_length=sizes[chain[0]])
    return data[: sizes[chain[0]]]


def read_7z(data: bytes) -> list[Entry]:
    """Entries in order; a folder that can't be unpacked gives its files a reason."""
    if data[:6] != b"7z\xbc\xaf\x27\x1c" or len(data) < 32:
        raise FormatError("no 7z archive")
    offset, size, digest = struct.unpack_from("<QQI", data, 12)
    head = data[32 + offset : 32 + offset + size]
    if len(head) < size or zlib.crc32(head) != digest:
        raise FormatError("the 7z header is damaged")
    try:
        while head[:1] == b"\x17":
            r = _Reader(head[1:])
            s = _streams(r)
            if sum(map(_whole, s["folders"])) > MOST_ENTRY:
                raise FormatError("too_large")
            head = _unpacked(s["folders"][0], data[32 + s["start"] : 32 + s["start"] + s["packed"][0]])
        r = _Reader(head)
        if r.byte() != 1:
            raise FormatError("the 7z header is damaged")
        kind, streams = r.byte(), {"start": 0, "packed": [], "folders": [], "files": []}
        if kind == 0x02:
            while (own := r.number()) != 0:
                r.take(r.number())
            kind = r.byte()
        if kind == 0x04:
            streams = _streams(r)
            kind = r.byte()
        names, empty, empty_file = [], [], []
        if kind == 0x05:
            n = r.number()
            empty = [False] * n
            while (own := r.number()) != 0:
                body = _Reader(r.take(r.number()))
                if own == 0x0E:
                    empty = body.bits(n)
                elif own == 0x0F:
                    empty_file = body.bits(sum(empty))
                elif own == 0x11:
                    body.byte()
                    names = body.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
    except PermissionError:
        raise FormatError("password") from None
    except (lzma.LZMAError, zlib.error, OSError, StopIteration, IndexError, struct.error) as e:
        raise FormatError(f"the 7z archive is damaged: {e}") from None
    sizes = [(k, n, crc) for k, files in enumerate(streams["files"]) for n, crc in files]
    out, plan = [], iter(sizes)
    empties = iter(empty_file + [False] * sum(empty))
    owners: list[tuple[int, int, int | None]] = []
    for name, none in zip(names, empty, strict=True):
        if none:
            out.append(Entry(name, 0, not next(empties), None, b""))
            owners.append((-1, 0, None))
        else:
            k, n, crc = next(plan)
            out.append(Entry(name, n, False, "entry_too_large" if n > MOST_ENTRY else None))
            owners.append((k, n, crc))
    if sum(e.size for e in out) <= MOST_TOTAL:
        at = 32 + streams["start"]
        for k, (folder, packed) in enumerate(zip(streams["folders"], streams["packed"], strict=False)):
            mine = [(e, n, crc) for e, (o, n, crc) in zip(out, owners, strict=True) if o == k]
            try:
                body, reason = _unpacked(folder, data[at : at + packed]), None
            except PermissionError:
                body, reason = b"", "password"
            except (FormatError, lzma.LZMAError, zlib.error, OSError, IndexError, struct.error):
                body, reason = b"", "damaged"
            at += packed
            start = 0
            for e, n, crc in mine:
                piece = body[start : start + n]
                start += n
                if reason is None and not e.skip_reason and (len(piece) < n or crc is not None and zlib.crc32(piece) != crc):
                    e.skip_reason = "damaged"
                elif reason:
                    e.skip_reason = reason
                if not e.skip_reason:
                    e.content = piece
    _refuse(out)
    return out
