"""Media columns: signature sniffing, declared types put right, embedded media carved, and lossless 8-bit storage.

An Aho-Corasick automaton finds every magic number of the table in one pass over the bytes. A validator of each format then
walks the structure from there - chunk lengths, checksums, trailers - and gives the length of a sound object or rejects it.
What starts at byte 0 is the value's real type; sound objects further in are embedded media. Containers are searched inside;
objects whose body is samples are not, as any bytes may occur in those.

Null content has no type and nothing embedded. Empty or unrecognised content has type null. Of overlapping finds the first
and longest stays. Repeated rows are handled as they come, other columns stay, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.textkernel import slices

#: Format, magic number, and where in the object the magic number stands (fixed values of the public formats).
SIGNATURES = (
    ("png", b"\x89PNG\r\n\x1a\n", 0), ("gif", b"GIF87a", 0), ("gif", b"GIF89a", 0), ("jpeg", b"\xff\xd8\xff", 0), ("bmp", b"BM", 0),
    ("riff", b"RIFF", 0), ("aiff", b"FORM", 0), ("flac", b"fLaC", 0), ("ogg", b"OggS", 0), ("midi", b"MThd", 0), ("au", b".snd", 0),
    ("pdf", b"%PDF-", 0), ("zip", b"PK\x03\x04", 0), ("gzip", b"\x1f\x8b\x08", 0), ("mp4", b"ftyp", 4),
)
CONTAINERS = {"pdf", "zip", "mp4", "ogg"}
MIME = {
    "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "webp": "image/webp", "wav": "audio/wav", "avi": "video/x-msvideo",
    "aiff": "audio/aiff", "flac": "audio/flac", "ogg": "application/ogg", "midi": "audio/midi", "au": "audio/basic", "pdf": "application/pdf",
    "zip": "application/zip", "gzip": "application/gzip", "mp4": "video/mp4",
}

Found = tuple[str, int, int, int]  # format, length, payload's offset in the object, payload's length


def _png(d: bytes, s: int) -> Found | None:
    at, first = s + 8, True
    body = body_n = 0
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(d[at + 4 : at + 8 + n]) != int.from_bytes(d[at + 8 + n : at + 12 + n], "big"):
            return None
        if kind == b"IDAT" and not body:
            body, body_n = at + 8 - s, n
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return "png", at - s, body, body_n
    return None


def _gif(d: bytes, s: int) -> Found | None:
    if s + 13 > len(d):
        return None
    at = s + 13 + (3 * (2 << (d[s + 10] & 7)) if d[s + 10] & 0x80 else 0)
    frames, body = 0, at - s

    def blocks(at: int) -> int:
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d):
        kind = d[at]
        if kind == 0x3B:
            return ("gif", at + 1 - s, body, at - s - body) if frames else None
        if kind == 0x21 and at + 2 < len(d):
            at = blocks(at + 2)
        elif kind == 0x2C and at + 10 < len(d):
            at = blocks(at + 10 + (3 * (2 << (d[at + 9] & 7)) if d[at + 9] & 0x80 else 0) + 1)
            frames += 1
        else:
            return None
    return None


def _jpeg(d: bytes, s: int) -> Found | None:
    at, framed = s + 2, False
    while at + 4 <= len(d) and d[at] == 0xFF:
        kind = d[at + 1]
        n = int.from_bytes(d[at + 2 : at + 4], "big")
        if kind < 0xC0 or n < 2 or at + 2 + n > len(d):
            return None
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if kind == 0xDA:
            body = at - s
            while framed and (at := d.find(b"\xff", at)) >= 0 and at + 1 < len(d):
                if d[at + 1] == 0xD9:
                    return "jpeg", at + 2 - s, body, at - s - body
                if d[at + 1] and not 0xD0 <= d[at + 1] <= 0xD7 and d[at + 1] != 0xFF:
                    return None if not 0xC0 <= d[at + 1] else _jpeg_rest(d, s, at, body)
                at += 2 if d[at + 1] != 0xFF else 1
            return None
    return None


def _jpeg_rest(d: bytes, s: int, at: int, body: int) -> Found | None:
    """Further scans of a progressive image: up to the end marker."""
    end = d.find(b"\xff\xd9", at)
    return ("jpeg", end + 2 - s, body, end - s - body) if end >= 0 else None


def _bmp(d: bytes, s: int) -> Found | None:
    if s + 30 > len(d):
        return None
    size, reserved, body, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", d, s + 2)
    if header not in (40, 52, 56, 64, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    compressed = struct.unpack_from("<I", d, s + 30)[0] if s + 34 <= len(d) else 0
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    if not 14 + header <= body <= size or s + size > len(d) or (not compressed and body + rows > size):
        return None
    return "bmp", size, body, size - body


def _chunked(d: bytes, s: int, order: str, kinds: dict[bytes, tuple[str, set[bytes], bytes]]) -> Found | None:
    if s + 12 > len(d):
        return None
    size = struct.unpack_from(f"{order}I", d, s + 4)[0]
    known = kinds.get(d[s + 8 : s + 12])
    end = s + 8 + size
    if not known or end > len(d):
        return None
    name, needed, body_kind = known
    at, seen, body, body_n = s + 12, set(), 0, 0
    while at + 8 <= end:
        kind, n = struct.unpack_from(f"{order}4sI", d, at)
        if at + 8 + n > end:
            return None
        seen.add(kind)
        if kind == body_kind and not body:
            body, body_n = at + 8 - s, n
        at += 8 + n + n % 2
    return (name, end + size % 2 - s if end + size % 2 <= len(d) else end - s, body, body_n) if needed <= seen else None


def _riff(d: bytes, s: int) -> Found | None:
    found = _chunked(d, s, "<", {b"WAVE": ("wav", {b"fmt ", b"data"}, b"data"), b"AVI ": ("avi", {b"LIST"}, b"LIST"), b"WEBP": ("webp", set(), b"VP8 ")})
    return None if found and found[0] == "webp" and d[s + 12 : s + 15] != b"VP8" else found


def _aiff(d: bytes, s: int) -> Found | None:
    return _chunked(d, s, ">", {b"AIFF": ("aiff", {b"COMM", b"SSND"}, b"SSND"), b"AIFC": ("aiff", {b"COMM", b"SSND"}, b"SSND")})


def _flac(d: bytes, s: int) -> Found | None:
    at, first, last = s + 4, True, 0
    while not last:
        if at + 4 > len(d):
            return None
        last, kind, n = d[at] >> 7, d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if (first and (kind, n) != (0, 34)) or kind == 127 or at + 4 + n > len(d):
            return None
        at, first = at + 4 + n, False
    if at + 2 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFC != 0xF8:
        return None
    return "flac", len(d) - s, at - s, len(d) - at


def _ogg(d: bytes, s: int) -> Found | None:
    at = s
    while d[at : at + 4] == b"OggS" and at + 27 <= len(d) and d[at + 4] == 0:
        n = d[at + 26]
        size = 27 + n + sum(d[at + 27 : at + 27 + n])
        if at + size > len(d):
            return None
        ends = d[at + 5] & 4
        at += size
        if ends:
            break
    return ("ogg", at - s, 0, at - s) if at > s else None


def _midi(d: bytes, s: int) -> Found | None:
    if s + 14 > len(d):
        return None
    n, kind, tracks = struct.unpack_from(">IHH", d, s + 4)
    at = s + 14
    if n != 6 or kind > 2 or not tracks:
        return None
    for _ in range(tracks):
        if d[at : at + 4] != b"MTrk" or at + 8 > len(d) or (at := at + 8 + int.from_bytes(d[at + 4 : at + 8], "big")) > len(d):
            return None
    return "midi", at - s, 14, at - s - 14


def _au(d: bytes, s: int) -> Found | None:
    if s + 24 > len(d):
        return None
    body, n, coding, rate, channels = struct.unpack_from(">IIIII", d, s + 4)
    if body < 24 or not 1 <= coding <= 27 or not 1000 <= rate <= 768000 or not 1 <= channels <= 64 or s + body + n > len(d):
        return None
    return "au", body + n, body, n


def _pdf(d: bytes, s: int) -> Found | None:
    after = d.find(b"%PDF-", s + 5)
    end = d.rfind(b"%%EOF", s, after if after > 0 else len(d))
    if end < 0 or d.find(b"startxref", s, end) < 0:
        return None
    end += 5
    end += len(d[end : end + 2]) - len(d[end : end + 2].lstrip(b"\r\n"))
    return "pdf", end - s, 0, end - s


def _zip(d: bytes, s: int) -> Found | None:
    at = s
    while (at := d.find(b"PK\x05\x06", at)) >= 0 and at + 22 <= len(d):
        size, directory, comment = struct.unpack_from("<IIH", d, at + 12)
        if s + directory + size == at and (not size or d[s + directory : s + directory + 4] == b"PK\x01\x02") and at + 22 + comment <= len(d):
            return "zip", at + 22 + comment - s, 0, directory
        at += 4
    return None


def _gzip(d: bytes, s: int) -> Found | None:
    machine = zlib.decompressobj(31)
    try:
        for at in range(s, len(d), 1 << 16):
            machine.decompress(d[at : at + (1 << 16)])
            if machine.eof:
                end = min(at + (1 << 16), len(d)) - len(machine.unused_data)
                return "gzip", end - s, 10, end - s - 18
    except zlib.error:
        pass
    return None


def _mp4(d: bytes, s: int) -> Found | None:
    at, kinds = s, []
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if n == 1 and at + 16 <= len(d):
            n = int.from_bytes(d[at + 8 : at + 16], "big")
        if n < 8 or at + n > len(d) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"meta", b"uuid", b"sidx", b"wide", b"udta", b"mfra"):
            break
        kinds.append(kind)
        at += n
    return ("mp4", at - s, 0, at - s) if kinds[:1] == [b"ftyp"] and len(kinds) > 1 else None


VALIDATORS: dict[str, Callable[[bytes, int], Found | None]] = {
    "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "riff": _riff, "aiff": _aiff, "flac": _flac, "ogg": _ogg, "midi": _midi, "au": _au,
    "pdf": _pdf, "zip": _zip, "gzip": _gzip, "mp4": _mp4,
}

_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        by_magic: dict[bytes, list[tuple[str, int]]] = {}
        for name, magic, shift in SIGNATURES:
            by_magic.setdefault(magic, []).append((name, shift))
        for magic, names in by_magic.items():
            made.add_word(magic.decode("latin-1"), (len(magic), names))
        made.make_automaton()
        _automaton = made
    return _automaton


def sniff(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """Sound objects as (format, offset, length, payload offset, payload length), in order of their offsets; none overlaps an
    earlier one unless that is a container."""
    out: list[tuple[str, int, int, int, int]] = []
    closed = 0
    text = data.decode("latin-1")
    starts = {(end - n + 1 - shift, name) for end, (n, names) in automaton().iter(text) for name, shift in names}
    for start, name in sorted(starts):
        if start < closed or start < 0:
            continue
        found = VALIDATORS[name](data, start)
        if found:
            kind, length, body, body_n = found
            out.append((kind, start, length, start + body, body_n))
            if kind not in CONTAINERS:
                closed = start + length
    return out


SPAN = "struct<format:string,offset:long,length:long,payload_offset:long,payload_length:long>"
_span_type = pa.struct([("format", pa.string()), *((x, pa.int64()) for x in ("offset", "length", "payload_offset", "payload_length"))])


def sniff_media(frame: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """The frame with sniffed_format, sniffed_mime, type_corrected (the declared type is another), media (the object at 0) and
    embedded (the others, as spans of the content). Columns of the frame with these names are replaced."""
    store.bounded(frame.sparkSession)
    added = ("sniffed_format", "sniffed_mime", "type_corrected", "media", "embedded")
    frame = frame.drop(*added)
    kept = frame.schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sniffed_format string", "sniffed_mime string", "type_corrected boolean", f"media {SPAN}", f"embedded array<{SPAN}>"])
    at = kept.names.index(content)
    said = kept.names.index(declared) if declared else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [f.name for f in _span_type]
        for batch in slices(batches, content, 4 << 20):
            rows = [None if x is None else [dict(zip(keys, s, strict=True)) for s in sniff(x)] for x in batch.column(at).to_pylist()]
            first = [r[0] if r and r[0]["offset"] == 0 else None for r in rows]
            mime = [x and MIME[x["format"]] for x in first]
            stated = batch.column(said).to_pylist() if said is not None else [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([x and x["format"] for x in first], pa.string()), pa.array(mime, pa.string()),
                    pa.array([bool(m) and bool(d) and m != d for m, d in zip(mime, stated, strict=True)], pa.bool_()), pa.array(first, _span_type),
                    pa.array([None if r is None else r[1:] if f else r for r, f in zip(rows, first, strict=True)], pa.list_(_span_type)),
                ],
                names=[*kept.names, *added],
            )

    return frame.mapInArrow(run, ddl)


RATE = 8000


def store_wav(payload: bytes) -> bytes:
    """A payload of even length as the 8-bit samples of a mono WAV file."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def features(samples: np.ndarray) -> str:
    """Whole-number features of unsigned 8-bit samples: count, sum, extremes, crossings of the middle, and counts by 16 levels."""
    high = samples >= 128
    levels = np.bincount(samples >> 4, minlength=16)
    return f"wav/{RATE}Hz/8bit/mono n={len(samples)} sum={int(samples.sum(dtype=np.int64))} min={samples.min()} max={samples.max()} crossings={int((high[1:] != high[:-1]).sum())} levels={','.join(map(str, levels.tolist()))}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared_type and content: each whole text's UTF-8 with zero bytes up to a positive multiple of 64, as WAV."""
    store.bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = [x.encode() if x else b"" for x in batch.column(1).to_pylist()]
            media = [store_wav(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(["text/plain"] * len(texts)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared_type", "content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, declared_type string, content binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of what sniff_media found stored: the payload is cut out of the content by the carved span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", 4 << 20):
            rows = []
            for doc_id, n, content, corrected, span in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                payload = content[span["payload_offset"] : span["payload_offset"] + span["payload_length"]]
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(content), hashlib.sha256(content).hexdigest(), features(np.frombuffer(payload, np.uint8)), span["format"], corrected))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_format", "type_corrected"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_format string, type_corrected boolean"
    return stored.select("doc_id", "n_bytes", "content", "type_corrected", "media").mapInArrow(run, ddl)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(sniff_media(store_texts(store.documents(spark, sf_dir)), "content", "declared_type"))
