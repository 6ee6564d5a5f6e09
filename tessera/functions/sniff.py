"""The kind of a file by its first bytes, and of zip and OLE containers by what they hold."""

from __future__ import annotations

import io
import re
import zipfile

HEAD = 512
#: Magic numbers in the order in which they are tried: kind, offset, bytes (fixed values of the public formats).
MAGIC = (
    ("pdf", 0, b"%PDF-"), ("png", 0, b"\x89PNG\r\n\x1a\n"), ("jpeg", 0, b"\xff\xd8\xff"), ("gif", 0, b"GIF87a"), ("gif", 0, b"GIF89a"), ("webp", 8, b"WEBP"),
    ("wav", 8, b"WAVE"), ("avi", 8, b"AVI "), ("bmp", 0, b"BM"), ("tiff", 0, b"II*\0"), ("tiff", 0, b"MM\0*"), ("ico", 0, b"\0\0\1\0"),
    ("flac", 0, b"fLaC"), ("ogg", 0, b"OggS"), ("mp3", 0, b"ID3"), ("mkv", 0, b"\x1aE\xdf\xa3"), ("zip", 0, b"PK\3\4"), ("zip", 0, b"PK\5\6"),
    ("7z", 0, b"7z\xbc\xaf\x27\x1c"), ("rar", 0, b"Rar!\x1a\x07"), ("gzip", 0, b"\x1f\x8b"), ("ole", 0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"),
    ("mobi", 60, b"BOOKMOBI"), ("sqlite", 0, b"SQLite format 3\0"), ("rtf", 0, b"{\\rtf"), ("tar", 257, b"ustar"),
)
FTYP = {b"M4A ": "m4a", b"M4B ": "m4a", b"heic": "heic", b"heix": "heic", b"mif1": "heic", b"avif": "avif", b"qt  ": "mov"}
FAMILIES = {
    "image": {"png", "jpeg", "gif", "webp", "bmp", "tiff", "ico", "heic", "avif"}, "audio": {"wav", "flac", "ogg", "mp3", "m4a"}, "video": {"mp4", "mov", "avi", "mkv"},
    "archive": {"zip", "7z", "rar", "gzip", "tar"}, "office": {"docx", "xlsx", "pptx", "odt", "ods", "doc", "xls", "ppt", "rtf"}, "book": {"epub", "mobi"},
    "text": {"text", "html", "xml", "json"}, "pdf": {"pdf"},
}


def looks_like_text(head: bytes) -> bool:
    """No NUL, and control characters are 5 % at most."""
    return b"\0" not in head and 20 * sum(c < 32 and c not in (9, 10, 12, 13, 27) for c in head) <= len(head)


def sniff(head: bytes) -> str:
    """The kind by the first 512 bytes; under 12 bytes only text is told."""
    head = head[:HEAD]
    if len(head) >= 12:
        for kind, at, magic in MAGIC:
            if head.startswith(magic, at) and (at != 8 or head.startswith(b"RIFF")):
                return kind
        if head[4:8] == b"ftyp":
            return FTYP.get(head[8:12], "mp4")
        if head[0] == 0xFF and head[1] & 0xE0 == 0xE0 and head[1] & 6:
            return "mp3"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "text"
    if not head or not looks_like_text(head):
        return "unknown"
    start = head.removeprefix(b"\xef\xbb\xbf").lstrip().lower()
    if re.match(rb"<!doctype html|<html|<head|<body", start):
        return "html"
    if start.startswith(b"<?xml"):
        return "html" if b"<html" in start else "xml"
    return "json" if start[:1] in (b"{", b"[") else "text"


def refine(kind: str, data: bytes) -> str:
    """What a zip or OLE container is, by its parts or streams."""
    if kind == "zip":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
                mime = z.read("mimetype")[:80].decode("latin-1").strip() if "mimetype" in names and z.getinfo("mimetype").file_size < 200 else ""
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError):
            return kind
        by_mime = {"application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods"}
        by_part = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx", "META-INF/container.xml": "epub"}
        return by_mime.get(mime) or next((k for part, k in by_part.items() if part in names), kind)
    if kind == "ole":
        streams = {"doc": "WordDocument", "xls": "Workbook", "ppt": "PowerPoint Document"}
        return next((k for k, s in streams.items() if s.encode("utf-16-le") in data), "xls" if "Book".encode("utf-16-le") in data else kind)
    return kind


def family(kind: str) -> str:
    return next((f for f, kinds in FAMILIES.items() if kind in kinds), "other")
