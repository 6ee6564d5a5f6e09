"""Archives: zip, tar and gzip into entries with reasons for what is skipped, and out of files."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from dataclasses import dataclass

from tessera.functions.tree import FormatError
from tessera.sources.xmlparts import write_zip

#: Limits of one entry and of an archive (fixed values).
MOST_ENTRY, MOST_TOTAL = 64 << 20, 512 << 20


@dataclass
class Entry:
    name: str
    size: int
    is_dir: bool
    skip_reason: str | None = None
    content: bytes | None = None


def _refuse(entries: list[Entry]) -> None:
    files = [e for e in entries if not e.is_dir]
    if not files:
        raise FormatError("only_directories" if entries else "empty")
    if sum(e.size for e in files) > MOST_TOTAL:
        raise FormatError("too_large")
    if all(e.skip_reason for e in files):
        raise FormatError("nothing_usable")


def read_zip(data: bytes, contents: bool = True) -> list[Entry]:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise FormatError(f"no zip archive: {e}") from None
    out = []
    for i in z.infolist():
        reason = "password" if i.flag_bits & 1 else "entry_too_large" if i.file_size > MOST_ENTRY else "compression" if i.compress_type not in (0, 8, 12, 14) else None
        out.append(Entry(i.filename, i.file_size, i.is_dir(), reason))
    _refuse(out)
    if contents:
        for e, i in zip(out, z.infolist(), strict=True):
            if not e.is_dir and not e.skip_reason:
                try:
                    e.content = z.read(i)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
                    e.skip_reason = "damaged"
    return out


def read_tar(data: bytes, contents: bool = True) -> list[Entry]:
    """tar, also compressed; members up to the first damaged header."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            out = []
            for m in t:
                reason = None if m.isfile() or m.isdir() else "link" if m.issym() or m.islnk() else "special"
                reason = "entry_too_large" if reason is None and m.size > MOST_ENTRY else reason
                out.append(Entry(m.name, m.size, m.isdir(), reason, t.extractfile(m).read() if contents and m.isfile() and not reason else None))
                if sum(e.size for e in out) > MOST_TOTAL:
                    break
    except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
        raise FormatError(f"no tar archive: {e}") from None
    _refuse(out)
    return out


def read_gzip(data: bytes, name: str = "") -> Entry:
    """The one file in a gzip stream; its stored name, else the archive's without .gz."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
            content = g.read(MOST_ENTRY + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise FormatError(f"no gzip: {e}") from None
    if len(content) > MOST_ENTRY:
        raise FormatError("too_large")
    stored = ""
    if len(data) > 10 and data[3] & 8:
        at = 10 + (2 + int.from_bytes(data[10:12], "little") if data[3] & 4 else 0)
        stored = data[at : data.find(b"\0", at)].decode("latin-1")
    return Entry(stored or name.removesuffix(".gz") or "content", len(content), False, None, content)


def unique_entry_names(names: list[str], unnamed: str = "unnamed") -> list[str]:
    """Repeated names get _2, _3, ... before their extension."""
    taken: set[str] = set()
    out = []
    for raw in names:
        name = raw if raw.strip() else unnamed
        stem, dot, ext = name.rpartition(".")
        if not dot:
            stem, ext = name, ""
        made, n = name, 2
        while made in taken:
            made, n = f"{stem}_{n}{dot}{ext}", n + 1
        taken.add(made)
        out.append(made)
    return out


def pack_zip(files: list[tuple[str, bytes]]) -> bytes:
    """Files under unique names; content that is compressed already is stored."""
    names = unique_entry_names([n for n, _ in files])
    packed = (b"PK\x03\x04", b"\x1f\x8b", b"\xff\xd8\xff", b"\x89PNG", b"GIF8", b"7z\xbc\xaf", b"Rar!")
    return write_zip([(n, d) for n, (_, d) in zip(names, files, strict=True)], tuple(n for n, (_, d) in zip(names, files, strict=True) if d.startswith(packed)))


def pack_tar(files: list[tuple[str, bytes]]) -> bytes:
    """tar.gz without times, so that equal input gives equal bytes."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, (_, data) in zip(unique_entry_names([n for n, _ in files]), files, strict=True):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return gzip.compress(raw.getvalue(), mtime=0)
