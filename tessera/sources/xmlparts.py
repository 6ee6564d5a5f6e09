"""Zip containers of XML parts: reading with size limits, and plain writing."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.etree import ElementTree

from tessera.functions.tree import FormatError

#: Limits of one part and of a container (fixed values).
MOST_PART, MOST_TOTAL = 32 << 20, 512 << 20


class Container:
    """A zip archive whose members are read on demand."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise FormatError(f"no zip archive: {e}") from None
        self.names = {i.filename: i for i in self.zip.infolist()}

    def read(self, name: str) -> bytes | None:
        info = self.names.get(name)
        if info is None:
            return None
        if info.flag_bits & 1:
            raise FormatError(f"{name} is encrypted")
        if info.file_size > MOST_PART:
            raise FormatError(f"{name} is too large")
        try:
            return self.zip.read(info)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError) as e:
            raise FormatError(f"{name}: {e}") from None

    def xml(self, name: str) -> ElementTree.Element | None:
        data = self.read(name)
        if data is None:
            return None
        if b"<!DOCTYPE" in data[:4096]:
            raise FormatError(f"{name} has a document type")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise FormatError(f"{name}: {e}") from None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (type's last word, target) of a part's relations, targets resolved against its folder."""
        folder, _, name = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = resolve(folder, target)
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out


def resolve(folder: str, target: str) -> str:
    if target.startswith("/"):
        return target[1:]
    out = folder.split("/") if folder else []
    for step in target.split("/"):
        if step == "..":
            out = out[:-1]
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out)


def local(tag: str) -> str:
    """A tag or attribute name without its namespace."""
    return tag.rsplit("}", 1)[-1]


def attribute(node: ElementTree.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by local name, whatever its namespace."""
    return next((v for k, v in node.attrib.items() if local(k) == name), default)


def write_zip(members: list[tuple[str, str | bytes]], stored: tuple[str, ...] = ()) -> bytes:
    """A zip archive of members in order with a fixed time, so that equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()
