"""E-books: EPUB read in the order of its spine, and written by chapters."""

from __future__ import annotations

import hashlib
import re
from xml.sax.saxutils import escape

from tessera.functions.docparts import Part, Rule, chapters, to_html_body
from tessera.functions.htmltext import html_parts
from tessera.functions.tree import FormatError
from tessera.sources.xmlparts import Container, attribute, local, resolve, write_zip


def read_epub(data: bytes) -> tuple[str, list[list[Part]], dict[str, int]]:
    """Title, the parts of each chapter in spine order (but for linear="no"), and counts of what is missing, unknown or unused."""
    z = Container(data)
    if "META-INF/encryption.xml" in z.names and b"EncryptedData" in (z.read("META-INF/encryption.xml") or b""):
        raise FormatError("the book is protected")
    container = z.xml("META-INF/container.xml")
    path = next((attribute(n, "full-path") for n in container.iter() if local(n.tag) == "rootfile"), None) if container is not None else None
    root = z.xml(path) if path else None
    if root is None:
        raise FormatError("no package document")
    folder = path.rpartition("/")[0]
    title = next((n.text or "" for n in root.iter() if local(n.tag) == "title"), "")
    navigation = {attribute(n, "id", "") for n in root.iter() if local(n.tag) == "item" and "nav" in (attribute(n, "properties", "") or "").split()}
    manifest = {attribute(n, "id", ""): (resolve(folder, re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), attribute(n, "href", ""))), attribute(n, "media-type", "")) for n in root.iter() if local(n.tag) == "item"}
    notes = {"missing": 0, "unknown": 0, "unused": 0, "images": sum(kind.startswith("image/") for _, kind in manifest.values())}
    out, used = [], set()
    for ref in (n for n in root.iter() if local(n.tag) == "itemref"):
        ident = attribute(ref, "idref", "")
        if ident not in manifest:
            notes["unknown"] += 1
            continue
        used.add(ident)
        if attribute(ref, "linear", "yes") == "no":
            continue
        page = z.read(manifest[ident][0])
        if page is None:
            notes["missing"] += 1
            continue
        out.append(html_parts(page.decode("utf-8-sig", "replace"))[0])
    notes["unused"] = sum("html" in kind and ident not in used | navigation for ident, (_, kind) in manifest.items())
    if not out:
        raise FormatError("no chapter")
    return title, out, {k: n for k, n in notes.items() if n}


def book_parts(pages: list[list[Part]]) -> list[Part]:
    out: list[Part] = []
    for k, page in enumerate(pages):
        out += [*([Rule()] if k else []), *page]
    return out


def write_epub(parts: list[Part], title: str, author: str = "", language: str = "en") -> bytes:
    """A chapter for each first-level heading; the id follows from the content, so equal input gives equal bytes."""
    found = chapters(parts) or [("", [])]
    pages = [(f"c{k}.xhtml", name or title or f"{k}", to_html_body(own).replace("<br>", "<br/>").replace("<hr>", "<hr/>")) for k, (name, own) in enumerate(found, 1)]
    ident = hashlib.sha256("\0".join([title, author, *(p[2] for p in pages)]).encode()).hexdigest()
    uuid = f"{ident[:8]}-{ident[8:12]}-5{ident[13:16]}-a{ident[17:20]}-{ident[20:32]}"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, (n, _, _) in enumerate(pages, 1))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(pages) + 1))
    listed = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, t, _ in pages)

    def page(t: str, body: str) -> str:
        return f'{head}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(t)}</title></head><body>{body}</body></html>'

    package = f'{head}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{uuid}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{language}</dc:language>{f"<dc:creator>{escape(author)}</dc:creator>" if author else ""}<meta property="dcterms:modified">1980-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    return write_zip([
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", f'{head}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/content.opf", package), ("OEBPS/nav.xhtml", page(title, f'<nav epub:type="toc"><ol>{listed}</ol></nav>')),
        *((f"OEBPS/{n}", page(t, body)) for n, t, body in pages),
    ], ("mimetype",))


# -- MOBI -------------------------------------------------------------------------------------------------------------


def _unpack_palmdoc(data: bytes) -> bytes:
    """PalmDoc's LZ77: literals, runs of 1 to 8, pairs of distance and length, and a space with a letter."""
    out = bytearray()
    k, n = 0, len(data)
    while k < n:
        c = data[k]
        k += 1
        if 1 <= c <= 8:
            out += data[k : k + c]
            k += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes([32, c ^ 0x80])
        elif k < n:
            pair = (c << 8 | data[k]) & 0x3FFF
            k += 1
            distance, length = pair >> 3, (pair & 7) + 3
            if not 0 < distance <= len(out):
                raise FormatError("a back reference leaves the text")
            for _ in range(length):
                out.append(out[-distance])
    return bytes(out)


def read_mobi(data: bytes) -> tuple[str, str]:
    """Title and HTML of an unprotected MOBI without Huffman coding."""
    if len(data) < 78 or data[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        raise FormatError("no MOBI")
    count = int.from_bytes(data[76:78], "big")
    offsets = [int.from_bytes(data[78 + 8 * k : 82 + 8 * k], "big") for k in range(count)] + [len(data)]
    if sorted(offsets) != offsets or not count:
        raise FormatError("the record table is damaged")
    head = data[offsets[0] : offsets[1]]
    packing, texts, protection = int.from_bytes(head[:2], "big"), int.from_bytes(head[8:10], "big"), int.from_bytes(head[12:14], "big")
    if protection:
        raise FormatError("the book is protected")
    if packing not in (1, 2):
        raise FormatError("this compression is not supported")
    mobi = head[16:20] == b"MOBI"
    utf8 = mobi and int.from_bytes(head[28:32], "big") == 65001
    flags = int.from_bytes(head[242:244], "big") if mobi and len(head) >= 244 and int.from_bytes(head[20:24], "big") >= 228 else 0
    body = b""
    for k in range(1, min(texts, count - 1) + 1):
        record = data[offsets[k] : offsets[k + 1]]
        for bit in range(15, 0, -1):  # trailing entries tell their size from behind
            if flags >> bit & 1:
                size = shift = 0
                for c in reversed(record[-4:]):
                    size |= (c & 0x7F) << shift
                    shift += 7
                    if c & 0x80:
                        break
                record = record[: len(record) - size]
        if flags & 1 and record:
            record = record[: len(record) - (record[-1] & 3) - 1]
        body += record if packing == 1 else _unpack_palmdoc(record)
    title = ""
    if mobi and len(head) >= 92:
        at, size = int.from_bytes(head[84:88], "big"), int.from_bytes(head[88:92], "big")
        title = head[at : at + size].decode("utf-8" if utf8 else "cp1252", "replace")
    return title or data[:32].split(b"\0")[0].decode("latin-1"), body.decode("utf-8" if utf8 else "cp1252", "replace")
