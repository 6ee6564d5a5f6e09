"""PDF files out of pages of PDF files: chosen, ordered, turned, cut, fitted to paper, stamped, with new properties."""

from __future__ import annotations

import math
import re

from tessera.functions.tree import FormatError
from tessera.sources.pdfread import Document, Name, Operator, Ref, Stream
from tessera.sources.pdfwrite import PAPERS

Page = tuple[Document, dict]


def parse_spec(spec: str, total: int) -> list[int]:
    """Indices from 0 of `3, 7-5, -2, 9-` in its order, repeats kept; pages that don't exist are refused."""
    out: list[int] = []
    tokens = [t for t in re.split(r"[,，;；、\s]+", spec.strip()) if t]
    if not tokens:
        raise FormatError("the page spec is empty")
    for t in tokens:
        m = re.fullmatch(r"(\d*)(-?)(\d*)", t)
        if not m or t == "-":
            raise FormatError(f"{t} is no page or range")
        first = int(m[1]) if m[1] else 1
        last = first if not m[2] else int(m[3]) if m[3] else total
        if not (1 <= first <= total and 1 <= last <= total):
            raise FormatError(f"{t}: there are {total} pages")
        out += range(first - 1, last) if first <= last else range(first - 1, last - 2, -1)
    return out


class _Writer:
    def __init__(self):
        self.objects: list[bytes | None] = [None, None]  # the catalogue and the page tree
        self.places: dict[tuple[int, int], int] = {}
        self.waiting: list[tuple[Document, int, int]] = []

    def add(self, body: bytes | None) -> int:
        self.objects.append(body)
        return len(self.objects)

    def put(self, doc: Document, x) -> bytes:
        if isinstance(x, Ref):
            key = (id(doc), x.number)
            if key not in self.places:
                self.places[key] = self.add(None)
                self.waiting.append((doc, x.number, self.places[key]))
            return b"%d 0 R" % self.places[key]
        if x is None or isinstance(x, Operator):
            return b"null"
        if isinstance(x, bool):
            return b"true" if x else b"false"
        if isinstance(x, Name):
            return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in str(x).encode("latin-1", "replace"))
        if isinstance(x, bytes):
            return b"<" + x.hex().encode() + b">"
        if isinstance(x, int):
            return b"%d" % x
        if isinstance(x, float):
            return (f"{x:.6f}".rstrip("0").rstrip(".") or "0").encode()
        if isinstance(x, list):
            return b"[" + b" ".join(self.put(doc, v) for v in x) + b"]"
        if isinstance(x, dict):
            return b"<< " + b" ".join(self.put(doc, Name(k)) + b" " + self.put(doc, v) for k, v in x.items()) + b" >>"
        if isinstance(x, Stream):
            head = {k: v for k, v in x.head.items() if k != "Length"} | {"Length": len(x.raw)}
            return self.put(doc, head) + b"\nstream\n" + x.raw + b"\nendstream"
        raise FormatError("an object can't be written")

    def finish(self, kids: list[int], information: dict[str, str] | None) -> bytes:
        while self.waiting:
            doc, number, place = self.waiting.pop()
            found = doc.objects.get(number)
            self.objects[place - 1] = self.put(doc, None if isinstance(found, dict) and found.get("Type") in ("Pages", "Catalog") else found)
        self.objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
        self.objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % k for k in kids) + b"] /Count %d >>" % len(kids)
        extra = b""
        if information:
            body = b"<< " + b" ".join(b"/" + k.encode() + b" <" + (b"\xfe\xff" + v.encode("utf-16-be")).hex().encode() + b">" for k, v in information.items()) + b" >>"
            extra = b" /Info %d 0 R" % self.add(body)
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for k, body in enumerate(self.objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n" % k + (body or b"null") + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, extra, start))


def build(pages: list[Page], information: dict[str, str] | None = None) -> bytes:
    """A file of pages of any documents; what they share is written once."""
    if not pages:
        raise FormatError("no page is left")
    w = _Writer()
    kids = []
    for doc, page in pages:
        own = {k: v for k, v in page.items() if k not in ("Parent", "Type", "Annots", "StructParents", "B")}
        body = w.put(doc, own)
        kids.append(w.add(b"<< /Type /Page /Parent 2 0 R " + body[3:]))
    return w.finish(kids, information)


def read(data: bytes) -> list[Page]:
    doc = Document(data)
    if not doc.pages:
        raise FormatError("the PDF has no page")
    return [(doc, p) for p in doc.pages]


def information(data: bytes) -> dict[str, str]:
    """The file's properties."""
    m = None
    for m in re.finditer(rb"/Info\s+(\d+)\s+\d+\s+R", data):
        pass
    doc = Document(data)
    found = doc.objects.get(int(m[1])) if m else None
    out = {}
    for k, v in found.items() if isinstance(found, dict) else ():
        v = doc.get(v)
        if isinstance(v, bytes):
            out[k] = v[2:].decode("utf-16-be", "replace") if v.startswith(b"\xfe\xff") else v.decode("latin-1")
    return out


def box_of(page: Page) -> list[float]:
    doc, p = page
    return [float(doc.get(x)) for x in doc.get(p.get("MediaBox")) or (0, 0, 612, 792)]


def rotated(pages: list[Page], chosen: set[int], degrees: int) -> list[Page]:
    if degrees % 90:
        raise FormatError("pages turn by quarters")
    return [(d, p | {"Rotate": (int(d.get(p.get("Rotate")) or 0) + degrees) % 360} if k in chosen else p) for k, (d, p) in enumerate(pages)]


def cropped(pages: list[Page], margin: float) -> list[Page]:
    out = []
    for page in pages:
        left, bottom, right, top = box_of(page)
        if right - left <= 2 * margin or top - bottom <= 2 * margin:
            raise FormatError("the margin leaves nothing")
        out.append((page[0], page[1] | {"MediaBox": [left + margin, bottom + margin, right - margin, top - margin], "CropBox": [left + margin, bottom + margin, right - margin, top - margin]}))
    return out


def _wrapped(page: Page, before: bytes, after: bytes, fonts: dict | None = None) -> Page:
    """The page with content before and after its own, and more fonts."""
    doc, p = page
    contents = p.get("Contents")
    found = doc.get(contents)
    listed = list(found) if isinstance(found, list) else [contents] if contents is not None else []
    resources = dict(doc.get(p.get("Resources")) or {})
    if fonts:
        resources["Font"] = dict(doc.get(resources.get("Font")) or {}) | fonts
    ends = []
    for body in (before, after):
        number = max(doc.objects, default=0) + 1
        doc.objects[number] = Stream({}, body)
        ends.append(Ref(number))
    return doc, p | {"Contents": [ends[0], *listed, ends[1]], "Resources": resources}


def resized(pages: list[Page], paper: str = "a4", mode: str = "contain") -> list[Page]:
    """Pages on paper that lies as they are seen: contain, cover or stretch, centred."""
    out = []
    for page in pages:
        left, bottom, right, top = box_of(page)
        width, height = right - left, top - bottom
        swapped = int(page[0].get(page[1].get("Rotate")) or 0) % 180 == 90
        seen = (height, width) if swapped else (width, height)
        target = sorted(PAPERS[paper], reverse=seen[0] > seen[1])
        sx, sy = target[0] / seen[0], target[1] / seen[1]
        if mode != "stretch":
            sx = sy = min(sx, sy) if mode == "contain" else max(sx, sy)
        ux, uy = (sy, sx) if swapped else (sx, sy)
        w, h = (target[1], target[0]) if swapped else target
        tx, ty = (w - width * ux) / 2 - left * ux, (h - height * uy) / 2 - bottom * uy
        doc, p = _wrapped(page, b"q %.6f 0 0 %.6f %.4f %.4f cm\n" % (ux, uy, tx, ty), b"\nQ")
        out.append((doc, {k: v for k, v in p.items() if k != "CropBox"} | {"MediaBox": [0, 0, float(w), float(h)]}))
    return out


_HELVETICA = {"TesseraF": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}


def stamped(pages: list[Page], texts: dict[int, str], size: float, spot: str = "bottom_center", margin: float = 20) -> list[Page]:
    """A line of text at bottom_center, bottom_right, bottom_left or top_center of some pages."""
    side, align = spot.split("_")
    out = []
    for k, page in enumerate(pages):
        if k not in texts:
            out.append(page)
            continue
        left, bottom, right, top = box_of(page)
        raw = texts[k].encode("cp1252", "replace")
        width = 0.5 * size * len(raw)
        x = {"left": left + margin, "center": (left + right - width) / 2, "right": right - margin - width}[align]
        y = bottom + margin + 0.25 * size if side == "bottom" else top - margin - size
        body = b"Q q BT /TesseraF %.1f Tf %.2f %.2f Td <%s> Tj ET Q" % (size, x, y, raw.hex().encode())
        out.append(_wrapped(page, b"q", body, _HELVETICA))
    return out


def watermarked(pages: list[Page], text: str, columns: int = 1, rows: int = 1, tilt: float = 45, grey: float = 0.75) -> list[Page]:
    """A text in a grid of places, tilted, in grey behind nothing and over everything."""
    columns, rows = min(max(columns, 1), 12), min(max(rows, 1), 12)
    raw = text.encode("cp1252", "replace")
    out = []
    for page in pages:
        left, bottom, right, top = box_of(page)
        size = min(160.0, max(6.0, 0.9 * (right - left) / columns / max(1, 0.55 * len(raw))))
        a = math.radians(tilt)
        body = b"Q q %.2f g " % grey
        for r in range(rows):
            for c in range(columns):
                x, y = left + (right - left) * (c + 0.5) / columns, bottom + (top - bottom) * (r + 0.5) / rows
                half = 0.25 * size * len(raw)
                body += b"BT /TesseraF %.1f Tf %.4f %.4f %.4f %.4f %.2f %.2f Tm <%s> Tj ET " % (size, math.cos(a), math.sin(a), -math.sin(a), math.cos(a), x - half * math.cos(a), y - half * math.sin(a), raw.hex().encode())
        out.append(_wrapped(page, b"q", body + b"Q", _HELVETICA))
    return out


def by_size(pages: list[Page], target: int) -> list[list[Page]]:
    """Greedy runs whose files stay within `target` bytes, found by doubling and halving; a page over it stands alone."""
    out, at = [], 0
    while at < len(pages):
        good, step = at + 1, 1
        while good < len(pages) and len(build(pages[at : min(good + step, len(pages))])) <= target:
            good, step = min(good + step, len(pages)), step * 2
        low, high = good, min(good + step, len(pages))
        while low < high:  # the most pages that still fit
            middle = (low + high + 1) // 2
            if middle > good and len(build(pages[at:middle])) <= target:
                low = middle
            else:
                high = middle - 1
        out.append(pages[at : max(low, at + 1)])
        at = max(low, at + 1)
    return out


def outline(data: bytes) -> list[tuple[str, int]]:
    """(title, page index) of the first level of bookmarks, by page, the first title of each."""
    doc = Document(data)
    root = next((x for x in doc.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), {})
    index = {}
    for number, x in doc.objects.items():
        for k, p in enumerate(doc.pages):
            if isinstance(x, dict) and x.get("Type") == "Page" and all(p.get(key) == value for key, value in x.items()):
                index.setdefault(number, k)
    found: dict[int, str] = {}
    item, seen = doc.get((doc.get(root.get("Outlines")) or {}).get("First")), 0
    while isinstance(item, dict) and seen < 10_000:
        seen += 1
        target = doc.get(item.get("Dest")) or doc.get((doc.get(item.get("A")) or {}).get("D"))
        title = doc.get(item.get("Title")) or b""
        if isinstance(target, list) and target and isinstance(target[0], Ref) and target[0].number in index:
            found.setdefault(index[target[0].number], title[2:].decode("utf-16-be", "replace") if title.startswith(b"\xfe\xff") else title.decode("latin-1"))
        item = doc.get(item.get("Next"))
    return [(t, k) for k, t in sorted(found.items())]
