"""Pixels of the formats that need no outside codec: PNG, BMP and GIF, read into and written from RGBA arrays."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.functions.tree import FormatError
from tessera.sources.imagemeta import png as png_of

MOST_EDGE, MOST_PIXELS = 12_000, 64 << 20


def _checked(width: int, height: int) -> None:
    if not (1 <= width <= MOST_EDGE and 1 <= height <= MOST_EDGE and width * height <= MOST_PIXELS):
        raise FormatError(f"{width} by {height} pixels are out of range")


# -- PNG --------------------------------------------------------------------------------------------------------------


def read_png(data: bytes) -> np.ndarray:
    """Rows of RGBA; all colour types of up to 8 bits and of 16, which lose their low byte; not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise FormatError("no PNG")
    at, packed, palette, alpha, head = 8, [], b"", b"", None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if head is None:
        raise FormatError("the PNG has no header")
    width, height, depth, colour, _, _, interlaced = head
    _checked(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if interlaced or channels is None or depth not in (1, 2, 4, 8, 16):
        raise FormatError("this kind of PNG is not handled")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise FormatError(f"the PNG is damaged: {e}") from None
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    if len(raw) < (stride + 1) * height:
        raise FormatError("the PNG is cut off")
    rows = np.zeros((height, stride), dtype=np.uint8)
    before = np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        rows[y] = _unfiltered(kind, line, before, step)
        before = rows[y]
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        pixels = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :, None]
    else:
        pixels = rows.reshape(height, width, channels, depth // 8)[:, :, :, 0]
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    if colour == 3:
        table = np.full((256, 4), 255, dtype=np.uint8)
        table[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8, len(palette) // 3 * 3).reshape(-1, 3)
        table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)[:256]
        return table[pixels[:, :, 0]]
    grey = pixels[:, :, :1] * (255 // ((1 << depth) - 1) if depth < 8 else 1)
    out[:, :, :3] = grey if colour in (0, 4) else pixels[:, :, :3]
    if colour in (4, 6):
        out[:, :, 3] = pixels[:, :, -1]
    elif alpha and depth <= 8:
        clear = np.frombuffer(alpha, ">u2").astype(np.uint8)
        out[(pixels[:, :, : len(clear)] == clear).all(axis=2), 3] = 0
    return out


def _unfiltered(kind: int, line: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + before
    if kind == 1:
        padded = np.zeros(-(-len(line) // step) * step, dtype=np.uint8)
        padded[: len(line)] = line
        return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    out = [0] * (len(line) + step)
    for k, (x, up) in enumerate(zip(line.tolist(), before.tolist(), strict=True)):
        left = out[k]
        if kind == 3:
            out[k + step] = (x + (left + up) // 2) & 255
        elif kind == 4:
            corner = int(before[k - step]) if k >= step else 0
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            out[k + step] = (x + (left if a <= b and a <= c else up if b <= c else corner)) & 255
        else:
            raise FormatError("the PNG has an unknown filter")
    return np.array(out[step:], dtype=np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    return png_of(pixels.shape[1], pixels.shape[0], np.ascontiguousarray(pixels, dtype=np.uint8).tobytes())


# -- BMP --------------------------------------------------------------------------------------------------------------


def read_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise FormatError("no BMP")
    body, header, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    _checked(width, abs(height))
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise FormatError("this kind of BMP is not handled")
    stride, rows = (width * depth + 31) // 32 * 4, abs(height)
    if len(data) < body + stride * rows:
        raise FormatError("the BMP is cut off")
    raw = np.frombuffer(data, np.uint8, stride * rows, body).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    out = np.full((rows, width, 4), 255, dtype=np.uint8)
    if depth >= 24:
        cells = raw[:, : width * depth // 8].reshape(rows, width, depth // 8)
        out[:, :, :3] = cells[:, :, 2::-1]
        if depth == 32 and cells[:, :, 3].any():
            out[:, :, 3] = cells[:, :, 3]
        return out
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    table = np.zeros((1 << depth, 4), dtype=np.uint8)
    listed = np.frombuffer(data, np.uint8, 4 * min(colours, 1 << depth), 14 + header).reshape(-1, 4)
    table[: len(listed), :3], table[:, 3] = listed[:, 2::-1], 255
    bits = np.unpackbits(raw, axis=1)[:, : width * depth].reshape(rows, width, depth)
    return table[(bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)]


def write_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, upside down as usual; what is transparent becomes white."""
    height, width = pixels.shape[:2]
    part = pixels[:, :, 3:].astype(np.uint16)
    opaque = ((pixels[:, :, :3] * part + 255 * (255 - part) + 127) // 255).astype(np.uint8)
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, : width * 3] = opaque[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


# -- GIF --------------------------------------------------------------------------------------------------------------


def _unpack_lzw(data: bytes, bits: int, count: int) -> np.ndarray:
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, size, buffer, held, last = bytearray(), 0, 0, 0, b""
    for byte in data:
        buffer |= byte << held
        held += 8
        while held >= (size or bits + 1):
            width = size or bits + 1
            code = buffer & ((1 << width) - 1)
            buffer >>= width
            held -= width
            if code == clear or not table:
                table = [bytes([k]) for k in range(clear)] + [b"", b""]
                size, last = bits + 1, b""
                if code == clear:
                    continue
            if code == end:
                return np.frombuffer(bytes(out[:count]).ljust(count, b"\0"), np.uint8)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise FormatError("the GIF's codes are damaged")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = entry
            if len(out) >= count:
                return np.frombuffer(bytes(out[:count]), np.uint8)
    return np.frombuffer(bytes(out[:count]).ljust(count, b"\0"), np.uint8)


def _pack_lzw(indices: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    table = {bytes([k]): k for k in range(clear)}
    size, buffer, held, out = bits + 1, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer |= code << held
        held += size
        while held >= 8:
            out.append(buffer & 255)
            buffer >>= 8
            held -= 8

    put(clear)
    word, following = b"", end + 1
    for k in indices:
        longer = word + bytes([k])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following - 1 == 1 << size and size < 12:
            size += 1
        if following == 4096:
            put(clear)
            table = {bytes([k]): k for k in range(clear)}
            size, following = bits + 1, end + 1
        word = bytes([k])
    if word:
        put(table[word])
        if following == 1 << size and size < 12:
            size += 1
    put(end)
    if held:
        out.append(buffer & 255)
    return bytes(out)


def read_gif(data: bytes) -> list[tuple[np.ndarray, int]]:
    """Whole frames, each drawn over what stood before by its disposal, with their delays in milliseconds."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise FormatError("no GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    _checked(width, height)
    at, shared = 13, None
    if flags & 0x80:
        shared = np.frombuffer(data, np.uint8, 3 * (2 << (flags & 7)), at).reshape(-1, 3)
        at += shared.size
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    frames, delay, clear, disposal = [], 100, None, 0

    def blocks(at: int) -> tuple[bytes, int]:
        out = b""
        while at < len(data) and data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        return out, at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, clear, delay = body[0] >> 2 & 7, body[3] if body[0] & 1 else None, 10 * int.from_bytes(body[1:3], "little")
            at = after
        elif data[at] == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            table = shared
            if own & 0x80:
                table = np.frombuffer(data, np.uint8, 3 * (2 << (own & 7)), at).reshape(-1, 3)
                at += table.size
            bits = data[at]
            body, at = blocks(at + 1)
            if table is None or not 2 <= bits <= 8 or not w or not h:
                raise FormatError("a GIF frame is damaged")
            picture = _unpack_lzw(body, bits, w * h).reshape(h, w)
            if own & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(picture)
                straight[order] = picture
                picture = straight
            rgba = np.full((h, w, 4), 255, dtype=np.uint8)
            rgba[:, :, :3] = table[np.minimum(picture, len(table) - 1)]
            before = canvas.copy()
            part = canvas[top : top + h, left : left + w]
            seen = (picture != clear if clear is not None else np.ones((h, w), dtype=bool))[: part.shape[0], : part.shape[1]]
            part[seen] = rgba[: part.shape[0], : part.shape[1]][seen]
            frames.append((canvas.copy(), delay))
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            clear, disposal = None, 0
        else:
            raise FormatError("the GIF's blocks are damaged")
    if not frames:
        raise FormatError("the GIF has no frame")
    return frames


def _palette(pixels: np.ndarray, most: int = 255) -> tuple[np.ndarray, np.ndarray, bool]:
    """(colours, index of each opaque pixel, whether exact): all colours if they fit, else the median cut of their ranges."""
    packed = pixels.astype(np.uint32) @ np.array([1 << 16, 1 << 8, 1], dtype=np.uint32)
    found, at, count = np.unique(packed, return_inverse=True, return_counts=True)
    colours = np.stack([found >> 16, found >> 8 & 255, found & 255], axis=1).astype(np.int64)
    if len(found) <= most:
        return colours.astype(np.uint8), at, True
    boxes = [np.arange(len(found))]
    while len(boxes) < most:
        spread = [int(np.ptp(colours[b], axis=0).max()) if len(b) > 1 else -1 for b in boxes]
        k = int(np.argmax(spread))
        if spread[k] <= 0:
            break
        box = boxes.pop(k)
        box = box[np.argsort(colours[box, np.argmax(np.ptp(colours[box], axis=0))], kind="stable")]
        total = np.cumsum(count[box])
        cut = min(max(int(np.searchsorted(total, total[-1] / 2)), 1), len(box) - 1)
        boxes += [box[:cut], box[cut:]]
    owner = np.empty(len(found), dtype=np.int64)
    means = np.empty((len(boxes), 3))
    for k, box in enumerate(boxes):
        owner[box] = k
        means[k] = np.average(colours[box], axis=0, weights=count[box])
    return np.round(means).astype(np.uint8), owner[at], False


def write_gif(frames: list[tuple[np.ndarray, int]]) -> tuple[bytes, list[str]]:
    """Frames of one size, each with a palette of its own and one place for what is transparent."""
    height, width = frames[0][0].shape[:2]
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x70, 0, 0)]
    if len(frames) > 1:
        out.append(b"!\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    reduced = 0
    for pixels, delay in frames:
        opaque = pixels[:, :, 3] >= 128
        colours, index, exact = _palette(pixels[opaque][:, :3]) if opaque.any() else (np.zeros((1, 3), np.uint8), np.zeros(0, np.int64), True)
        reduced += not exact
        bits = max(2, int(len(colours)).bit_length())
        table = np.zeros((1 << bits, 3), dtype=np.uint8)
        table[: len(colours)] = colours
        clear = len(colours)
        picture = np.full((height, width), clear, dtype=np.uint8)
        picture[opaque] = index
        body = _pack_lzw(picture.tobytes(), bits)
        out += [b"!\xf9\x04" + struct.pack("<BHBB", 0x09, delay // 10, clear, 0), b"," + struct.pack("<HHHHB", 0, 0, width, height, 0x80 | (bits - 1)), table.tobytes(), bytes([bits])]
        out += [bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255)]
        out.append(b"\0")
    return b"".join(out) + b";", [f"COLOURS_REDUCED:{reduced}"] if reduced else []


# -- pictures of any of these -------------------------------------------------------------------------------------------


def read_picture(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return read_bmp(data)
    return read_gif(data)[0][0] if data[:3] == b"GIF" else read_png(data)


def write_picture(pixels: np.ndarray, kind: str) -> tuple[bytes, list[str]]:
    if kind == "gif":
        return write_gif([(pixels, 100)])
    if kind not in ("png", "bmp"):
        raise FormatError(f"no codec for {kind}")
    return (write_png(pixels), []) if kind == "png" else (write_bmp(pixels), ["TRANSPARENCY_LOST:1"] if (pixels[:, :, 3] < 255).any() else [])


def crop_box(width: int, height: int, rect: str = "", aspect: str = "") -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of `left,top,width,height` in pixels or per cent, or of the largest centred part of an aspect such as 16:9."""
    try:
        if rect.strip():
            parts = [p.strip() for p in rect.split(",")]
            if len({p.endswith("%") for p in parts}) != 1 or len(parts) != 4:
                raise FormatError("a rectangle has four numbers, all or none per cent")
            bases = (width, height, width, height)
            left, top, w, h = (int(float(p[:-1]) / 100 * b + 0.5) if p.endswith("%") else int(float(p) + 0.5) for p, b in zip(parts, bases, strict=True))
            if left < 0 or top < 0 or w < 1 or h < 1 or left >= width or top >= height:
                raise FormatError("the rectangle lies outside")
            return left, top, min(left + w, width), min(top + h, height)
        a, b = (int(x) for x in aspect.split(":"))
    except ValueError as e:
        raise FormatError(f"neither a rectangle nor an aspect: {e}") from None
    if a < 1 or b < 1:
        raise FormatError("an aspect has two positive numbers")
    scale = min(width / a, height / b)
    w, h = int(a * scale), int(b * scale)
    if not w or not h:
        raise FormatError("the picture is too small for this aspect")
    return (width - w) // 2, (height - h) // 2, (width - w) // 2 + w, (height - h) // 2 + h


def shrunk(pixels: np.ndarray, most_edge: int) -> np.ndarray:
    """Nearest-neighbour reduction to a longest edge; 0 keeps the size."""
    height, width = pixels.shape[:2]
    if not most_edge or max(width, height) <= most_edge:
        return pixels
    h, w = max(1, round(height * most_edge / max(width, height))), max(1, round(width * most_edge / max(width, height)))
    return pixels[(np.arange(h) * height // h)[:, None], np.arange(w) * width // w]
