"""7z and FLAC, against a small writer and a small reader."""

import bz2
import hashlib
import lzma
import struct
import zlib

import numpy as np
import pytest

from tessera.functions.tree import FormatError
from tessera.operators import audio
from tessera.operators.convert import KERNELS
from tessera.sources import flac, sevenzip


def number(n):
    if n < 0x80:
        return bytes([n])
    for more in range(1, 8):
        if n < 1 << (7 * (more + 1)):
            return bytes([(0xFF00 >> more) & 0xFF | n >> (8 * more)]) + (n & ((1 << 8 * more) - 1)).to_bytes(more, "little")
    return b"\xff" + n.to_bytes(8, "little")


def archive(files, method, encoded=False):
    body = b"".join(d for _, d in files if d)
    if method == "lzma2":
        packed, coder = lzma.compress(body, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]), b"\x21\x21\x01\x08"
    elif method == "lzma":
        packed, coder = lzma.compress(body, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}]), b"\x23\x03\x01\x01\x05" + bytes([93]) + struct.pack("<I", 1 << 16)
    elif method == "bzip2":
        packed, coder = bz2.compress(body), b"\x03\x04\x02\x02"
    elif method == "aes":
        packed, coder = body, b"\x24\x06\xf1\x07\x01\x02\x00\x00"
    else:
        packed, coder = body, b"\x01\x00"
    full = [d for _, d in files if d]
    streams = b"\x06" + number(0) + number(1) + b"\x09" + number(len(packed)) + b"\0"
    streams += b"\x07\x0b\x01\0\x01" + coder + b"\x0c" + number(len(body)) + b"\0"
    streams += b"\x08\x0d" + number(len(full)) + (b"\x09" + b"".join(number(len(d)) for d in full[:-1]) if len(full) > 1 else b"") + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(d)) for d in full) + b"\0\0"
    flags = "".join("1" if not d else "0" for _, d in files).ljust(-(-len(files) // 8) * 8, "0")
    empty = int(flags, 2).to_bytes(len(flags) // 8, "big")
    kinds = "".join("1" if d is not None else "0" for _, d in files if not d).ljust(8, "0")
    listed = number(len(files)) + b"\x0e" + number(len(empty)) + empty + b"\x0f\x01" + bytes([int(kinds, 2)])
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in files)
    head = b"\x01\x04" + streams + b"\x05" + listed + b"\x11" + number(len(names)) + names + b"\0\0"
    if encoded:
        small = lzma.compress(head, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}])
        outer = b"\x17\x06" + number(len(packed)) + b"\x01\x09" + number(len(small)) + b"\0\x07\x0b\x01\0\x01\x23\x03\x01\x01\x05" + bytes([93]) + struct.pack("<I", 1 << 16) + b"\x0c" + number(len(head)) + b"\x0a\x01" + struct.pack("<I", zlib.crc32(head)) + b"\0\0"
        packed, head = packed + small, outer
    start = struct.pack("<QQI", len(packed), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + packed + head


FILES = [("a.txt", b"hello " * 50), ("d", None), ("d/b.bin", bytes(range(256)) * 3), ("empty", b"")]


@pytest.mark.parametrize("method", ["copy", "lzma", "lzma2", "bzip2"])
@pytest.mark.parametrize("encoded", [False, True])
def test_7z(method, encoded):
    got = sevenzip.read_7z(archive(FILES, method, encoded))
    assert [(e.name, e.content, e.is_dir) for e in got] == [(n, d or b"", d is None) for n, d in FILES]


def test_7z_that_cannot_be_read():
    with pytest.raises(FormatError, match="nothing_usable|password"):
        sevenzip.read_7z(archive([("a", b"secret")], "aes"))
    good = archive(FILES, "lzma2")
    for bad in (b"", good[:20], good[:-3], good[:40] + b"x" + good[41:], good[:14] + b"\xff" + good[15:]):
        try:
            assert any(e.skip_reason for e in sevenzip.read_7z(bad))
        except FormatError:
            pass


def decode_flac(data):
    """Frames of constant, verbatim and fixed subframes."""
    assert data[:8] == b"fLaC\x80\0\0\x22"
    bits = "".join(format(b, "08b") for b in data[42:])
    info = int.from_bytes(data[18:26], "big")
    rate, channels, total = info >> 44, (info >> 41 & 7) + 1, info & ((1 << 36) - 1)
    at, out = 0, []

    def take(n, signed=False):
        nonlocal at
        value = int(bits[at : at + n], 2) if n else 0
        at += n
        return value - (1 << n) if signed and value >> (n - 1) else value

    while sum(map(len, out)) < total:
        first = at
        assert take(16) == 0xFFF8 and take(8) == 0x70
        assert take(4) == channels - 1 and take(4) == 8
        lead = take(8)
        at += 8 * max(0, 7 - (~lead & 0xFF).bit_length()) if lead >= 0x80 else 0
        n = take(16) + 1
        at += 8
        block = []
        for _ in range(channels):
            kind = take(8) >> 1
            if kind == 0:
                block.append([take(16, True)] * n)
            elif kind == 1:
                block.append([take(16, True) for _ in range(n)])
            else:
                order = kind & 7
                x = [take(16, True) for _ in range(order)]
                assert take(6) == 0
                k = take(4)
                for _ in range(n - order):
                    q = bits.index("1", at) - at
                    at += q + 1
                    f = q << k | take(k)
                    r = f >> 1 if f % 2 == 0 else -(f >> 1) - 1
                    x.append(r + [lambda x: 0, lambda x: x[-1], lambda x: 2 * x[-1] - x[-2], lambda x: 3 * x[-1] - 3 * x[-2] + x[-3], lambda x: 4 * x[-1] - 6 * x[-2] + 4 * x[-3] - x[-4]][order](x))
                block.append(x)
        at += -at % 8
        crc = 0
        for b in data[42 + first // 8 : 42 + at // 8 + 2]:
            crc = (crc << 8 & 0xFFFF) ^ flac._CRC16[crc >> 8 ^ b]
        assert crc == 0
        at += 16
        out.append(list(zip(*block, strict=True)))
    return rate, channels, np.array([s for b in out for f in b for s in f], dtype=np.int16)


def test_flac_is_lossless():
    rng = np.random.default_rng(3)
    wave = (8000 * np.sin(np.arange(9000) / 20)).astype(np.int16)
    for samples, channels in ((wave, 1), (rng.integers(-32768, 32768, 6000).astype(np.int16), 2), (np.zeros(100, np.int16), 1), (np.repeat(wave, 2), 2)):
        data = flac.write_flac(44100, channels, samples)
        rate, c, back = decode_flac(data)
        assert (rate, c) == (44100, channels) and np.array_equal(back, samples) and data[26:42] == hashlib.md5(samples.tobytes()).digest()
    assert len(flac.write_flac(44100, 1, wave)) < 0.6 * wave.nbytes
    made = KERNELS["convert_audio"](audio.write_wav(audio.Pcm(8000, 1, wave)), "a.wav", target="flac")[0][0][1]
    assert np.array_equal(decode_flac(made)[2], wave)
