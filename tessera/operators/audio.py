"""PCM audio: WAV read and written, trimmed, amplified, cleaned of noise, joined."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessera.functions.tree import FormatError


@dataclass
class Pcm:
    """16-bit samples, frame by frame."""

    rate: int
    channels: int
    samples: np.ndarray

    @property
    def frames(self) -> int:
        return len(self.samples) // self.channels


def read_wav(data: bytes) -> Pcm:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise FormatError("no WAV")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif kind == b"data":
            if at + 8 + n > len(data):
                raise FormatError("the samples are cut off")
            body = data[at + 8 : at + 8 + n]
            break
        at += 8 + n + n % 2
    if form is None or body is None:
        raise FormatError("a chunk is missing")
    coding, channels, rate, _, _, bits = form
    if coding != 1 or bits != 16 or not 1 <= channels <= 8 or len(body) % (2 * channels):
        raise FormatError("only whole frames of 16-bit PCM are handled")
    return Pcm(rate, channels, np.frombuffer(body, "<i2"))


def write_wav(p: Pcm) -> bytes:
    body = p.samples.astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, p.channels, p.rate, p.rate * p.channels * 2, p.channels * 2, 16, b"data", len(body)) + body


def gain(p: Pcm, percent: int) -> Pcm:
    if not 0 <= percent <= 400:
        raise FormatError("the volume must be 0 to 400 %")
    loud = np.floor(p.samples.astype(np.float64) * (percent / 100.0) + 0.5)
    return Pcm(p.rate, p.channels, np.clip(loud, -32768, 32767).astype(np.int16))


def denoise(p: Pcm, level: int) -> Pcm:
    """y[n] = x[n] - x[n-1] + y[n-1] * 995 / 1000 in whole numbers cut towards zero, for each channel; then silence below a threshold."""
    threshold = {1: 200, 2: 500, 3: 1000}.get(level)
    if threshold is None:
        raise FormatError("the level is 1, 2 or 3")
    out = np.empty(len(p.samples), dtype=np.int64)
    for c in range(p.channels):
        x_before = y = 0
        own = []
        for x in p.samples[c :: p.channels].tolist():
            y = x - x_before + (y * 995 // 1000 if y >= 0 else -(-y * 995 // 1000))
            x_before = x
            own.append(y)
        out[c :: p.channels] = own
    out[np.abs(out) < threshold] = 0
    return Pcm(p.rate, p.channels, np.clip(out, -32768, 32767).astype(np.int16))


def trim(p: Pcm, ranges: list[tuple[float, float | None]]) -> Pcm:
    """The frames within ranges of seconds, one range after the other."""
    pieces = [p.samples[int(a * p.rate) * p.channels : None if b is None else int(b * p.rate) * p.channels] for a, b in ranges]
    if not pieces or not sum(map(len, pieces)):
        raise FormatError("nothing lies in the ranges")
    return Pcm(p.rate, p.channels, np.concatenate(pieces))


def join(parts: list[Pcm]) -> Pcm:
    if len({(p.rate, p.channels) for p in parts}) != 1:
        raise FormatError("the rates or channels differ")
    return Pcm(parts[0].rate, parts[0].channels, np.concatenate([p.samples for p in parts]))
