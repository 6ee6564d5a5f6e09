"""Text subtitles out of Matroska files."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.functions.subtitles import Cue
from tessera.functions.tree import FormatError

_SEGMENT, _INFO, _SCALE, _TRACKS, _ENTRY, _NUMBER, _TYPE, _CODEC = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
_CLUSTER, _TIME, _SIMPLE, _GROUP, _BLOCK, _DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
_MASTERS = {_SEGMENT, _INFO, _TRACKS, _ENTRY, _CLUSTER, _GROUP}


def _number(data: bytes, at: int, keep_mark: bool) -> tuple[int, int]:
    """A variable-length number and the place behind it; unknown sizes are -1."""
    if at >= len(data) or not data[at]:
        raise FormatError("an element is damaged")
    n = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    if not keep_mark:
        value &= (1 << 7 * n) - 1
        value = -1 if value == (1 << 7 * n) - 1 else value
    return value, at + n


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        ident, at = _number(data, at, True)
        size, at = _number(data, at, False)
        stop = end if size < 0 else min(at + size, end)
        yield ident, at, stop
        at = stop


def read_subtitles(data: bytes, default_ms: int = 2000) -> list[Cue]:
    """Cues of the first text track: a cue ends after its own duration, else with the next one's start, else after the default."""
    if data[:4] != b"\x1aE\xdf\xa3":
        raise FormatError("no Matroska file")
    scale, tracks, found = 1_000_000, {}, []

    def walk(at: int, end: int, path: tuple[int, ...], state: dict) -> None:
        nonlocal scale
        for ident, a, b in _elements(data, at, end):
            if ident in _MASTERS:
                inner = state if ident != _GROUP and ident != _ENTRY else dict(state, duration=None, block=None)
                walk(a, b, (*path, ident), inner)
                if ident == _ENTRY and inner.get("type") == 17:
                    tracks[inner.get("number")] = inner.get("codec", "")
                if ident == _GROUP and inner.get("block"):
                    found.append((*inner["block"], inner["duration"]))
                continue
            value = int.from_bytes(data[a:b], "big") if b - a <= 8 else 0
            if ident == _SCALE:
                scale = value or scale
            elif ident in (_NUMBER, _TYPE):
                state["number" if ident == _NUMBER else "type"] = value
            elif ident == _CODEC:
                state["codec"] = data[a:b].decode("latin-1").rstrip("\0")
            elif ident == _TIME:
                state["time"] = value
            elif ident == _DURATION:
                state["duration"] = value
            elif ident in (_BLOCK, _SIMPLE):
                track, at_time = _number(data, a, False)
                block = (track, state.get("time", 0) + int.from_bytes(data[at_time : at_time + 2], "big", signed=True), data[at_time + 3 : b])
                if ident == _SIMPLE:
                    found.append((*block, None))
                else:
                    state["block"] = block

    walk(0, len(data), (), {})
    track = next((t for t, codec in tracks.items() if codec.startswith("S_TEXT/")), None)
    if track is None:
        raise FormatError("no text track")
    ms = [(round(t * scale / 1_000_000), body, d) for n, t, body, d in found if n == track]
    ms.sort(key=lambda x: x[0])
    out = []
    for k, (start, body, duration) in enumerate(ms):
        end = start + round(duration * scale / 1_000_000) if duration else ms[k + 1][0] if k + 1 < len(ms) else start + default_ms
        text = body.decode("utf-8", "replace")
        if "ASS" in tracks[track] or "SSA" in tracks[track]:
            text = text.split(",", 8)[-1].replace("\\N", "\n").replace("\\n", "\n")
        lines = tuple(x for x in text.replace("\r", "").strip("\n\0").split("\n"))
        if any(lines):
            out.append(Cue(start, max(end, start + 1), lines))
    if not out:
        raise FormatError("the track is empty")
    return out
