"""Subtitle text in four formats, read into cues and written from them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.functions.tree import FormatError


@dataclass(frozen=True)
class Cue:
    """Shown from start_ms up to, not including, end_ms."""

    start_ms: int
    end_ms: int
    lines: tuple[str, ...]


_CLOCK = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,:](\d{1,3}))?")


def read_clock(text: str, centiseconds: bool = False) -> int:
    """Milliseconds of h:m:s.fff or m:s.fff. Digits behind the point are a decimal fraction; in ASS they count hundredths."""
    m = _CLOCK.fullmatch(text.strip())
    if not m:
        raise FormatError(f"{text.strip()} is no time")
    part = m[4] or ""
    ms = int(part) * 10 if centiseconds and len(part) < 3 and part else int(part.ljust(3, "0")) if part else 0
    return ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + ms


def _clock(ms: int, mark: str, hours: bool = True) -> str:
    h, m, s, f = ms // 3_600_000, ms // 60_000 % 60, ms // 1000 % 60, ms % 1000
    return f"{h:02d}:{m:02d}:{s:02d}{mark}{f:03d}" if hours else f"{h * 60 + m:02d}:{s:02d}{mark}{f // 10:02d}"


def detect_format(text: str) -> str:
    head = text.removeprefix("﻿").lstrip()
    if head.startswith("WEBVTT"):
        return "vtt"
    if re.search(r"(?mi)^\[(script info|events|v4\+? styles)\]", head):
        return "ass"
    if re.search(r"(?m)^\s*(\d+:)?\d+:\d+[,.:]?\d*\s*-->", head):
        return "srt"
    if re.search(r"(?m)^(\[\w+:[^\]]*\])*\[\d+:\d+(?:[.:]\d+)?\]", head):
        return "lrc"
    raise FormatError("no subtitle format is recognised")


def _blocks(text: str) -> list[Cue]:
    """SRT and WebVTT: a line with an arrow, and the lines from there to a blank one."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text):
        lines = block.strip("\n").split("\n")
        at = next((k for k, x in enumerate(lines) if "-->" in x), None)
        if at is None or lines[0].startswith(("NOTE", "STYLE", "REGION")):
            continue
        first, _, rest = lines[at].partition("-->")
        out.append(Cue(read_clock(first), read_clock(rest.split()[0] if rest.split() else ""), tuple(lines[at + 1 :])))
    return out


def _ass(text: str) -> list[Cue]:
    out, section, fields = [], "", ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("["):
            section = line.lower()
        elif section == "[events]" and line.lower().startswith("format:"):
            fields = [x.strip().lower() for x in line[7:].split(",")]
        elif section == "[events]" and line.lower().startswith("dialogue:"):
            row = dict(zip(fields, line[9:].split(",", len(fields) - 1), strict=False))
            if not {"start", "end", "text"} <= set(row):
                raise FormatError("an event lacks its start, end or text")
            shown = re.sub(r"\{[^}]*\}", "", row["text"]).replace("\\h", " ")
            out.append(Cue(read_clock(row["start"], True), read_clock(row["end"], True), tuple(re.split(r"\\[Nn]", shown))))
    return out


def _lrc(text: str, last_ms: int) -> list[Cue]:
    offset = int(m[1]) if (m := re.search(r"(?mi)^\[offset:\s*([-+]?\d+)\s*\]", text)) else 0
    found: list[tuple[int, str]] = []
    for line in text.split("\n"):
        stamps = re.match(r"((?:\[\d+:\d+(?:[.:]\d+)?\])+)(.*)", line.strip())
        if stamps:
            found += [(max(0, read_clock(x) - offset), stamps[2].strip()) for x in re.findall(r"\[(\d+:\d+(?:[.:]\d+)?)\]", stamps[1])]
    found.sort(key=lambda x: x[0])
    ends = [*(s for s, _ in found[1:]), found[-1][0] + last_ms if found else 0]
    return [Cue(s, e, (t,)) for (s, t), e in zip(found, ends, strict=True) if t]


def parse_cues(text: str, kind: str | None = None) -> list[Cue]:
    kind = kind or detect_format(text)
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    cues = _ass(text) if kind == "ass" else _lrc(text, 5000) if kind == "lrc" else _blocks(text)
    if not cues:
        raise FormatError("no cue is found")
    return cues


def render_cues(cues: list[Cue], kind: str) -> str:
    cues = sorted(cues, key=lambda c: (c.start_ms, c.end_ms))
    if kind == "srt":
        return "".join(f"{k}\n{_clock(c.start_ms, ',')} --> {_clock(c.end_ms, ',')}\n" + "\n".join(c.lines) + "\n\n" for k, c in enumerate(cues, 1))
    if kind == "vtt":
        return "WEBVTT\n\n" + "".join(f"{_clock(c.start_ms, '.')} --> {_clock(c.end_ms, '.')}\n" + "\n".join(c.lines) + "\n\n" for c in cues)
    if kind == "lrc":
        return "".join(f"[{_clock(c.start_ms, '.', False)}]{' '.join(c.lines)}\n" for c in cues)
    if kind == "ass":
        def stamp(ms: int) -> str:
            return f"{ms // 3_600_000}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000 // 10:02d}"

        head = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default,Arial,48\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
        return head + "".join(f"Dialogue: 0,{stamp(c.start_ms)},{stamp(c.end_ms)},Default,,0,0,0,," + "\\N".join(c.lines) + "\n" for c in cues)
    raise FormatError(f"no subtitle format {kind}")


def cue_notes(cues: list[Cue], target: str) -> list[str]:
    """Codes with counts: what is odd about the cues, and what the target format can't hold."""
    ordered = list(zip(cues, cues[1:], strict=False))
    counts = {
        "REVERSED": sum(c.end_ms < c.start_ms for c in cues), "EMPTY": sum(c.end_ms == c.start_ms for c in cues),
        "OVERLAPPING": sum(b.start_ms < a.end_ms for a, b in ordered),
        "END_LOST": len(cues) * (target == "lrc"), "LINES_JOINED": sum(len(c.lines) > 1 for c in cues) * (target == "lrc"),
        "RESOLUTION_LOST": sum(any(x % 10 for x in (c.start_ms, c.end_ms)) for c in cues) * (target in ("lrc", "ass")),
    }
    return [f"{k}:{n}" for k, n in counts.items() if n]


def cue_at(cues: list[Cue], ms: int) -> Cue | None:
    """The cue shown at a time; of several the one that starts last."""
    return max((c for c in cues if c.start_ms <= ms < c.end_ms), key=lambda c: c.start_ms, default=None)
