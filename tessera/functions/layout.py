"""Lines of text by an estimated width: an em for characters from U+2E80 on, 0.55 for others."""

from __future__ import annotations

import re

#: Marks that no line may begin with, and ones that no line may end with (fixed values).
NOT_FIRST = set("，。、；：？！）》」』】〕…—,.;:?!)]}%’”")
NOT_LAST = set("（《「『【〔([{‘“")


def width_of(text: str) -> float:
    return sum(1.0 if c >= "⺀" else 0.55 for c in text)


def wrap(text: str, room: float) -> list[str]:
    """Lines of up to `room` ems: words stay whole where they fit, wide characters break anywhere but before closing and after opening marks."""
    out = []
    for paragraph in text.split("\n"):
        pieces = re.findall(r"[⺀-\U0010ffff]|[^\s⺀-\U0010ffff]+|\s+", paragraph)
        line = ""
        k = 0
        while k < len(pieces):
            p = pieces[k]
            if width_of(line + p.rstrip()) <= room or (line and p in NOT_FIRST):
                line += p
                k += 1
            elif not line.strip():  # a word wider than the line is cut
                n = max(1, int(room / 0.55 if p[0] < "⺀" else room))
                out.append(p[:n])
                line = ""
                pieces[k] = p[n:]
                k += not p[n:]
            else:
                kept = line.rstrip()
                carried = ""
                while kept and kept[-1] in NOT_LAST and len(kept) > 1:
                    kept, carried = kept[:-1], kept[-1] + carried
                out.append(kept)
                line = carried
                k += p.isspace()
        out.append(line.rstrip())
    return out
