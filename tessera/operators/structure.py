"""Rows, columns, tables, headings and paragraphs out of positioned text."""

from __future__ import annotations

import re
from statistics import median

from tessera.functions.docparts import Para, Part, Run

Word = tuple[str, float, float, float, float]  # text, left, right, top, bottom


def text_rows(words: list[Word]) -> list[list[Word]]:
    """Words by row: one joins the row whose first word's top differs by less than half of the usual height."""
    if not words:
        return []
    height = median(w[4] - w[3] for w in words)
    rows: list[list[Word]] = []
    for w in sorted(words, key=lambda w: (w[3], w[1])):
        if rows and abs(w[3] - rows[-1][0][3]) < height / 2:
            rows[-1].append(w)
        else:
            rows.append([w])
    return [sorted(r, key=lambda w: w[1]) for r in rows]


def cells_of(row: list[Word], gap: float) -> list[tuple[float, float, str]]:
    """(left, right, text): words nearer than `gap` are one cell."""
    out: list[list] = []
    for text, left, right, *_ in row:
        if out and left - out[-1][1] < gap:
            out[-1][1], out[-1][2] = max(right, out[-1][1]), f"{out[-1][2]} {text}"
        else:
            out.append([left, right, text])
    return [tuple(c) for c in out]


def page_tables(words: list[Word]) -> list[list[list[str]]]:
    """Runs of two rows or more with two cells or more, their columns by where the cells begin."""
    rows = text_rows(words)
    if not rows:
        return []
    height = median(w[4] - w[3] for w in words)
    split = [cells_of(r, 1.2 * height) for r in rows]
    runs: list[list[list[tuple[float, float, str]]]] = [[]]
    for cells in split:
        if len(cells) >= 2:
            runs[-1].append(cells)
        elif runs[-1]:
            runs.append([])
    out = []
    for run in runs:
        if len(run) < 2:
            continue
        starts: list[list[float]] = []  # running averages of the columns' beginnings
        for left in sorted(c[0] for cells in run for c in cells):
            if starts and left - starts[-1][0] / starts[-1][1] < 1.5 * height:
                starts[-1][0] += left
                starts[-1][1] += 1
            else:
                starts.append([left, 1.0])
        columns = [total / n for total, n in starts]
        table = []
        for cells in run:
            row = [""] * len(columns)
            for left, _, text in cells:
                k = min(range(len(columns)), key=lambda k: abs(columns[k] - left))
                row[k] = f"{row[k]} {text}".strip()
            table.append(row)
        if len(columns) >= 2:
            out.append(table)
    return out


_BULLET = re.compile(r"^\s*[•◦▪‣·●○–-]\s+")
_NUMBER = re.compile(r"^\s*(\d{1,3})[.)]\s+")


def lines_to_parts(lines: list[dict]) -> list[Part]:
    """Headings by size over the body's, which is the size of most characters; paragraphs from lines of even spacing; lists by
    their marks. Heads and feet that repeat on 60 % of the pages, three at least, are left out."""
    if not lines:
        return []
    pages = {r["page"] for r in lines}
    seen: dict[str, set] = {}
    for r in lines:
        seen.setdefault(re.sub(r"\d", "#", r["text"].strip()), set()).add(r["page"])
    running = {k for k, on in seen.items() if len(on) >= max(3, -(-len(pages) * 6 // 10))}
    kept = [r for r in sorted(lines, key=lambda r: (r["page"], r["top"], r["left"])) if re.sub(r"\d", "#", r["text"].strip()) not in running and r["text"].strip()]
    weights: dict[float, int] = {}
    for r in kept:
        weights[r["size"]] = weights.get(r["size"], 0) + len(r["text"])
    if not kept:
        return []
    body = max(weights, key=lambda s: (weights[s], -s))
    larger = sorted({r["size"] for r in kept if r["size"] > 1.15 * body}, reverse=True)[:6]
    out: list[Part] = []
    before = None
    for r in kept:
        text = r["text"].strip()
        style = f"h{larger.index(r['size']) + 1}" if r["size"] in larger else "body"
        bullet = True if _NUMBER.match(text) else False if _BULLET.match(text) else None
        near = before is not None and before["page"] == r["page"] and r["top"] - before["top"] < 1.6 * max(r["height"], before["height"])
        if out and near and style == out[-1].style and bullet is None and (style != "body" or before["right"] > 0.8 * max(x["right"] for x in kept)):
            last = out[-1].runs[-1].text
            joint = last[:-1] + text if last.endswith("-") and text[:1].islower() else f"{last} {text}"
            out[-1].runs[-1] = Run(joint, bold=out[-1].runs[-1].bold)
        else:
            clean = _NUMBER.sub("", text) if bullet else _BULLET.sub("", text) if bullet is False else text
            out.append(Para([Run(clean, bold=bool(r["bold"]) and style == "body")], style, 0, bullet))
        before = r
    return out
