"""License scans against plain sets."""

import random
import re
import string

import pyarrow as pa

from tessera.llm import licences
from tests.llm.helpers import HARD, frame

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PROSE = ["Some prose of the author about the use of this work.", "It goes on, line by line, without any warranty that it ends.", "See the notes for more."]


def plain_words(text):
    lines = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", x.translate(_LOWER)) for x in (text or "").split("\n")]
    return [w for line in lines if not (line[:1] == ["copyright"] and (line[1:2] in (["c"], ["©"]) or "".join(line[1:2])[:1] in [*"0123456789"])) for w in line]


def dice_of(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0.0


def wrapped(text, width, rng):
    w = text.split()
    out, k = [], 0
    while k < len(w):
        n = rng.randint(3, width)
        out.append(" ".join(w[k : k + n]))
        k += n
    return "\n".join(out)


def test_windows_equal_brute_force():
    rng = random.Random(8)
    words = "the software is provided as is under no warranty of any kind mit license released".split()
    given = (("A", "released under the mit license"), ("B", "the software is provided as is without warranty of any kind"), ("C", " ".join(rng.choices(words, k=30))))
    table = licences.Templates(given, 0.8)
    sets = [set(zip(plain_words(t), plain_words(t)[1:])) for _, t in given]
    hits = 0
    for _ in range(400):
        parts = [rng.choice([given[rng.randrange(3)][1], " ".join(rng.choices(words, k=rng.randint(1, 12)))]).split() for _ in range(3)]
        w = [x for own in parts for x in own]
        for _ in range(rng.choice([0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        grams = list(zip(w, w[1:]))
        got = table.matches(*(lambda b: (b.hash, b.doc))(licences.Bigrams(pa.array([" ".join(w)]))))
        for _, t, a, b, dice in got:
            assert abs(dice - dice_of(set(grams[a : b + 1]), sets[t])) < 1e-12 and dice >= 0.8
        assert all(x[3] < y[2] for x, y in zip(sorted(got, key=lambda m: m[2]), sorted(got, key=lambda m: m[2])[1:]))
        for a in range(len(grams)):
            for t, own in enumerate(sets):
                for b in range(a + 1, min(len(grams), a + int(table.longest[t])) + 1):
                    if len(set(grams[a:b])) == b - a and dice_of(set(grams[a:b]), own) >= 0.8:
                        hits += 1
                        assert any(x[2] < b and a <= x[3] for x in got)  # a window without repeats that matches is found, or a better one that overlaps it
    assert hits > 300


def test_every_template_in_paragraphs_inside_a_longer_text(spark):
    rng = random.Random(5)
    known = licences.templates()
    texts, ends = [], []
    for k, (_, text) in enumerate(known):
        body = wrapped(text, 12, rng).split("\n")
        for _ in range(min(3, len(body) - 1)):  # blank lines between paragraphs
            body.insert(rng.randrange(1, len(body)), "")
        before = [rng.choice(PROSE) for _ in range(60)] + ["", "Copyright (c) 2020 Someone", ""]
        after = ([""] if k % 2 else []) + [rng.choice(PROSE) for _ in range(60)]
        texts.append("\n".join(before + body + after))
        ends.append((len(before), len(before) + len(body)))
    rows = sorted(licences.scan(frame(spark, texts)).collect())
    for (name, _), r, (first, last) in zip(known, rows, ends, strict=True):
        best = max(r.matches, key=lambda m: m.last_line - m.first_line + m.dice)
        assert best.license == name and best.dice > 0.95 and abs(best.first_line - first) <= 3 and abs(best.last_line - last) <= 3, (name, r.matches)


def test_notices_within_lines_and_hard_texts(spark):
    texts = [*HARD, "This tool was Released, under the (mit) LICENSE! and more words follow", "Copyright 2020 Me", "x\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.\n", *["Released under the MIT License. " * 3] * 2]
    rows = {r.doc_id: r.matches for r in licences.scan(frame(spark, texts, extra=True)).collect()}
    n = len(HARD)
    assert [[m.license for m in rows[k]] for k in range(n + 3)] == [[] for _ in HARD] + [["MIT"], [], ["CC-BY-NC-4.0", "CC-BY-4.0"]]
    assert rows[n + 3] == rows[n + 4] and [m.license for m in rows[n + 3]] == ["MIT"] * 3 and rows[n][0].dice == 1.0
    assert [(m.first_line, m.last_line) for m in rows[n + 2]] == [(1, 1), (2, 2)]


def test_empty_table(spark):
    assert licences.scan(frame(spark, [])).count() == 0


def test_every_template_matches_itself(spark):
    known = licences.templates()
    rows = licences.scan(frame(spark, [t for _, t in known])).collect()
    assert [max(r.matches, key=lambda m: m.last_line - m.first_line + m.dice).license for r in sorted(rows)] == [n for n, _ in known]
