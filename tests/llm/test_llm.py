"""The other operators against brute force, on hard small tables and on the driver's smallest."""

import gzip
import hashlib
import io
import math
import os
import random
import re
import struct
import wave
import zipfile
import zlib
from collections import Counter
from unittest.mock import MagicMock

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import eliasfano, graph, jaccard, language, linededup, lm, media, registry, store, topk, urlfilter
from tests.llm.helpers import HARD, frame, words


# -- media --------------------------------------------------------------------------------------------------------------


def png():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.png", png())
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
MIDI = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 4) + b"\0\xff\x2f\0"
AU = b".snd" + struct.pack(">IIIII", 24, 4, 2, 8000, 1) + b"abcd"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00?\x00\x12\x34\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF\n"


@pytest.mark.parametrize("kind, body", [("png", png()), ("gif", GIF), ("bmp", BMP), ("midi", MIDI), ("au", AU), ("jpeg", JPEG), ("pdf", PDF), ("zip", zipped()), ("gzip", gzip.compress(b"hello", mtime=0)), ("wav", media.store_wav(b"abcd"))])
def test_formats_are_found_whole_and_carved(kind, body):
    assert [(f, s, n) for f, s, n, *_ in media.sniff(body)][0] == (kind, 0, len(body))
    inside = [(f, s, n) for f, s, n, *_ in media.sniff(b"junk BM RIFF GIF89a " + body + b" tail")]
    assert (kind, 20, len(body)) in inside
    for cut in range(1, len(body)):
        found = media.sniff(body[: len(body) - cut])
        assert not any(f == kind and s == 0 and n >= len(body) for f, s, n, *_ in found)


def test_embedded_and_declared_types(spark):
    rows = [(1, b"x" + png() + b"y" + GIF, "image/png"), (2, png(), "image/gif"), (3, None, None), (4, b"", "text/plain"), (5, zipped(), None), (6, png(), "image/png")]
    frame_ = spark.createDataFrame([(*r, "clash") for r in rows], "id long, content binary, declared string, media string")
    out = {r.id: r for r in media.sniff_media(frame_, "content", "declared").collect()}
    assert [e.format for e in out[1].embedded] == ["png", "gif"] and out[1].sniffed_format is None and out[1].embedded[0].offset == 1
    assert out[2].sniffed_mime == "image/png" and out[2].type_corrected and not out[6].type_corrected
    assert out[3].embedded is None and out[4].embedded == [] and [e.format for e in out[5].embedded] == ["png"]


def test_op1_stores_losslessly(spark):
    docs = frame(spark, HARD, extra=True)
    rows = media.read_back(media.sniff_media(media.store_texts(docs), "content", "declared_type")).collect()
    assert len(rows) == len(HARD)
    for r in rows:
        raw = (HARD[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.store_wav(payload)
        with wave.open(io.BytesIO(stored)) as w:
            assert w.getsampwidth() == 1 and w.readframes(len(payload)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert f"n={len(payload)} sum={sum(payload)} " in r.feature


# -- Jaccard join -------------------------------------------------------------------------------------------------------


def shingles(text, size=5):
    w = words(text)
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def by_brute_force(texts):
    sets = [shingles(x) for x in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 90))) for _ in range(12)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = [*HARD, "a b c d", "A B C D"]
    for _ in range(180):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += passage.split()
        out.append((" " if rng.random() < 0.5 else "\n").join(w))
    return out + out[-40:]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 8])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus()
    rows = jaccard.near_duplicates(frame(spark, texts, extra=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == by_brute_force(texts)


def test_jaccard_of_empty_and_repeated(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    text = "one two three four five six"
    rows = jaccard.near_duplicates(frame(spark, [text, text, None], ids=[7, 7, 8])).distinct().collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(7, 2, 7), (8, 0, 8)]


def test_union_find(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(400)] + [(k, k + 1) for k in range(1000, 1400)]
    monkeypatch.setattr(graph, "LAST_LEVEL", 20)
    monkeypatch.setattr(graph, "MOST_NODES", 50)
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    a, b = map(np.array, zip(*edges, strict=True))
    assert got == dict(zip(*(x.tolist() for x in graph.local_components(a, b)), strict=True))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- line dedup ---------------------------------------------------------------------------------------------------------


def kept_by_brute_force(texts):
    root, first, sets, order = [], {}, [], []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    numbers = {}
    for doc, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(linededup._SPACES):
                if line not in numbers:
                    numbers[line] = len(root)
                    root.append(len(root))
                    sets.append({line[j : j + 8] for j in range(max(1, len(line) - 7))})
                order.append((doc, k, numbers[line]))
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    gone = {}
    for doc, k, n in order:
        if find(n) in first:
            gone.setdefault(doc, set()).add(k)
        else:
            first[find(n)] = (doc, k)
    return gone


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choices("abcdefgh  é日", k=rng.choice([3, 8, 9, 40, 200]))) for _ in range(40)]
    texts = list(HARD)
    for _ in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(lines)
            if rng.random() < 0.3 and len(line) > 100:
                at = rng.randrange(len(line))
                line = line[:at] + "X" + line[at + 1 :]
            own.append(rng.choice([line, line, "", "  "]))
        texts.append("\n".join(own))
    docs = frame(spark, texts, extra=True)
    want = kept_by_brute_force(texts)
    got = {r.doc_id: set(r.lines) for r in linededup.dropped_lines(docs).collect()}
    assert got == want
    rows = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    for k, text in enumerate(texts):
        kept = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in want.get(k, ()))
        assert rows[k].text == kept and rows[k].n_dropped == len(want.get(k, ())) and rows[k].side == "x"


def test_lines_of_empty_and_repeated(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    rows = linededup.dedup_lines(frame(spark, ["one line", "one line"], ids=[4, 4])).collect()
    assert [r.text for r in rows] == ["one line"] * 2


def test_lines_of_one_template_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz "
    template = "".join(rng.choices(letters, k=200))
    texts = [template + "".join(rng.choices(letters, k=34)) for _ in range(120)]  # below 0.8 to one another
    texts += [x[:-20] + "".join(rng.choices(letters, k=20)) for x in texts[:40]]  # just above it to one each
    got = {r.doc_id: set(r.lines) for r in linededup.dropped_lines(frame(spark, texts)).collect()}
    assert got == kept_by_brute_force(texts) and len(got) == 40


def test_lines_that_chance_matches_chain_meet_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(linededup, "WHOLE", 16, raising=False)
    dealt, write = [], store.materialise

    def written(frame, name, sweep=False):
        out = write(frame, name, sweep)
        dealt.extend([out.count()] if name == "dealt" else [])
        return out

    monkeypatch.setattr(store, "materialise", written)
    rng = random.Random(3)
    ring = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=24 * 300)) * 2
    texts = [ring[k : k + 200] for k in range(0, 24 * 300, 24)]  # 0.78 to the next one: they share buckets and don't link
    texts += [x[:-10] + "".join(rng.choices("0123456789", k=10)) for x in texts[::15]]  # 0.9 to one each
    got = {r.doc_id: set(r.lines) for r in linededup.dropped_lines(frame(spark, texts)).collect()}
    assert got == kept_by_brute_force(texts) and len(got) == 20
    assert sum(dealt) < 16 * len(texts)  # a component of all lines would be copied 40 times


def test_lines_of_a_shared_block_meet_in_their_components(monkeypatch):
    texts = MagicMock()
    linededup._block_links(MagicMock(), MagicMock(), texts)
    product = texts.select().dropDuplicates().join().join().groupBy().applyInArrow.call_args.args[0]
    work, overlaps = [], jaccard.overlaps

    def counted(left, right):
        work.append(len(left) * len(right))
        return overlaps(left, right)

    monkeypatch.setattr(jaccard, "overlaps", counted)
    monkeypatch.setattr(linededup, "_PAIRS", 50, raising=False)
    rng = random.Random(5)
    rows = []  # root, group, text
    for root, size in enumerate([2] * 100 + [7] * 10 + [32, 33, 60]):
        base = "".join(rng.choices("abcdefghij é", k=60))
        for _ in range(size):
            cut = rng.choice([0, 0, 3, 6, 12, 59])
            rows.append((root, rng.randrange(3) * 1000 + root if size > 3 else len(rows), base[: 60 - cut] + "".join(rng.choices("0123456789", k=cut))))
    rng.shuffle(rows)
    rows += rows[:20]  # a line may come from several buckets
    number = {x: k for k, x in enumerate(dict.fromkeys(rows))}
    ids = [number[x] for x in rows]
    table = pa.table({"id": pa.array(ids), "side": pa.array([0] * len(rows), pa.int32()), "text": [x[2] for x in rows], "group": [x[1] for x in rows], "root": [x[0] for x in rows]})
    found = product(table)
    sets = {number[x]: {x[2][k : k + 8] for k in range(max(1, len(x[2]) - 7))} for x in rows}
    of = {number[x]: x for x in rows}
    same = [(a, b) for a in sets for b in sets if a < b and of[a][0] == of[b][0]]
    links = [(a, b) for a, b in same if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    joined = [(a, b) for a, b in same if of[a][1] == of[b][1]]
    given = list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    roots = [dict(zip(*(v.tolist() for v in graph.local_components(*np.array(pairs + joined + [(k, k) for k in sets]).T)), strict=True)) for pairs in (given, links)]
    assert roots[0] == roots[1] and len(set(roots[0].values())) < len(sets)
    assert sum(work) < 2 * 60 * 60  # all lines of the block would be more than 400 * 400 pairs


def test_lines_of_rows_that_share_an_id(spark):
    texts, ids = ["a\nx", "b\na", "c\na\nb", None, "p\nq", "r\np", "p\nq"], [None, None, None, None, 7, 7, 7]
    rows = [(r.doc_id, *(r.text or "").split("\n"), r.n_dropped) for r in linededup.dedup_lines(frame(spark, texts, ids=ids)).collect()]
    kept = {k: sorted(x for own in {r[:-1] for r in rows if r[0] == k} for x in own[1:] if x) for k in (None, 7)}
    assert kept == {None: ["a", "b", "c", "x"], 7: ["p", "q", "r"]} and sum(r[-1] for r in rows if r[0] is None) == 3
    assert len(rows) == 7 and len([r for r in rows if r[0] == 7 and "q" in r]) == 2


def test_bands_find_near_lines():
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        core, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (200, 25, 25))
        hashes = np.concatenate([core, a, core, b])
        keys = linededup.band_keys(hashes, np.repeat([0, 1], [225, 225]), 2)
        hits += bool((keys[0] == keys[1]).any())
    assert hits >= 285  # similarity 0.8


# -- URL filter ---------------------------------------------------------------------------------------------------------

URLS = [
    "https://a.example.com/en/7x?q", "http://example.com/en/1", "HTTP://WWW.Casino-Win.Example.COM/x", "https://x.net/de/8", "https://b.example.net/de/8#f", "ftp://o.org/es/a?b", "no scheme", None, "://", "http://", "http://free-bets.org?x=://y",
    "http://user@host:80/p", "https://İ.net/de/", "http://a.b\n/x", "http://notexample.com/en/7", "https://spam-farm.com/fr/",
]


def test_verdicts_equal_sql(spark):
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string, html string, rule string")
    got = sorted(map(tuple, urlfilter.judge(pages, urlfilter.has_label(urlfilter.LISTED_LABELS)).collect()))
    table = pa.table({"page_id": pa.array(range(len(URLS) + 3), pa.int64()), "url": pa.array(URLS + URLS[:3])})
    con = duckdb.connect()
    con.register("pages", table)
    assert got == sorted(con.sql(urlfilter.OP5_SQL).fetchall())
    joined = urlfilter.judge(pages, urlfilter.has_label(urlfilter.LISTED_LABELS), most_bits=1)
    assert sorted(map(tuple, joined.collect())) == got
    assert urlfilter.judge(pages.limit(0), urlfilter.has_label(urlfilter.LISTED_LABELS)).count() == 0


def test_cascade_is_exact_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(urlfilter, "HASHES", 2)
    universe = spark.range(3000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    levels = urlfilter.build_cascade(universe)
    assert len(levels) > 3
    assert universe.where(urlfilter.listed_by(levels, F.col("key")) != F.col("listed")).count() == 0
    assert urlfilter.build_cascade(universe.where("not listed")) == []


# -- top-k --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale_of_values, sizes", [(1.0, (8192, 512)), (1.0, (16, 4)), (1e6, (64, 8))])
def test_top_k_equals_brute_force(spark, monkeypatch, scale_of_values, sizes):
    monkeypatch.setattr(topk, "GROUP", sizes[0])
    monkeypatch.setattr(topk, "BLOCK", sizes[1])
    monkeypatch.setattr(topk, "FAN", 3)
    rng = np.random.default_rng(2)
    vectors = {k: np.round(rng.normal(size=6) * scale_of_values, 1).tolist() for k in range(150)}
    vectors |= {200 + k: vectors[3] for k in range(30)}
    rows = [(k, v, "x") for k, v in vectors.items()] + [(3, vectors[3], "x"), (500, None, "x"), (520, [1.0, None], "x"), (540, [float("nan")] * 6, "x"), (560, [math.inf] * 6, "x"), (None, [1.0] * 6, "x"), (580, [], "x"), (600, [1.0, 2.0], "x")]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 20 == 0, k=7)
    sound = vectors | {580: [], 600: [1.0, 2.0]}
    whole = {k: [math.floor(64 * x) for x in v] for k, v in sound.items()}
    want = []
    for q in sorted(k for k in whole if k % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), k) for k, v in whole.items() if k != q)[:7]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_broadcasts_nothing_that_grows(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 16)
    monkeypatch.setattr(topk, "BLOCK", 2)
    plans, write = [], store.materialise

    def written(frame, name, sweep=False):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write(frame, name, sweep)

    monkeypatch.setattr(store, "materialise", written)
    rng = random.Random(5)
    vectors = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(400)], "vec_id long, embedding array<float>")
    out = topk.top_k(vectors, F.col("vec_id") % 20 == 0)
    assert not [x for x in [*plans, out._jdf.queryExecution().executedPlan().toString()] if "Broadcast" in x]
    assert out.count() == 400


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 128)]


# -- language model -----------------------------------------------------------------------------------------------------


def test_scores_equal_a_plain_model(spark):
    texts = corpus(9)
    docs = frame(spark, texts, extra=True)
    rows = {r.doc_id: r for r in lm.score_documents(docs, F.col("doc_id") % 5 == 0).collect()}
    tokens = {k: [*words(x), "</s>"] for k, x in enumerate(texts)}
    c, b = Counter(), Counter()
    for k, t in tokens.items():
        if k % 5:
            c.update(t)
            b.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    for k, t in tokens.items():
        base = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        p = [(b[x, w] + lm.PRIOR * q) / ((c["</s>"] if x == "<s>" else c[x]) + lm.PRIOR) for x, w, q in zip(["<s>", *t[:-1]], t, base, strict=True)]
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k % 5 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(map(math.log10, base)), rel_tol=1e-9)
        assert abs(r.score - sum(map(math.log10, p))) <= 0.06 * len(t)


def test_lm_of_empty_tables(spark):
    assert lm.score_documents(frame(spark, []), F.lit(False)).count() == 0
    r = lm.score_documents(frame(spark, ["a b"]), F.lit(True)).first()
    assert r.train_tokens == 0 and math.isfinite(r.base_score) and r.n_known == 0


def test_elias_fano():
    rng = np.random.default_rng(4)
    for universe in (1, 10, 1 << 20, 1 << 50):
        for n in (0, 1, 5, 3000):
            values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
            ef = eliasfano.EliasFano(memoryview(eliasfano.EliasFano.encode(values, universe)))
            assert np.array_equal(ef.at(np.arange(n)), values)
            ask = rng.integers(0, universe, 500, dtype=np.uint64)
            found = ef.successor(ask, np.zeros(500, np.int64), np.full(500, n))
            assert np.array_equal(found, np.searchsorted(values, ask))


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64) & np.uint64(0x0000FF00FFFF))
    values = rng.integers(1, 256, len(keys)).astype(np.uint8)
    trie = eliasfano.TriePart.mapped(eliasfano.TriePart.build(keys >> np.uint64(24), keys & np.uint64(0xFFFFFF), values))
    assert np.array_equal(trie.find(keys >> np.uint64(24), keys & np.uint64(0xFFFFFF)), values)
    other = np.setdiff1d(keys + np.uint64(1), keys)
    assert not trie.find(other >> np.uint64(24), other & np.uint64(0xFFFFFF)).any()
    empty = np.zeros(0, np.uint64)
    assert not eliasfano.TriePart.mapped(eliasfano.TriePart.build(empty, empty, np.zeros(0, np.uint8))).find(keys >> np.uint64(24), keys & np.uint64(0xFFFFFF)).any()


# -- language ID --------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba"]
    model = language.Model(["x"], pieces, np.array([[0.1], [0.2], [0.3], [0.15], [0.2], [0.05]]))
    p = dict(zip(pieces, model.probability[:, 0], strict=True))

    def total(text):
        return 1.0 if not text else sum(p[x] * total(text[len(x) :]) for x in pieces if text.startswith(x))

    assert math.isclose(model.word("abab")[0], math.log(total("▁abab")))
    long = "ab" * 3000
    assert model.word(long)[0] < -1000 and math.isfinite(model.word(long)[0])
    words = ["abab", "b", "xyz", "ba" * 15, "ba" * 16, "aé日", "ba" * 30, "z" * 31]
    assert np.allclose(model.words(words), [model.word(x) for x in words], rtol=1e-12)
    alone = [model.scores([x])[0] for x in ("abab ba", "x", None, "", "12", "ba" * 40)]
    assert alone == model.scores(["abab ba", "x", None, "", "12", "ba" * 40]) and [x[2] for x in alone] == [2, 1, 0, 0, 0, 1] and "ba" * 40 not in model.known
    before = language.expected_counts(model, {"abab": [2.0]})
    assert math.isclose(before[0, 0] + before[1, 0], 2.0)


def test_predictions_equal_a_plain_model(spark, sf, monkeypatch):
    docs = store.documents(spark, sf)
    model = language.fit(docs.where(language.remainder(4) != 2))
    p = {x: row for x, row in zip(model.pieces, model.probability, strict=True)}

    def total(word):
        ways = [np.ones(len(model.languages))]
        marked = language.MARK + word
        for end in range(1, len(marked) + 1):
            here = [(marked[k:end], ways[k]) for k in range(end)]
            ways.append(sum((w * p[x] for x, w in here if x in p), np.zeros(len(model.languages))) + (0 if marked[end - 1] in p else ways[end - 1] * language.UNKNOWN))
        return np.log(ways[-1])

    monkeypatch.setattr(language, "ENTRIES", 50)
    rows = docs.limit(60).collect()
    got = {r.doc_id: r for r in language.predict(docs.limit(60), model).collect()}
    for r in rows:
        words = [w for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()) if len(w) < 32]
        if not words or got[r.doc_id].n_words != len(words):
            continue
        logs = sum(map(total, words))
        assert got[r.doc_id].lang_pred == model.languages[int(logs.argmax())]
        assert math.isclose(got[r.doc_id].lang_score, 1 / np.exp(np.clip(logs - logs.max(), -700, 0)).sum(), rel_tol=1e-6)
    assert model.scores(["²³", "a² b"])[0][0] == "und"
    tied = language.Model(["x", "y"], ["▁", "a"], np.full((2, 2), 0.1))
    assert tied.scores(["a"])[0][:2] == ("x", 0.5)


def test_language_of_hard_texts_and_held_out(spark, sf):
    docs = store.documents(spark, sf)
    model = language.fit(docs.where(language.remainder(4) != 2))
    out = {r.doc_id: r for r in language.predict(frame(spark, HARD, extra=True), model).collect()}
    for k, text in enumerate(HARD):
        assert (out[k].lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= out[k].lang_score <= 1
    got = registry.QUERIES["op8_language"](spark, sf).join(docs, "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    none = language.fit(docs.limit(0))
    assert language.predict(docs.limit(3), none).where("lang_pred <> 'und'").count() == 0


# -- pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.language_stage, corpus_pipeline.line_stage, corpus_pipeline.duplicate_stage, corpus_pipeline.packing_stage]
    docs = store.documents(spark, sf)
    docs = docs.unionByName(frame(spark, HARD, ids=[10_000 + k for k in range(len(HARD))]).select(docs.columns))
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = store.materialise(stage(spark, seen, sf), "test")
        assert out.columns == docs.columns and out.join(seen, "doc_id", "left_anti").count() == 0
        seen = out
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = corpus_pipeline.language_stage(spark, docs, sf)
    assert {r.doc_id for r in first.collect()} == {k for k, x in texts.items() if any(c.isalpha() for c in x or "")}
    pieces = corpus_pipeline.packing_stage(spark, seen, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in seen.collect()}


CLASHES = ("lang_pred", "lang_score", "n_words", "n_lines", "n_dropped", "gone_id", "gone_row", "gone_lines", "_lines", "row", "component_id", "n_shingles", "ids", "bucket", "block")


def test_stages_bear_clashing_names_and_empty_tables(spark, sf):
    docs = frame(spark, ["one line is here and there\nline two", "one line is here and there\nsomething else", None, "a b c d e f g", "a b c d e f g", "12"])
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = store.materialise(stage(spark, table, sf), "test")
            assert table.columns == docs.columns, name
            assert {x for r in table.collect() for x in r[-len(CLASHES) :]} <= {"x"}
        assert corpus_pipeline.packing_stage(spark, table, sf).count() == (0 if table.isEmpty() else corpus_pipeline.packing_stage(spark, table, sf).count())
    rows = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, sf).collect()}
    assert rows == {0: "one line is here and there\nline two", 1: "something else", 2: None, 3: "a b c d e f g", 5: "12"}


def test_duplicate_stage_tells_texts_of_one_id_apart(spark, sf):
    texts = ["p q r s t u v", "a b c d e f g", "a b c d e f g", "h i j k l m n", "h i j k l m n", "x"]
    docs = frame(spark, texts, ids=[9, 3, 5, 5, None, None])
    left = sorted((r.doc_id or -1, r.text) for r in corpus_pipeline.duplicate_stage(spark, docs, sf).collect())
    assert left == sorted([(9, texts[0]), (3, texts[1]), (5, texts[3]), (-1, texts[4]), (-1, "x")])


def test_lines_do_not_depend_on_the_layout(spark):
    rng = random.Random(4)
    templates = [[f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.randrange(99)}" for _ in range(30)] for _ in range(4)]
    texts = []
    for _ in range(160):
        w = list(rng.choice(templates))
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(30)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    want = kept_by_brute_force(texts)
    for parts in (1, 13):
        got = {r.doc_id: set(r.lines) for r in linededup.dropped_lines(frame(spark, texts).repartition(parts)).collect()}
        assert len(set(want) ^ set(got)) <= 0.02 * len(want)


def test_language_stage_without_labels(spark, sf):
    docs = frame(spark, HARD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, sf).collect()} == {k for k, x in enumerate(HARD) if any(c.isalpha() for c in x or "")}


def test_pipeline_equals_brute_force(spark, sf):
    texts = {k: x for k, x in enumerate([*corpus(21)[:150], "²³", "line one is here\nline two is there", "line one is here\nsomething else entirely"])}
    docs = frame(spark, list(texts.values()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf), "test")
        if name == "language_id":
            texts = {k: x for k, x in texts.items() if any(c.isalpha() for c in x or "")}
        elif name == "line_dedup":
            gone = kept_by_brute_force([texts.get(k) for k in range(max(texts) + 1)])
            left = {k: "\n".join(y for j, y in enumerate(x.split("\n")) if j not in gone.get(k, ())) for k, x in texts.items()}
            texts = {k: x for k, x in left.items() if k not in gone or x.strip(linededup._SPACES)}
        else:
            found = by_brute_force([texts.get(k) for k in range(max(texts) + 1)])
            texts = {k: x for k, x in texts.items() if found[k][1] == k}
        assert {r.doc_id: r.text for r in docs.collect()} == texts, name
        assert all(r.n_chars == len(texts[r.doc_id]) for r in docs.collect())


def test_what_is_discarded_is_gone(spark):
    frame_ = store.materialise(spark.range(5), "test")
    path = frame_._stored.removeprefix("file://")
    assert frame_.count() == 5 and os.path.isdir(path)
    store.discard(frame_, spark.range(1))
    assert not os.path.exists(path)
    other = store.materialise(spark.range(5), "test")._stored
    store.clear(spark)
    assert not os.path.exists(other.removeprefix("file://")) and not store._lying


def test_queries_run_on_the_smallest_tables(spark, sf):
    for name, query in registry.QUERIES.items():
        rows = query(spark, sf)
        assert rows.columns and rows.count() > 0, name
