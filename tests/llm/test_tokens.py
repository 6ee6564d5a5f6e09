"""Packing and BPE against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tessera.llm.wordtokens import DEFAULT_TOKENIZER, TokenCache
from tests.llm.helpers import HARD, frame


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path(DEFAULT_TOKENIZER))
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_pieces_are_binary_and_lossless(spark, library):
    rows = packing.pack(frame(spark, HARD, extra=True), with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for k, text in enumerate(HARD):
        want = [*ids_of(library, text).tolist(), 2]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == want
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        for r in own:
            assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.length == 1 << r.bucket and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())


def test_equal_lengths_stand_together(spark):
    pieces = packing.pack(frame(spark, [*HARD, *("word " * k for k in range(300))]).repartition(5))
    parts = pieces.withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    runs = [(r.p, r.bucket) for k, r in enumerate(parts) if not k or (parts[k - 1].p, parts[k - 1].bucket) != (r.p, r.bucket)]
    assert len(runs) == len(set(runs)) and {r.bucket for r in parts} == set(range(13))


def test_packing_of_an_empty_table_and_bad_length(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, ["a"]), longest=100)


def test_binary_lengths():
    assert packing.binary_lengths(10000) == [4096, 4096, 1024, 512, 256, 16]
    assert all(sum(packing.binary_lengths(n)) == n for n in range(9000))


def test_bpe_digests(spark, library):
    rows = {r.doc_id: r for r in bpe.encode_decode(frame(spark, HARD, extra=True), with_ids=True).collect()}
    for k, text in enumerate(HARD):
        ids = ids_of(library, text)
        decoded = library.decode(ids.tolist(), skip_special_tokens=False)
        r = rows[k]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert r.ids == ids.tolist() and r.decoded == decoded
    assert bpe.encode_decode(frame(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_and_cache_equal_the_library(text):
    want = ids_of(TokenCache.of(DEFAULT_TOKENIZER).library, text).tobytes()
    assert bpe.Transducer.of(DEFAULT_TOKENIZER).encode(text) == want
    assert TokenCache.of(DEFAULT_TOKENIZER).encode_bytes(text) == want


def test_long_words_stream_with_bounded_lookahead(library):
    machine = bpe.Transducer.of(DEFAULT_TOKENIZER)
    assert 0 < machine.lookahead < bpe.BLOCK
    rng = random.Random(1)
    for letters in ("ab", "theinrs", ".-=", "aé"):
        for n in (bpe.BLOCK - 1, bpe.BLOCK, bpe.BLOCK + 1, 5 * bpe.BLOCK + 17):
            text = "".join(rng.choices(letters, k=n))
            assert machine.encode(text) == ids_of(library, text).tobytes()


def test_lookahead_of_a_small_merge_list():
    # symbols a b c; a change after "c" may undo b c, and that may undo a b
    assert bpe.sufficient_lookahead([(1, 2, 3)], [1, 1, 1, 2]) == 1
    assert bpe.sufficient_lookahead([(1, 2, 3), (0, 1, 4)], [1, 1, 1, 2, 2]) == 2


PIECES = ["The quick brown fox, naïve café 日本 ", "it's we'll don't 'save 're 'r ", "<|endoftext|>", "<|end", "oftext|><|startoftext|>x", "a" * 5000, "." * 4500 + "'s", "'" * 4200, "é" * 3000, "e\u0301" * 3000, "\u1100\u1161\u11a8" * 1500, "x\u0323\u0307" * 900, "12345" * 900, "Σ" * 4500 + "ς", "\x1c\x85 \u3000", "\U0001f44d\U0001f3fd" * 1200, "\n\n"]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 16])
def test_feeding_in_pieces_and_decoding_in_blocks(library, monkeypatch, size):
    monkeypatch.setattr(bpe, "PIECE", size)
    monkeypatch.setattr(bpe, "BLOCK", 300 if size > 7 else 4096)
    machine, rng = bpe.Transducer(DEFAULT_TOKENIZER), random.Random(size)
    for _ in range(1 if size == 1 else 12):
        text = "".join(rng.choices(PIECES, k=6))[: 4000 if size == 1 else None]
        blocks = list(machine.stream(text))
        ids = ids_of(library, text)
        assert b"".join(blocks) == ids.tobytes()
        decoder = bpe.Decoder(machine)
        assert "".join([*map(decoder.feed, blocks), decoder.finish()]) == library.decode(ids.tolist(), skip_special_tokens=False)
    text = "The quick brown fox, naïve café 日本 " * 50
    decoder = bpe.Decoder(machine, spelt=False)
    back = "".join([decoder.feed(x.to_bytes(4, "little")) for x in ids_of(library, text).tolist()] + [decoder.finish()])
    assert back.split() == "the quick brown fox , naïve café 日本".split() * 50


def test_memory_does_not_grow_with_the_text(library):
    machine = bpe.Transducer(DEFAULT_TOKENIZER)
    peaks = []
    for n in (2, 12):
        encoder, decoder = bpe.Encoder(machine), bpe.Decoder(machine)
        tracemalloc.start()
        for k in range(n):
            decoder.feed(encoder.feed(("theinrsao"[k % 9 :] * bpe.PIECE)[: bpe.PIECE]))
        encoder.finish()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0]
