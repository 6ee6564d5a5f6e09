"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental byte-to-text machine.

Encoding. Every text goes through an Encoder in pieces of PIECE characters. Pre-tokens end at white space or at a change of the kind of
characters, so ids of all that stands before the last such border leave at once. Within a pre-token the merge list fixes how far a
change at its right end can move token borders to the left: merging two tokens u v there moves the first border that two continuations
share by the length of u, and only a later merge whose right side can stand at the moved border moves it further.
`sufficient_lookahead` takes the largest total over all such rising chains. A token that ends at least that many symbols before the end
of what has been read is stable, so it is emitted and forgotten. What is kept between pieces is less than one piece, one block and the
lookahead, whatever the length of the text or of a word (see Encoder for the one exception). Ids of short words come from caches of
bounded size, which hold what the merges gave.

Decoding takes ids block by block as the encoder emits them and carries the bytes of an unfinished character to the next block. The
digests are taken on the way; whole ids and texts are only held where they are asked for.

Null and empty texts have no ids. Repeated rows are encoded as they come, equal texts alike, and nothing depends on an order, so
there are no ties; rows without doc_id keep a null. Other columns are ignored. An empty table gives an empty result. The strings of
added tokens become their ids, as in the library.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import store
from tessera.llm.textkernel import slices
from tessera.llm.wordtokens import DEFAULT_TOKENIZER, byte_letters, tokenizer_path

#: Bounds of the caches of words and white-space separated chunks: entries of up to CHUNK characters.
CHUNK, ENTRIES = 48, 1 << 18
#: Bytes of a long pre-token that are merged at a time, and characters of a text that are read at a time.
BLOCK, PIECE = 4096, 1 << 16
_NONE = 1 << 62

_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = regex.compile(f"[{_SPACE}]+")
_CONTROL = regex.compile("[\x1c-\x1f]")
#: The vocabulary's pre-tokeniser pattern (a fixed value).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+".replace(r"\s", _SPACE))
_LETTER_RUN, _OTHER_RUN = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*".replace(r"\s", _SPACE))


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that may join the one before them into one, though they don't combine."""
    pairs = (unicodedata.decomposition(chr(k)).split() for k in range(0xA0, 0x110000))
    return frozenset(chr(int(x[1], 16)) for x in pairs if len(x) == 2 and x[0][0] != "<") | {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}


def begins_anew(c: str) -> bool:
    """Whether normalisation never joins or reorders this character with what stands before it."""
    return c < "\xa0" or (not unicodedata.combining(c) and c not in _seconds())


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int] | list[int]) -> int:
    """The most symbols by which later input can move a border shared by two tokenisations. merges: (left, right, made), in order."""
    reach: dict[int, int] = {}
    most = 0
    for left, right, made in merges:
        moved = reach.get(right, 0) + length[left]
        most = max(most, moved)
        reach[made] = max(reach.get(made, 0), reach.get(left, 0), moved)
        reach[left] = max(reach.get(left, 0), moved)
    return most


class Transducer:
    """The tables of one vocabulary: merges, their sufficient lookahead, pre-tokens and caches of their ids. encode() is one text."""

    _made: dict[str, Transducer] = {}

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(tokenizer_path(name))
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.spelling = [""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for text, k in [*vocabulary.items(), *self.added.items()]:
            self.spelling[k] = text
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        rows = []
        for k, (a, b) in enumerate(pairs):
            row = (vocabulary[a], vocabulary[b], vocabulary[a + b])
            self.rank[row[:2]] = (k, row[2])
            rows.append(row)
        self._value = {a << 17 | b: k << 17 | made for (a, b), (k, made) in self.rank.items()}.get
        symbols = [len(x[: len(x) - len(self.end)]) if self.end and x.endswith(self.end) else len(x) for x in self.spelling]
        self.length = symbols
        self.lookahead = sufficient_lookahead(rows, symbols)
        letters = byte_letters()
        self.inner = [vocabulary[x] for x in letters]
        self.last = [vocabulary[x + self.end] for x in letters]
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, bytes] = {}
        back = self._letter_byte = {x: b for b, x in enumerate(letters)}
        raw = [text.encode() if text in self.added else bytes(back[c] for c in text.removesuffix(self.end)) + (b" " if self.end and text.endswith(self.end) else b"") for text in self.spelling]
        #: Bytes of all tokens one after another, and where each begins: the text that they stand for, and their spellings.
        self.tables = [(np.frombuffer(b"".join(x), np.uint8), np.concatenate(([0], np.cumsum([*map(len, x)])))) for x in (raw, [b" " + x.encode() for x in self.spelling])]

    @classmethod
    def of(cls, name: str) -> Transducer:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    # -- merges ---------------------------------------------------------------------------------------------------

    def merged(self, tokens: list[int]) -> list[int]:
        """All merges that apply, in the list's order, the leftmost first."""
        if len(tokens) > 48:
            return self._merged_by_heap(tokens)
        value = self._value
        waiting = [value(a << 17 | b, _NONE) for a, b in zip(tokens, tokens[1:])]
        while waiting:
            best = min(waiting)
            if best == _NONE:
                break
            k = waiting.index(best)
            tokens[k : k + 2] = [best & 0x1FFFF]
            del waiting[k]
            if k:
                waiting[k - 1] = value(tokens[k - 1] << 17 | tokens[k], _NONE)
            if k < len(waiting):
                waiting[k] = value(tokens[k] << 17 | tokens[k + 1], _NONE)
        return tokens

    def _merged_by_heap(self, tokens: list[int]) -> list[int]:
        rank, n = self.rank, len(tokens)
        token, after, before = list(tokens), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*rank[p], k, p) for k, p in enumerate(zip(tokens, tokens[1:])) if p in rank]
        heap = [(r, k, made, p) for r, made, k, p in heap]
        heapq.heapify(heap)
        while heap:
            _, k, made, pair = heapq.heappop(heap)
            j = after[k]
            if j < 0 or (token[k], token[j]) != pair:
                continue
            token[k], token[j], after[k] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (found := rank.get((token[a], token[b]))):
                    heapq.heappush(heap, (found[0], a, found[1], (token[a], token[b])))
        out, k = [], 0
        while k >= 0:
            out.append(token[k])
            k = after[k]
        return out

    def stable(self, raw: bytes, kept: list[int]) -> tuple[list[int], list[int]]:
        """Tokens that no later input changes, once these bytes follow the kept symbols, and the symbols that stay."""
        out: list[int] = []
        for start in range(0, len(raw), BLOCK):
            kept = [*kept, *map(self.inner.__getitem__, raw[start : start + BLOCK])]
            read, sure = 0, len(kept) - self.lookahead
            for t in self.merged(kept):
                if read + self.length[t] > sure:
                    break
                out.append(t)
                read += self.length[t]
            kept = kept[read:]
        return out, kept

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token's bytes. A long one is read in blocks, and its tokens leave when they are stable."""
        if len(raw) <= BLOCK:
            return self.merged([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
        out, kept = self.stable(raw[:-1], [])
        return out + self.merged([*kept, self.last[raw[-1]]])

    # -- text to ids ----------------------------------------------------------------------------------------------

    def _chunk(self, chunk: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit bytes, of a stretch without white space or added tokens."""
        known = self.chunks.get(chunk)
        if known is not None:
            return known
        out: list[int] = []
        for word in [chunk.lower()] if chunk.isascii() and chunk.isalpha() else self.words_of(self.normal(chunk)):
            out += self.word_ids(word)
        found = np.array(out, dtype="<u4").tobytes()
        if len(chunk) <= CHUNK:
            self._keep(self.chunks, chunk, found)
        return found

    def word_ids(self, word: str) -> tuple[int, ...] | list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.word(word.encode())
            if len(word) <= CHUNK:
                ids = tuple(ids)
                self._keep(self.words, word, ids)
        return ids

    def normal(self, text: str) -> str:
        """Normalised text of a stretch without white space. Where this Python's Unicode tables don't have its characters yet, the library's give them."""
        if text.isascii():
            return text.lower()
        if any(unicodedata.category(c) == "Cn" for c in text):
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words_of(self, text: str) -> list[str]:
        """Pre-tokens of normalised text without white space."""
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in text):
            return _WORDS.findall(text)
        return [bytes(self._letter_byte[c] for c in word).decode() for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    @staticmethod
    def _keep(cache: dict, key: str, value: object) -> None:
        if len(cache) >= ENTRIES:
            for x in list(islice(cache, ENTRIES // 2)):
                del cache[x]
        cache[key] = value

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit bytes."""
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids of a text, read in pieces of PIECE characters, as they become stable."""
        encoder = Encoder(self)
        for k in range(0, len(text), PIECE):
            yield encoder.feed(text[k : k + PIECE] if len(text) > PIECE else text)
        yield encoder.finish()

    def chunked(self, text: str) -> bytes:
        """Ids of a text that no pre-token leaves."""
        if self._added and "<" in text and len(parts := self._added.split(text)) > 1:
            return b"".join([self.added[x].to_bytes(4, "little") if k % 2 else self._plain(x) for k, x in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        chunks = _SPACES.split(text) if _CONTROL.search(text) else text.split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            make = self._chunk
            found = [make(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
        return b"".join(found)

    def added_in(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """Where strings of added tokens stand."""
        return (m.span() for m in self._added.finditer(text, start)) if self._added else iter(())


class Encoder:
    """One text in pieces. Kept between them: what has been read since the last white space, up to PIECE characters; of a longer stretch
    its last two pre-tokens, which may still grow, and the strings of added tokens that may be half read; of a pre-token over BLOCK
    characters the symbols within the lookahead. Only a run of combining marks, which normalisation sorts as one, is kept whole."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.raw = ""
        self.pending = ""
        #: Of a long pre-token: its kind of characters, its symbols that aren't stable, and its last byte, which may be its end.
        self.run: regex.Pattern | None = None
        self.kept: list[int] = []
        self.byte = b""
        self.overlap = max([len(x) for x in machine.added] or [1]) - 1

    def feed(self, piece: str) -> bytes:
        """Ids that are stable once this piece has been read."""
        text, out = self.raw + piece, []
        if self.pending or self.run:
            space = _SPACES.search(text)
            if not space:
                self.raw = text
                return self._stretch()
            out.append(self._close(text[: space.start()]))
            text = text[space.start() :]
        cut = max(text.rfind(" "), text.rfind("\n")) + 1 or max((m.end() for m in _SPACES.finditer(text)), default=0)
        if cut:
            out.append(self.machine.chunked(text[:cut]))
        self.raw = text[cut:]
        if len(self.raw) > PIECE // 2:
            out.append(self._stretch())
        return b"".join(out)

    def finish(self) -> bytes:
        text, self.raw = self.raw, ""
        return self._close(text) if self.pending or self.run else self.machine.chunked(text)

    def _close(self, text: str) -> bytes:
        self.raw = ""
        return self._parts(text, True)

    def _stretch(self) -> bytes:
        """Reads on in a stretch without white space, up to where no added token and no composed character is cut."""
        text = self.raw
        cut = max(0, len(text) - self.overlap)
        for start, end in self.machine.added_in(text, max(0, cut - self.overlap)):
            if start < cut < end:
                cut = end
        while 0 < cut < len(text) and not begins_anew(text[cut]):
            cut -= 1
        self.raw = text[cut:]
        return self._parts(text[:cut], False)

    def _parts(self, text: str, last: bool) -> bytes:
        out, at = [], 0
        for start, end in self.machine.added_in(text):
            out.append(self._grow(text[at:start], True))
            out.append(self.machine.added[text[start:end]].to_bytes(4, "little"))
            at = end
        out.append(self._grow(text[at:], last))
        return b"".join(out)

    def _grow(self, text: str, last: bool) -> bytes:
        """More of a stretch; its last two pre-tokens wait unless it ends here."""
        text, out = self.machine.normal(text), []
        if self.run:
            own = self.run.match(text)
            part, text = text[: own.end()], text[own.end() :]
            out += self._symbols(part.encode())
            if not text and not last:
                return np.array(out, dtype="<u4").tobytes()
            out += self.machine.merged([*self.kept, self.machine.last[self.byte[0]]])
            self.run, self.kept, self.byte = None, [], b""
        words = self.machine.words_of(self.pending + text)
        self.pending = ""
        if not last and words:
            if len(words[-1]) > BLOCK:
                self.run = _LETTER_RUN if _LETTER_RUN.match(words[-1]).end() else _OTHER_RUN
                long = words.pop()
            else:
                self.pending = "".join(words[-2:])
                words, long = words[:-2], ""
            for word in words:
                out += self.machine.word_ids(word)
            out += self._symbols(long.encode())
        else:
            for word in words:
                out += self.machine.word_ids(word)
        return np.array(out, dtype="<u4").tobytes()

    def _symbols(self, raw: bytes) -> list[int]:
        """More bytes of the long pre-token: its tokens that are stable now."""
        if not raw:
            return []
        raw, self.byte = self.byte + raw[:-1], raw[-1:]
        out, self.kept = self.machine.stable(raw, self.kept)
        return out


class Decoder:
    """Ids to text block by block: a table gives each token's bytes, a machine turns bytes into characters and keeps those of an unfinished one.

    Spelt as the library's decode() of a vocabulary without a decoder, tokens are set apart by spaces; otherwise the text that they stand for."""

    def __init__(self, machine: Transducer, spelt: bool = True):
        self._data, self._at = machine.tables[spelt]
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")
        self._spelt, self._begun = spelt, False

    def feed(self, ids: bytes) -> str:
        k = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(k):
            return ""
        start = self._at[k]
        size = self._at[k + 1] - start
        first = np.cumsum(size) - size
        found = self._data[np.repeat(start - first, size) + np.arange(int(size.sum()))]
        # in the table a space stands before each spelling
        found = found[1:] if self._spelt and not self._begun else found
        self._begun = True
        return self._machine.decode(found.tobytes())

    def finish(self) -> str:
        return self._machine.decode(b"", True)


def _digests(machine: Transducer, text: str, whole: bool) -> tuple:
    """Number of tokens, digests of the ids and of the decoded text, as both leave their machines; with `whole` ids and text too."""
    decoder, n = Decoder(machine), 0
    ids_sha, decoded_sha = hashlib.sha256(), hashlib.sha256()
    ids, decoded = [], []
    for block in machine.stream(text):
        back = decoder.feed(block)
        n += len(block) // 4
        ids_sha.update(block)
        decoded_sha.update(back.encode())
        if whole:
            ids.append(np.frombuffer(block, "<u4").astype(np.int32))
            decoded.append(back)
    back = decoder.finish()
    decoded_sha.update(back.encode())
    return n, ids_sha.hexdigest(), decoded_sha.hexdigest(), *((np.concatenate([np.zeros(0, np.int32), *ids]), "".join([*decoded, back])) if whole else ())


def encode_decode(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and with `with_ids` ids (array) and decoded (the library's decoded text)."""
    store.bounded(docs.sparkSession)
    name = tokenizer or DEFAULT_TOKENIZER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(name)
        for batch in slices(batches, "text"):
            rows = [_digests(machine, x or "", with_ids) for x in batch.column(1).to_pylist()]
            n, ids_sha, decoded_sha, *more = zip(*rows, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                columns += [pa.array(more[0], pa.list_(pa.int32())), pa.array(more[1], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, ddl)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(store.documents(spark, sf_dir))
