"""Token ids of whole texts as the tokenizers library gives them, through bounded caches of chunks and words.

The vocabulary's normaliser and pre-tokeniser never look across white space, so the ids of a text are those of its chunks
in order. Texts for which that may not hold (a special token's string, or U+001C-U+001F, which are no white space to the
library but are to str.split) go to the library as a whole, and so does every chunk beyond Latin letters. Other chunks are
cut into words here and only the library's merges run on them.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import regex

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Bounds of the caches: entries of up to CHUNK characters, ENTRIES of them.
CHUNK, ENTRIES = 48, 1 << 17

_ODD = re.compile("[\x1c-\x1f]|<\\|")
#: Characters whose case folding, composition or class the two sides might see otherwise.
_BEYOND = re.compile("[^\x00-įı-ſ]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print as one Latin-1 character
    keep it, the others take those from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return [chr(x) for _, x in sorted([*zip(own, own, strict=True), *((b, 0x100 + k) for k, b in enumerate(others))])]


def _halve(cache: dict) -> None:
    for x in list(islice(cache, len(cache) // 2)):
        del cache[x]


class TokenCache:
    """Ids of chunks as little-endian unsigned 32-bit bytes. One per worker process and vocabulary."""

    _made: dict[str, TokenCache] = {}

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = self.library.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, name: str) -> TokenCache:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def library_bytes(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
        out = b"".join([t.id.to_bytes(4, "little") for t in self.merges(spelt)])
        if len(word) <= CHUNK:
            if len(self.words) >= ENTRIES:
                _halve(self.words)
            self.words[word] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        if _BEYOND.search(chunk):
            out = self.library_bytes(chunk)
        elif chunk.isalpha():
            word = chunk.lower()
            out = self.words.get(word) or self._word(word)
        else:
            words = self.words
            out = b"".join([words.get(w) or self._word(w) for w in _WORDS.findall(chunk.lower())])
        if len(chunk) <= CHUNK:
            if len(self.known) >= ENTRIES:
                _halve(self.known)
            self.known[chunk] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of the whole text, as bytes."""
        if _ODD.search(text):
            return self.library_bytes(text)
        chunks = text.split()
        found = list(map(self.known.get, chunks))
        if None in found:
            known = self.known
            for k, x in enumerate(found):
                if x is None:
                    # a chunk may repeat in the text, or have been dropped meanwhile
                    found[k] = known.get(chunks[k]) or self._chunk(chunks[k])
        return b"".join(found)
