"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

For each language every piece of the vocabulary has a probability. A word, with a mark for its beginning, is worth the sum
over all its segmentations into pieces of the products of their probabilities, which the forward algorithm gives; a text is
worth the product over its words. The probabilities come from expectation-maximisation over all segmentations of the words
of a bounded sample of labelled documents.

Bounds of the fit, all parameters: about `sample_docs` documents a language, taken evenly by a hash of the id; the
`most_languages` commonest labels; the `sample_words` commonest words of each, of up to CHUNK characters. Everything else
covers whole texts, however long.

A word is a run of letters, lower-cased. Text that is null or has no letter is `und` with score 0. The score is the posterior
probability of the predicted language under equal priors; ties go to the language that sorts first. Without any labelled row
every text is `und`. Repeated rows get equal results; a null doc_id stays null; an empty table gives an empty result. Columns other than
doc_id, text and lang (for the fit) are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.textkernel import slices
from tessera.llm.wordtokens import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS, SAMPLE_WORDS, MOST_LANGUAGES = 500, 4000, 256
ROUNDS = 3
#: Pseudo-count of every piece, and the probability of a character that no piece covers.
SMOOTH, UNKNOWN = 0.02, 1e-7
MARK = "▁"
#: Words up to CHUNK characters are kept, about ENTRIES of them; those below TOGETHER characters are scored together.
ENTRIES, CHUNK, TOGETHER = 1 << 18, 48, 32
#: Bits of a piece's number, below its size.
PLACE = 24

_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def vocabulary(name: str = VOCABULARY) -> list[str]:
    """The lower-case pieces of a public vocabulary that consist of letters, with or without the mark, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    return sorted({x for x in pieces if x.removeprefix(MARK).isalpha() and x == x.lower()} | {MARK})


class Model:
    """Languages, and of each piece the probabilities in them (a matrix of pieces by languages). The log probabilities of words that
    have occurred are kept in a table, of which `known` gives the row of each word."""

    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray):
        self.languages, self.pieces, self.probability = languages, pieces, probability
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)))
        self._automaton: ahocorasick.Automaton | None = None
        self._rows: list[list[float]] = []

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "probability": self.probability, "known": {}, "table": self.table[:0], "_automaton": None, "_rows": []}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            self._rows = self.probability.tolist()
            for k, x in enumerate(self.pieces):
                self._automaton.add_word(x, len(x) << PLACE | k)
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, text: str) -> Iterator[tuple[int, int, int, list[float]]]:
        """(last place, size, piece, its probabilities) of the pieces in a text."""
        for end, x in self.automaton().iter(text):
            k = x & ((1 << PLACE) - 1)
            yield end, x >> PLACE, k, self._rows[k]

    def word(self, word: str) -> tuple[float, ...]:
        """Log probability of a word in each language: the forward algorithm, rescaled where it would vanish."""
        marked = MARK + word
        n, spread = len(marked), range(len(self.languages))
        forward = [[1.0] * len(spread)] + [[0.0] * len(spread) for _ in range(n)]
        by_end: list[list] = [[] for _ in range(n)]
        for end, *match in self.matches(marked):
            by_end[end].append(match)
        scale, longest = [0.0] * len(spread), 64
        for end, matches in enumerate(by_end, 1):
            row, unknown = forward[end], True
            for size, _, p in matches:
                before = forward[end - size]
                unknown &= size > 1
                for j in spread:
                    row[j] += before[j] * p[j]
            if unknown:
                before = forward[end - 1]
                for j in spread:
                    row[j] += before[j] * UNKNOWN
            if min(row) < 1e-200:
                for j in spread:
                    if 0.0 < row[j] < 1e-200:
                        scale[j] -= 460.0
                        grown = math.exp(460.0)
                        for k in range(max(0, end - longest), end + 1):
                            forward[k][j] *= grown
        return tuple(math.log(forward[n][j]) + scale[j] if forward[n][j] > 0 else -1e4 for j in spread)

    def words(self, words: list[str]) -> np.ndarray:
        """word() of many words at once, a row each: all words take each step of the forward algorithm together."""
        out = np.zeros((len(words), len(self.languages)))
        short = [k for k, x in enumerate(words) if len(x) < TOGETHER]
        for k in (k for k, x in enumerate(words) if len(x) >= TOGETHER):
            out[k] = self.word(words[k])
        for first in range(0, len(short), 8192):
            at = short[first : first + 8192]
            out[at] = self._together([words[k] for k in at])
        return out

    def _together(self, words: list[str]) -> np.ndarray:
        # one pass over all words, a break after each
        length = np.array([len(x) + 1 for x in words])
        start = np.cumsum(length + 1) - length - 1
        found = np.fromiter(chain.from_iterable(self.automaton().iter(MARK + f"\n{MARK}".join(words))), np.int64).reshape(-1, 2)
        size, piece = found[:, 1] >> PLACE, found[:, 1] & ((1 << PLACE) - 1)
        owner = np.searchsorted(start, found[:, 0], side="right") - 1
        end = found[:, 0] - start[owner] + 1
        longest = int(length.max())
        single = np.zeros((longest + 1, len(words)), dtype=bool)
        single[end[size == 1], owner[size == 1]] = True
        order = np.argsort(end, kind="stable")
        owner, end, size, piece = owner[order], end[order], size[order], piece[order]
        cut = np.searchsorted(end, np.arange(longest + 2))
        forward = np.zeros((longest + 1, len(words), len(self.languages)))
        forward[0] = 1.0
        for e in range(1, longest + 1):
            own = owner[cut[e] : cut[e + 1]]
            if len(own):
                through = forward[e - size[cut[e] : cut[e + 1]], own] * self.probability[piece[cut[e] : cut[e + 1]]]
                new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                forward[e, own[new]] = np.add.reduceat(through, new)
            # a character that no piece is
            forward[e] += forward[e - 1] * (UNKNOWN * ~single[e])[:, None]
        last = forward[length, np.arange(len(words))]
        return np.where(last > 0, np.log(np.maximum(last, 1e-300)), -1e4)

    def scores(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, posterior and number of words of each whole text."""
        split: list[list[str]] = []
        for text in texts:
            words = _LETTERS.findall(text.lower()) if text else []
            if words and not words[0].isalpha():  # numerals such as superscripts count as word characters too
                words = [w for w in words if any(map(str.isalpha, w))]
            split.append(words)
        if not self.languages:
            return [(UNDETERMINED, 0.0, len(x)) for x in split]
        if len(self.known) > ENTRIES:
            kept = list(self.known.items())[len(self.known) // 2 :]
            self.table = self.table[[k for _, k in kept]]
            self.known = {x: k for k, (x, _) in enumerate(kept)}
        known = self.known
        new = list({x for words in split for x in words if x not in known})
        if new:
            rows = self.words(new)
            self.table = np.concatenate([self.table[: len(known)], rows])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        out = []
        for words in split:
            if not words:
                out.append((UNDETERMINED, 0.0, 0))
                continue
            total = self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum()), len(words)))
        long = [x for x in new if len(x) > CHUNK]
        if long:  # long words aren't kept
            kept = [(x, k) for x, k in known.items() if len(x) <= CHUNK]
            self.table = self.table[[k for _, k in kept]]
            self.known = {x: k for k, (x, _) in enumerate(kept)}
        return out


def expected_counts(model: Model, words: dict[str, list[float]]) -> np.ndarray:
    """Expected uses of each piece over all segmentations of words, each with its count in every language."""
    spread = range(len(model.languages))
    out = np.zeros_like(model.probability).tolist()
    for word, count in words.items():
        marked = MARK + word
        n = len(marked)
        matches = [(end + 1, *m) for end, *m in model.matches(marked)]
        covered = {end for end, size, *_ in matches if size == 1}
        forward = [[1.0] * len(spread)] + [[0.0] * len(spread) for _ in range(n)]
        edges = sorted([*matches, *((e, 1, -1, [UNKNOWN] * len(spread)) for e in range(1, n + 1) if e not in covered)], key=lambda m: m[0])
        for end, size, _, p in edges:
            row, before = forward[end], forward[end - size]
            for j in spread:
                row[j] += before[j] * p[j]
        backward = [[0.0] * len(spread) for _ in range(n)] + [[1.0] * len(spread)]
        for end, size, k, p in reversed(edges):
            row, after, before = backward[end - size], backward[end], forward[end - size]
            for j in spread:
                through = p[j] * after[j]
                row[j] += through
                if k >= 0 and count[j] and forward[n][j] > 0:
                    out[k][j] += count[j] * before[j] * through / forward[n][j]
    return np.array(out)


def _normal(counts: np.ndarray) -> np.ndarray:
    counts = counts + SMOOTH
    return counts / counts.sum(axis=0)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, most_languages: int = MOST_LANGUAGES, rounds: int = ROUNDS) -> Model:
    """A model from doc_id, text and lang of labelled documents."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    pieces = vocabulary()
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    languages = sorted(sizes)
    taken = F.lit(False)
    for lang, n in sizes.items():
        taken = taken | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // sample_docs))) == 0))
    words = labelled.where(taken).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word")).where(F.length("word") <= CHUNK)
    words = store.materialise(words.groupBy("lang", "word").count(), "words")
    counted: dict[str, list[float]] = {}
    for j, lang in enumerate(languages):
        for r in words.where(F.col("lang") == lang).orderBy(F.desc("count"), "word").limit(sample_words).collect():
            counted.setdefault(r["word"], [0.0] * len(languages))[j] = float(r["count"])
    store.discard(words)
    model = Model(languages, pieces, np.full((len(pieces), len(languages)), 1.0 / len(pieces)))
    for _ in range(rounds):
        model = Model(languages, pieces, _normal(expected_counts(model, counted)))
    return model


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, found: tuple[str, str, str] = ("lang_pred", "lang_score", "n_words")) -> DataFrame:
    """Language, score (0 to 1) and number of words beside the kept columns (doc_id), from the text alone; `found` names the three, and
    kept columns of these names are replaced. The model goes out once to each executor."""
    spark = docs.sparkSession
    store.bounded(spark)
    keep = [x for x in keep or ["doc_id"] if x.lower() not in {y.lower() for y in found}]
    kept = docs.select(*(docs[f"`{x}`"] for x in keep)).schema
    names = [*keep, *found]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{x}` {kind}" for x, kind in zip(found, ("string", "double", "long"), strict=True))])
    own = [x.lower() for x in keep].index("text") if "text" in map(str.lower, keep) else len(keep)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = sent.value.scores
        for batch in slices(batches, [*keep, "text"][own], 1 << 20):
            rows = scores(batch.column(own).to_pylist())
            lang, posterior, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(posterior, pa.float64()), pa.array(n, pa.int64())], names=names)

    return docs.select(*(docs[f"`{x}`"] for x in keep), *[docs["text"]] * (own == len(keep))).mapInArrow(run, ddl)


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo `modulus`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(remainder(4) != 2))
    return predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "n_words")
