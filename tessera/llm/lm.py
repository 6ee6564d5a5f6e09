"""Language-model scores of all documents by a bigram model in an Elias-Fano trie, learnt from the whole training part.

Tokens of a text are its words (see textkernel) and one end. With c the training count of a token, N of all tokens and V of
distinct ones, the lowest level is base(w) = (c + 0.1) / (N + 0.1 (V + 1)). The level above interpolates with it, as a
Dirichlet prior of weight `prior`: p(w | v) = (c(v w) + prior * base(w)) / (c(v) + prior), where v is the token before or
the start. The logarithms of seen bigrams' probabilities are stored in steps of 0.05; unseen ones follow from the lower level.

The trie is cut into parts by a hash of the whole bigram, so no word, however common, makes a part large, and parts are as many
as the text asks for. Slices of documents, once written, send every distinct token and then every distinct bigram once to its
part, with its training count there; the part sums the counts, builds its levels in a memory map, looks the asked n-grams up
by context-relative successor search and answers each slice. Nothing is gathered on the driver but N and V.

Null text counts as empty: the end alone. Repeated rows count and are scored as they come; a null doc_id is held in training.
Very long texts are taken whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import graph, store
from tessera.llm.eliasfano import TriePart
from tessera.llm.textkernel import U64, mix, slices, text_buffers, word_hashes

PRIOR = 30.0
STEP = 0.05
_SLICE = 4 << 20
_END, _START = U64(0x0E0D), U64(0x57A7)
_24 = U64((1 << 24) - 1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _sliced(docs: DataFrame) -> DataFrame:
    """Slices of documents: number, ids (null ids: a mask), whether held out, offsets, and the lower-cased text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        pack = zstandard.ZstdCompressor(level=9)
        for batch in slices(batches, "text", _SLICE):
            data, at = text_buffers(batch.column(1))
            ids, held = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            fields = (ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), held.astype(bool).tobytes(), at.tobytes(), pack.compress(_lower[data].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in fields)], names=["slice", "ids", "nulls", "held", "at", "text"])
            number += 1

    return docs.mapInArrow(run, "slice long, ids binary, nulls binary, held binary, at binary, text binary")


class _Slice:
    """The tokens of a slice: their hashes, distinct ones, and the document of each."""

    def __init__(self, row: dict):
        self.number = row["slice"]
        at = np.frombuffer(row["at"], np.int64)
        self.ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
        self.held = np.frombuffer(row["held"], bool)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
        hashes, first = word_hashes(data, at)
        tokens = np.insert(hashes, first[1:], _END)
        self.first = first + np.arange(len(first))
        self.doc = np.repeat(np.arange(len(self.held)), np.diff(self.first))
        self.learns = ~self.held[self.doc]
        self.keys, self.token = np.unique(tokens, return_inverse=True)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (before, token) as numbers before * distinct tokens + token, their training counts, and the place of each token's own.
        The start counts as one token more."""
        n = len(self.keys)
        before = np.concatenate(([n], self.token[:-1]))
        before[self.first[:-1]] = n
        found, at = np.unique(before * n + self.token, return_inverse=True)
        return found, np.bincount(at[self.learns], minlength=len(found)), at


def _sent(number: int, parts: int, keys: np.ndarray, fields: list[np.ndarray]) -> Iterator[tuple]:
    """Rows (part, slice, each field's bytes) for keys in rising order."""
    for part, start, end in graph.cuts(graph.part_of(keys, parts)):
        yield part, number, *(x[start:end].tobytes() for x in fields)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int32() if x == "part" else pa.int64() if x in ("slice", "tokens", "distinct") else pa.binary() for x in names]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _ask_tokens(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Slice(row)
                counts = np.bincount(s.token[s.learns], minlength=len(s.keys)).astype(np.int64)
                yield from _table([*_sent(s.number, parts, s.keys, [s.keys, counts])], ["part", "slice", "keys", "counts"]).to_batches()

    return run


def _count_tokens(table: pa.Table) -> pa.Table:
    """Each slice's tokens with their counts in the corpus, and a row of slice -1 with the part's sums."""
    keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, at, counts)
    ends = np.cumsum([len(x) for x in keys]).tolist()
    of = total[at]
    rows = [(p, s, of[e - len(k) : e].tobytes(), 0, 0) for p, s, k, e in zip(table.column("part").to_pylist(), table.column("slice").to_pylist(), keys, ends, strict=True)]
    return _table([*rows, (rows[0][0], -1, None, int(total.sum()), int((total > 0).sum()))], ["part", "slice", "counts", "tokens", "distinct"])


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    rows = sorted(zip(table.column("part").to_pylist(), table.column(column).to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for _, x in rows)])


def _level(p: np.ndarray) -> np.ndarray:
    """Stored steps of a log10 probability, from 1 on."""
    return np.clip(np.round(-p / STEP) + 1, 1, 255).astype(np.uint8)


class _Weights:
    def __init__(self, n: int, v: int, prior: float):
        self.n, self.v, self.prior = n, v, prior

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.n + 0.1 * (self.v + 1))


def _contexts(s: _Slice, counts: np.ndarray) -> np.ndarray:
    """Training counts of what stands before: those of the tokens, and for the start that of the ends."""
    end = np.searchsorted(s.keys, _END)
    return np.append(counts, counts[end])


def _three_bytes(x: np.ndarray) -> np.ndarray:
    """The low 24 bits, as rows of three bytes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])


def _from_three_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


def _ask_bigrams(parts: int, w: _Weights):
    names = ["part", "slice", "context", "successor", "counts", "before", "lower"]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in rows.to_pylist():
            s = _Slice(row)
            counts = _joined(answers, "counts", np.int64)
            found, seen, _ = s.bigrams()
            before, token = np.divmod(found, len(s.keys))
            left, right = mix(np.append(s.keys, _START))[before], s.keys[token]
            hashed = mix(left + right * U64(0x9DDFEA08EB382D69))
            order = np.argsort(hashed)
            # context and successor by 24 bits each; counts and probabilities below, in steps, are for the smoothing
            c = np.round(np.log2(_contexts(s, counts)[before] + 1) * 6).astype(np.uint8)
            fields = [_three_bytes(left >> U64(20)), _three_bytes(mix(right) >> U64(20)), seen.astype(np.uint8 if seen.max(initial=0) < 256 else np.uint32), c, _level(np.log10(w.base(counts[token])))]
            out += _sent(s.number, parts, hashed[order], [x[order] for x in fields])
        return _table(out, names)

    return run


def _answer_bigrams(w: _Weights):
    def run(table: pa.Table) -> pa.Table:
        def joined(column: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, np.uint8) for x in table.column(column).to_pylist()])

        context, successor = (_from_three_bytes(b"".join(table.column(x).to_pylist())) for x in ("context", "successor"))
        sizes = [len(x) // 3 for x in table.column("context").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == n else np.uint32) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        keys, first, at = np.unique(context.astype(U64) << U64(24) | successor.astype(U64), return_index=True, return_inverse=True)
        seen = np.bincount(at, weights=counts)
        known = seen > 0
        before = np.exp2(joined("before")[first][known] / 6.0) - 1
        lower = 10.0 ** (-(joined("lower")[first][known].astype(np.float64) - 1) * STEP)
        # steps of `before` may fall below the count of the bigram itself
        p = (seen[known] + w.prior * lower) / (np.maximum(before, seen[known]) + w.prior)
        trie = TriePart.mapped(TriePart.build((keys[known] >> U64(24)), keys[known] & _24, _level(np.log10(np.minimum(p, 1)))))
        values = trie.find(keys >> U64(24), keys & _24)[at]
        ends = np.cumsum(sizes).tolist()
        starts = [0, *ends[:-1]]
        return _table([(p, s, values[a:b].tobytes()) for p, s, a, b in zip(table.column("part").to_pylist(), table.column("slice").to_pylist(), starts, ends, strict=True)], ["part", "slice", "values"])

    return run


def _score(w: _Weights):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            s = _Slice(row)
            counts = _joined(answers.filter(pa.compute.is_valid(answers.column("counts"))), "counts", np.int64)
            values = _joined(answers.filter(pa.compute.is_valid(answers.column("values"))), "values", np.uint8)
            found, _, at = s.bigrams()
            before, token = np.divmod(found, len(s.keys))
            hashed = mix(mix(np.append(s.keys, _START))[before] + s.keys[token] * U64(0x9DDFEA08EB382D69))
            value = np.empty(len(found), dtype=np.float64)
            value[np.argsort(hashed)] = values
            lower = np.log10(w.base(counts))
            unseen = np.log10(w.prior / (_contexts(s, counts)[before] + w.prior)) + lower[token]
            p = np.where(value > 0, (1 - value) * STEP, unseen)[at]
            n = len(s.held)
            out.append(pa.table({
                "doc_id": s.ids, "held_out": pa.array(s.held), "n_tokens": pa.array(np.diff(s.first)),
                "n_known": pa.array(np.bincount(s.doc[counts[s.token] > 0], minlength=n)), "train_tokens": pa.array(np.full(n, w.n)),
                "base_score": pa.array(np.bincount(s.doc, weights=lower[s.token], minlength=n)), "score": pa.array(np.bincount(s.doc, weights=p, minlength=n)),
            }))
        return pa.concat_tables(out) if out else _NONE

    return run


_NONE = pa.table({x: pa.array([], t) for x, t in [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]})
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out: Column, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text; the model learns from documents that aren't held out."""
    store.bounded(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    parts = graph.part_count(texts)
    sliced = store.materialise(_sliced(texts), "slices")
    asked = sliced.mapInArrow(_ask_tokens(parts), "part int, slice long, keys binary, counts binary")
    tokens = store.materialise(asked.groupBy("part").applyInArrow(_count_tokens, "part int, slice long, counts binary, tokens long, distinct long"), "tokens", sweep=True)
    n, v = tokens.where("slice = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    w = _Weights(n, v, prior)
    own = tokens.where("slice <> -1").select("part", "slice", "counts")
    bigrams = sliced.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(_ask_bigrams(parts, w), "part int, slice long, context binary, successor binary, counts binary, before binary, lower binary")
    answers = store.materialise(bigrams.groupBy("part").applyInArrow(_answer_bigrams(w), "part int, slice long, values binary"), "bigrams", sweep=True)
    both = own.withColumn("values", F.lit(None).cast("binary")).unionByName(answers.withColumn("counts", F.lit(None).cast("binary")))
    return sliced.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(_score(w), SCORES)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_documents(store.documents(spark, sf_dir), held)
