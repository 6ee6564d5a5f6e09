"""Packing by power-of-two decomposition: documents become pieces of binary length, and equal lengths share a bucket.

A document of n tokens is cut into n // longest pieces of `longest` tokens and one piece for each set bit of the rest, in
falling order. Every piece fills a sequence of its own length, so no sequence crosses documents and none needs padding. The sequence
id names the partition that made the piece and its place there.

Then the pieces, not the texts, are dealt out by bucket (the length's logarithm) and a lane, a hash of the sequence id, of which there
are as many as shuffle partitions: a bucket that holds most pieces has as many lanes as any. Each partition is sorted by bucket and
sequence, so equal lengths stand together and a reader takes batches of one length from a run of rows.

Null text counts as empty; an empty document is the end token alone. Repeated rows are packed as they come; sequence ids are distinct,
so the order has no ties. Very long texts are taken whole, as many pieces. Rows without doc_id keep a null doc_id. Columns other than
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.textkernel import slices
from tessera.llm.wordtokens import DEFAULT_TOKENIZER, TokenCache

LONGEST = 4096
END_ID = 2

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32()),
])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of n tokens: n's whole multiples of `longest`, then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length),
    and with `with_ids` the piece's ids as an array. In each partition the pieces of a bucket stand together."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    store.bounded(docs.sparkSession)
    name = tokenizer or DEFAULT_TOKENIZER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenCache.of(name)
        end = np.array([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            pieces: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = cache.encode_bytes(text or "") + end
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    piece = ids[start * 4 : (start + length) * 4]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, 0, length.bit_length() - 1))
                    if with_ids:
                        pieces.append(np.frombuffer(piece, dtype="<u4"))
                    start += length
                    sequence += 1
            columns = [pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), PIECES, strict=True)]
            if with_ids:
                at = np.concatenate(([0], np.cumsum([len(x) for x in pieces]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(pieces).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[*PIECES.names, *["ids"] * with_ids])

    pieces = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, DDL + ", ids array<int>" * with_ids)
    lanes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition("bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(lanes))).sortWithinPartitions("bucket", "sequence_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(store.documents(spark, sf_dir))
