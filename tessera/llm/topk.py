"""Exact top-k search by three phases with a uniform threshold.

A score is the sum of partial scores over `lists` ranges of the vectors' components. Vectors lie in groups of bounded size, and
a group's task holds the score lists of its vectors for a block of queries.

1. Each group gathers, for every query, the best k entries of each of its lists, completes their scores, and sends the best k.
   Merged over the groups, the k-th best of a query is a safe cutoff: its final k-th score is no smaller.
2. The cutoff goes back to the groups with the query block. An entry below cutoff / lists in every list cannot reach the cutoff,
   so those that reach it in one list at least are sufficient.
3. The scores of these are completed exactly; each group sends its best k of those that reach the cutoff, and the merge of
   these is the result.

Merging takes at most FAN groups' answers at a time, level by level. Blocks of queries meet all groups by a merge join on a
share of the groups, so work is queries times vectors, as the contract asks, while no task holds more than a block and a group
in Python, and nothing that grows with the table goes through the driver.

Components are floor(64 * x) as whole numbers; float64 products are used where they are exact, else 64-bit integers, which a score has
to fit. Vectors
that are null or hold null or non-finite components take no part, nor do rows without id; of rows with equal id the smallest
vector counts. Vectors of unequal length are filled up with zeros. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store

K, SCALE, LISTS, GROUP, BLOCK, FAN = 20, 64.0, 2, 8192, 512, 64
#: Query blocks are copied to so many shares of the groups, or to two for each core, where there are more groups than that.
SPREAD = 32


def _packer(scale: float):
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        vectors = table.column("embedding").combine_chunks()
        at = vectors.offsets.to_numpy().astype(np.int64)
        flat = np.floor(vectors.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        size = np.diff(at)
        width = int(size.max(initial=0))
        full = np.zeros((len(ids), width), dtype=np.int64)
        full[np.arange(width) < size[:, None]] = flat[at[0] : at[-1]].astype(np.int64)
        order = np.lexsort([*full.T[::-1], ids]) if width else np.argsort(ids, kind="stable")
        ids, full = ids[order], full[order]
        first = np.concatenate(([True], ids[1:] != ids[:-1]))
        ids, full = ids[first], full[first]
        kind = np.int16 if not full.size or np.abs(full).max() < 1 << 15 else np.int64
        return pa.table({"part": table.column("part")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "width": pa.array([width], pa.int32()), "wide": pa.array([kind is np.int64]), "body": pa.array([full.astype(kind).tobytes()], pa.binary())})

    return pack


def _grouped(vectors: DataFrame, size: int, scale: float) -> tuple[DataFrame, int]:
    """Packed groups of about `size` vectors, dealt by a hash of the id, and their number."""
    parts = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(_packer(scale), "part int, ids binary, width int, wide boolean, body binary"), parts


def _matrix(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    body = np.frombuffer(row["body"], np.int64 if row["wide"] else np.int16).reshape(len(ids), row["width"])
    return ids, np.pad(body, ((0, 0), (0, width - row["width"])))


def _partial(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number products: float64 where every sum stays below 2**53."""
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] >= 2.0**53:
        return q.astype(np.int64) @ v.astype(np.int64).T
    return q.astype(np.float64) @ v.astype(np.float64).T


def _best(score: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k highest scores of flat entries, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    score, ids, query = score[order], ids[order], query[order]
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    keep = rank < k
    return score[keep], ids[keep], query[keep]


ANSWER = "block int, part int, query binary, ids binary, score binary"
_names = ["block", "part", "query", "ids", "score"]


def _answer(block: int, part: int, score: np.ndarray, ids: np.ndarray, query: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (query, ids, score))], names=_names)


def _scan(k: int, lists: int, cut: bool):
    """Phase 1 over joined rows of a query block and a group; with `cut`, phases 2 and 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["width"], row["q_width"])
                ids, v = _matrix(row, width)
                q_ids, q = _matrix({x: row["q_" + x] for x in ("ids", "width", "wide", "body")}, width)
                ranges = [slice(width * j // lists, width * (j + 1) // lists) for j in range(lists)]
                partial = [_partial(q[:, r], v[:, r]) for r in ranges]
                own = q_ids[:, None] == ids[None, :]
                if cut:
                    least = np.frombuffer(row["cutoff"], np.float64)
                    chosen = np.zeros(own.shape, dtype=bool)
                    for p in partial:
                        chosen |= p >= (least / lists)[:, None]
                elif len(ids) <= k:
                    chosen = np.ones(own.shape, dtype=bool)
                else:
                    chosen = np.zeros(own.shape, dtype=bool)
                    for p in partial:
                        best = np.argpartition(np.where(own, -np.inf, p), -k, axis=1)[:, -k:]
                        np.put_along_axis(chosen, best, True, axis=1)
                at, j = np.nonzero(chosen & ~own)
                score = sum(p[at, j] for p in partial)
                if cut:
                    enough = score >= least[at]
                    at, j, score = at[enough], j[enough], score[enough]
                yield _answer(row["block"], row["part"], *_best(score, ids[j], at, k))

    return run


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("score", "ids", "query")]
        return pa.Table.from_batches([_answer(table.column("block")[0].as_py(), table.column("part")[0].as_py() // FAN, *_best(*parts, k))])

    return run


def _merged(answers: DataFrame, parts: int, k: int) -> DataFrame:
    """One row for each block: at most FAN answers meet in a task at a time."""
    while True:
        answers = answers.groupBy("block", F.floor(F.col("part") / FAN).alias("over")).applyInArrow(_merge(k), ANSWER)
        parts = -(-parts // FAN)
        if parts <= 1:
            return answers


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest whole-number inner products with all other vectors."""
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    groups, parts = _grouped(sound, GROUP, scale)
    groups = store.materialise(groups, "vectors")
    queries, _ = _grouped(sound.where(is_query), BLOCK, scale)
    queries = store.materialise(queries.select(F.col("part").alias("block"), *(F.col(x).alias("q_" + x) for x in ("ids", "width", "wide", "body"))), "queries")

    spread = min(parts, max(SPREAD, 2 * vectors.sparkSession.sparkContext.defaultParallelism))

    def everywhere(block: DataFrame) -> DataFrame:
        # never broadcast: Spark takes the blocks for as small as one copy of them, and that would go through the driver
        copies = block.withColumn("over", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        # partitions of their own, four to a share: few shares meet in one, and they aren't put together by size
        shares = groups.withColumn("over", F.col("part") % spread).repartition(4 * spread, "over")
        return copies.repartition(4 * spread, "over").join(shares.hint("merge"), "over").drop("over")

    first = _merged(everywhere(queries).mapInArrow(_scan(k, lists, False), ANSWER), parts, k)

    def cutoffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cut = []
            for row in rows:
                query, score = np.frombuffer(row["query"], np.int64), np.frombuffer(row["score"], np.int64)
                n = len(row["q_ids"]) // 8
                least = np.full(n, np.inf)
                np.minimum.at(least, query, score.astype(np.float64))
                least[np.bincount(query, minlength=n) < k] = -np.inf
                # a cutoff beyond 2**53 is rounded: down, to stay safe
                cut.append(np.nextafter(least, -np.inf).tobytes() if np.abs(score).max(initial=0) >= 1 << 53 else least.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("block", "q_ids", "q_width", "q_wide", "q_body")), pa.array(cut, pa.binary())], names=["block", "q_ids", "q_width", "q_wide", "q_body", "cutoff"])

    known = queries.join(first.select("block", "query", "score").hint("merge"), "block").mapInArrow(cutoffs, "block int, q_ids binary, q_width int, q_wide boolean, q_body binary, cutoff binary")
    known = store.materialise(known, "cutoffs")
    last = _merged(everywhere(known).mapInArrow(_scan(k, lists, True), ANSWER), parts, k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query, ids, score = (np.frombuffer(row[x], np.int64) for x in ("query", "ids", "score"))
                start = np.searchsorted(query, query)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["q_ids"], np.int64)[query]), pa.array((np.arange(len(query)) - start + 1).astype(np.int32)), pa.array(ids), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])

    return last.join(queries.select("block", "q_ids").hint("merge"), "block").mapInArrow(rows, "query_id long, rank int, vec_id long, score long")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(store.documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e AS q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
