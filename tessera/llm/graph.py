"""Distributed union-find, and stars of equal keys through packed exchanges.

Edges are contracted where they lie: each task keeps a union-find forest of its own edges and gives a star for each tree.
An id that several tasks gave different roots joins these roots by an edge of the next level, whose nodes are roots only, so
levels shrink fast; a level of few edges is contracted by one task, whose size that number bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import store

#: A forest of more nodes is given out and begun anew. A level whose edges cannot have more nodes is contracted by one task.
MOST_NODES = 2_000_000
LAST_LEVEL = MOST_NODES // 2


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of the edges, and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[left], root[right]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            return ids, ids[root]
        left, right = left[open_], right[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            over = root[root]
            if np.array_equal(over, root):
                break
            root = over


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = root = np.zeros(0, dtype=np.int64)

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["id", "root"])

    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        ids, root = local_components(np.concatenate([ids, a]), np.concatenate([root, b]))
        if len(ids) > MOST_NODES:
            yield given()
            ids = root = np.zeros(0, dtype=np.int64)
    yield given()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id of the edges, a written table: root is the smallest id of its component. Equal and repeated edges do no harm."""
    levels: list[DataFrame] = []
    written: list[DataFrame] = []
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    if edges.count() <= LAST_LEVEL:
        return store.materialise(edges.coalesce(1).mapInArrow(_contract, "id long, root long"), "components")
    while True:
        stars = store.materialise(edges.mapInArrow(_contract, "id long, root long"), "stars")
        best = stars.groupBy("id").agg(F.min("root").alias("root"))
        written.append(stars)
        if levels:
            # written, so that the joins below deal out both sides anew and a large component can be split
            best = store.materialise(best, "level")
            written.append(best)
        levels.append(best)
        own = best.select(F.col("id"), F.col("root").alias("b"))
        edges = store.materialise(stars.join(own, "id").where("root <> b").select(F.col("root").alias("a"), "b").distinct(), "conflicts")
        written.append(edges)
        n = edges.count()
        if not n:
            break
        if n <= LAST_LEVEL:
            edges = edges.coalesce(1)
    out = levels[0]
    for level in levels[1:]:
        above = level.select(F.col("id").alias("root"), F.col("root").alias("over"))
        out = out.join(above, "root", "left").select("id", F.coalesce("over", "root").alias("root"))
    out = store.materialise(out, "components")
    store.discard(*written)
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key by its high bits: rising keys have rising parts."""
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of the runs of a sorted array."""
    if not len(part):
        return
    start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    yield from zip(part[start].tolist(), start.tolist(), [*start[1:].tolist(), len(part)], strict=True)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[first], b[first]


STAR_KEYS = "part int, keys binary, ids binary, a binary, b binary"


def star_keys(keys: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of STAR_KEYS for one slice: equal keys are joined here, and each key goes on once, with its smallest id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    leader = ids[first][np.cumsum(first) - 1]
    differ = ids != leader
    pairs = distinct_pairs(ids[differ], leader[differ])
    keys, ids = keys[first], ids[first]
    for k, (part, start, end) in enumerate(cuts(part_of(keys, parts))):
        a, b = (x[: len(x) * (not k)] for x in pairs)
        yield part, (keys[start:end] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ids[start:end].tobytes(), a.tobytes(), b.tobytes()


def star_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "keys", "ids", "a", "b"])


def _meet(table: pa.Table) -> pa.Table:
    def joined(column: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in table.column(column).to_pylist()])

    keys, ids = joined("keys", np.uint32), joined("ids", np.int64)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    leader = ids[first][np.cumsum(first) - 1]
    differ = ids != leader
    a, b = distinct_pairs(np.concatenate([ids[differ], joined("a", np.int64)]), np.concatenate([leader[differ], joined("b", np.int64)]))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def stars(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from rows of STAR_KEYS: every id of a key with the key's smallest id, each pair once a part."""
    return rows.groupBy("part").applyInArrow(_meet, "a long, b long")


def part_count(texts: DataFrame, column: str = "text", megabytes: int = 4) -> int:
    """How many parts an exchange takes: one for every `megabytes` of text, 32 at least."""
    size = texts.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(32, -(-size // (megabytes << 20)))
