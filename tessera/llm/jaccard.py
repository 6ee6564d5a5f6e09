"""N-gram Jaccard join: near-duplicate documents by a blocked sparse product of the document-by-shingle incidence matrix.

A document's set holds the hashes of its distinct 5-word shingles (see textkernel.shingle_sets). Two documents link when
100 * |A and B| >= 80 * |A or B|. All steps cover all documents and lose no link:

1. Screen. A column that only one document has cannot add to an overlap, and a link needs ceil(0.8 n) shared columns of each
   side's n. Every slice of documents sends each of its distinct columns once to the part that owns it and is told which of
   them others have. Documents with too few shared columns have no partner.
2. Documents with equal sets form a class with its smallest id; only these go on.
3. Order. For the documents left, columns are ordered by document frequency. Linked documents share one of the first
   n - ceil(0.8 n) + 1 columns of either, so components of documents that share such a column contain all links. The commonest
   columns come last, so a passage that many documents share joins nothing by itself.
4. Product. Within a component, documents are dealt into blocks by size; blocks whose sizes cannot link never meet. A pair of
   blocks multiplies its incidence rows, accumulates overlaps, drops pairs below the bound that the sizes give, and sends a
   spanning forest of its links. Small components share blocks.
5. Links and classes are united by distributed union-find.

Null, empty and blank texts have no shingles and link with nothing. Texts under five words have their whole word sequence as
one shingle. Rows with equal doc_id count as one document, whose links are those of all its texts. Very long texts are taken whole. Null ids are dropped. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import graph, store
from tessera.llm.textkernel import distinct, shingle_sets, slices, text_buffers

WORDS, PERCENT = 5, 80
#: Documents in a block; a component of more is cut into blocks of half that. A document counts as one for every WEIGHT columns it has.
BLOCK, WEIGHT = 1024, 2048
_SLICE = 2 << 20
_LOCAL = 0xFFFF


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def _slice_id() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def _sets_of(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch.column(0).to_numpy(zero_copy_only=False), shingle_sets(*text_buffers(batch.column(1)), words)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes, and the number of the document of each."""
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def row_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(text.cast("string"))


def _screen(docs: DataFrame, parts: int, words: int) -> DataFrame:
    """doc_id, row, n, digest, shared: how many of a document's columns another document has as well. docs: doc_id, text, row."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _slice_id()
        for batch in slices(batches, "text", _SLICE):
            ids, sets = _sets_of(batch, words)
            hashes, doc = _flat(sets)
            order = np.argsort(hashes)
            ranked = hashes[order]
            first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
            single = first & np.concatenate((first[1:], [True])) if len(ranked) else first
            base = np.bincount(doc[order][~single], minlength=len(ids))
            # a column of one document asks for it; one of several is known to be shared and only announced
            owner = np.where(single, doc[order], _LOCAL)[first].astype(np.uint16)
            keys = ranked[first]
            own = batch.column(2).to_numpy(zero_copy_only=False)
            rows = [(number % parts, number, np.concatenate([ids, own]).tobytes(), np.array([len(x) for x in sets], np.int64).tobytes(), b"".join(map(_digest, sets)), base.astype(np.int64).tobytes(), None, None)]
            for part, start, end in graph.cuts(graph.part_of(keys, parts)):
                rows.append((part, number, None, None, None, None, (keys[start:end] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), owner[start:end].tobytes()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "slice", "ids", "n", "digests", "base", "keys", "owners"])
            number += 1

    def reply(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [r for r in rows if r["keys"] is not None]
        out = [(r["slice"], r["ids"], r["n"], r["digests"], r["base"], None) for r in rows if r["keys"] is None]
        keys = np.concatenate([*(np.frombuffer(r["keys"], np.uint32) for r in asked), np.zeros(0, np.uint32)])
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        many = np.zeros(len(keys), dtype=bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        at = 0
        for r in asked:
            owner = np.frombuffer(r["owners"], np.uint16)
            found = owner[many[at : at + len(owner)]]
            at += len(owner)
            found = found[found != _LOCAL]
            if len(found):
                out.append((r["slice"], None, None, None, None, np.sort(found).tobytes()))
        kinds = [pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["slice", "ids", "n", "digests", "base", "found"])

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        shared = np.frombuffer(head["base"], np.int64).copy()
        for r in rows:
            if r["found"] is not None:
                shared += np.bincount(np.frombuffer(r["found"], np.uint16), minlength=len(shared))
        digests = head["digests"]
        return pa.table({
            **dict(zip(("doc_id", "row"), map(pa.array, np.frombuffer(head["ids"], np.int64).reshape(2, -1)), strict=True)), "n": pa.array(np.frombuffer(head["n"], np.int64)),
            "digest": pa.array([digests[k : k + 16] for k in range(0, len(digests), 16)], pa.binary()), "shared": pa.array(shared),
        })

    asked = docs.mapInArrow(ask, "part int, slice long, ids binary, n binary, digests binary, base binary, keys binary, owners binary")
    replies = asked.groupBy("part").applyInArrow(reply, "slice long, ids binary, n binary, digests binary, base binary, found binary")
    return replies.groupBy("slice").applyInArrow(total, "doc_id long, row long, n long, digest binary, shared long")


def _pack(docs: DataFrame, words: int) -> DataFrame:
    """Slices of documents with their sets: slice, ids, at (offsets of the sets), hashes. Only sets of the wanted digest are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _slice_id()
        for batch in slices(batches, "text", _SLICE):
            ids, sets = _sets_of(batch, words)
            wanted = batch.column(2).to_pylist()
            keep = [k for k, x in enumerate(sets) if _digest(x) == wanted[k]]
            sets = [sets[k] for k in keep]
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids[keep].tobytes(), at.tobytes(), _flat(sets)[0].tobytes()))], names=["slice", "ids", "at", "hashes"])
            number += 1

    return docs.mapInArrow(run, "slice long, ids binary, at binary, hashes binary")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["at"], np.int64), np.frombuffer(row["hashes"], np.uint64)


def _prefix_keys(packed: DataFrame, parts: int, percent: int) -> DataFrame:
    """Rows of graph.STAR_KEYS: each document's columns that come first in the order of document frequency."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, count = np.unique(_unpacked(row)[2], return_counts=True)
                rows = [(part, row["slice"], (keys[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), count[s:e].astype(np.uint32).tobytes()) for part, s, e in graph.cuts(graph.part_of(keys, parts))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["part", "slice", "keys", "counts"])

    def reply(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        frequency = np.bincount(at, weights=counts)[at]
        level = np.minimum(255, np.round(8 * np.log2(frequency))).astype(np.uint8)
        ends = np.cumsum([len(x) for x in keys])
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "levels": pa.array([level[e - len(x) : e].tobytes() for x, e in zip(keys, ends, strict=True)], pa.binary())})

    def choose(rows: pa.Table, levels: pa.Table) -> pa.Table:
        kinds = [pa.int32(), *[pa.binary()] * 4]
        out: list[tuple] = []
        for row in rows.to_pylist():
            ids, at, hashes = _unpacked(row)
            level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x["levels"], np.uint8) for x in sorted(levels.to_pylist(), key=lambda x: x["part"]))])
            of = level[np.searchsorted(distinct(hashes), hashes)] if len(hashes) else level
            keys, owners = [], []
            for k in range(len(ids)):
                own, rank = hashes[at[k] : at[k + 1]], of[at[k] : at[k + 1]]
                n, least = len(own), needed(len(own), percent)
                shared = rank > 0
                m = int(shared.sum())
                if m < least:
                    continue
                first = np.lexsort((own[shared], rank[shared]))[: n - least + 1 - (n - m)]
                keys.append(own[shared][first])
                owners.append(np.full(len(first), ids[k]))
            if keys:
                out += graph.star_keys(np.concatenate(keys), np.concatenate(owners), parts)
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["part", "keys", "ids", "a", "b"])

    asked = packed.mapInArrow(ask, "part int, slice long, keys binary, counts binary")
    replies = asked.groupBy("part").applyInArrow(reply, "slice long, part int, levels binary")
    return packed.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(choose, graph.STAR_KEYS)


def dealt_blocks(members: DataFrame, percent: int, *kept: str) -> DataFrame:
    """(id, side, block), a written table: the blocks in which each member of a component meets others. members: id, root, n (size of the set),
    weight (for how many it counts in a block). Columns of members named by `kept` are kept."""
    width = math.log(100 / percent) * 1.0001
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
    own = Window.partitionBy("root")
    near = lambda step: F.coalesce(F.max("blocks").over(own.orderBy("band").rangeBetween(step, step)), F.lit(0))
    shape = members.groupBy("root", "band").agg(F.sum("weight").alias("load")).withColumn("total", F.sum("load").over(own))
    shape = shape.withColumn("blocks", F.ceil(F.col("load") / (BLOCK // 2)).cast("int")).withColumn("above", near(1)).withColumn("below", near(-1))
    # a row for each component and band; written, so that the join deals out both sides anew and a large component can be split
    shape = store.materialise(shape, "shape")
    bins = max(1, -(-(shape.where(F.col("total") <= BLOCK).agg(F.sum("load")).first()[0] or 0) // BLOCK))
    joined = members.join(shape.drop("load").hint("merge"), ["root", "band"])
    small, large = joined.where(F.col("total") <= BLOCK), joined.where(F.col("total") > BLOCK)
    few = small.select("id", F.lit(0).alias("side"), F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(bins))).alias("block"), *kept)
    large = large.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct((F.col("i") > j).cast("int").alias("side"), F.concat_ws("_", F.col("root"), F.col("band"), F.least(F.col("i"), j), F.lit("="), F.greatest(F.col("i"), j)).alias("block"))),
        F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(F.lit(0).alias("side"), F.concat_ws("_", F.col("root"), F.col("band"), F.col("i"), F.lit("<"), j).alias("block")))).otherwise(F.array()),
        F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: F.struct(F.lit(1).alias("side"), F.concat_ws("_", F.col("root"), F.col("band") - 1, j, F.lit("<"), F.col("i")).alias("block")))).otherwise(F.array()),
    )
    dealt = store.materialise(few.unionByName(large.select("id", F.explode(pairs).alias("to"), *kept).select("id", "to.side", "to.block", *kept)), "dealt")
    store.discard(shape)
    return dealt


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the product of two incidence matrices: for each left document its overlaps with all right ones.

    Columns that many documents of both sides have go through dense products, the others through their lists of documents."""
    columns, at = np.unique(np.concatenate([*left, *right, np.zeros(0, np.uint64)]), return_inverse=True)
    n_left = sum(map(len, left))
    l_doc, r_doc = _flat(left)[1], _flat(right)[1]
    l_col, r_col = at[:n_left], at[n_left:]
    l_count, r_count = np.bincount(l_col, minlength=len(columns)), np.bincount(r_col, minlength=len(columns))
    thick = np.flatnonzero(l_count * r_count * 100 > len(left) * len(right))
    place = np.full(len(columns), -1)
    place[thick] = np.arange(len(thick))
    dense = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, len(thick), 2048):
        sides = []
        for n, doc, col in ((len(left), l_doc, place[l_col]), (len(right), r_doc, place[r_col])):
            part = np.zeros((n, min(2048, len(thick) - start)), dtype=np.float32)
            here = (col >= start) & (col < start + part.shape[1])
            part[doc[here], col[here] - start] = 1
            sides.append(part)
        dense += sides[0] @ sides[1].T
    thin = (place[r_col] < 0) & (l_count[r_col] > 0)
    order = np.argsort(r_col[thin], kind="stable")
    listed, begin = r_doc[thin][order], np.searchsorted(r_col[thin][order], np.arange(len(columns) + 1))
    starts = np.concatenate(([0], np.cumsum([len(x) for x in left])))
    for k in range(len(left)):
        own = l_col[starts[k] : starts[k + 1]]
        a, b = begin[own], begin[own + 1]
        size = b - a
        if size.any():
            spread = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield k, dense[k] + np.bincount(listed[spread], minlength=len(right))
        else:
            yield k, dense[k]


def block_links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Stars of a spanning forest of the links between the two sides of a block, or within its only side."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    l_at = [int(k) for k in order if side[k] == 0]
    r_at = [int(k) for k in order if side[k] == 1] or l_at
    left, right = [sets[k] for k in l_at], [sets[k] for k in r_at]
    sizes = np.array([len(x) for x in right], dtype=np.int64)
    a, b = [], []
    for k, overlap in overlaps(left, right):
        n = len(left[k])
        low, high = np.searchsorted(sizes, [needed(n, percent), n * 100 // percent + 1])
        both = overlap[low:high].astype(np.int64)
        found = np.flatnonzero(100 * both >= percent * (n + sizes[low:high] - both)) + low
        b += [ids[r_at[j]] for j in found.tolist()]
        a += [ids[l_at[k]]] * len(found)
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    differ = a != b
    found, root = graph.local_components(a[differ], b[differ])
    return found[found != root], root[found != root]


def _links(packed: DataFrame, dealt: DataFrame, percent: int) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, hashes = _unpacked(row)
                for first in range(0, len(ids), 256):
                    last = min(first + 256, len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first:last]), pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in range(first, last)], pa.binary())], names=["id", "hashes"])

    def product(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        a, b = block_links(table.column("id").to_numpy(), table.column("side").to_numpy(), sets, percent)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return packed.mapInArrow(unpack, "id long, hashes binary").join(dealt, "id").groupBy("block").applyInArrow(product, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row (row_hash of the text), n_shingles, component_id (the smallest doc_id reachable by links, itself included) of every document."""
    store.bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash(F.col("text")).alias("row")).where(F.col("doc_id").isNotNull())
    parts = graph.part_count(docs)
    screened = store.materialise(_screen(docs, parts, words), "screened", sweep=True)
    classes = screened.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("shared").alias("shared"))
    likely = store.materialise(classes.where(F.col("shared") >= F.ceil(F.col("n") * percent / 100)).select(F.col("rep").alias("doc_id"), "digest", "n"), "likely")
    # the list of likely documents grows with the corpus: never broadcast
    packed = store.materialise(_pack(docs.drop("row").join(likely.select("doc_id", "digest").hint("merge"), "doc_id"), words), "packed", sweep=True)
    prefixes = store.materialise(graph.stars(_prefix_keys(packed, parts, percent)), "prefixes", sweep=True)
    roots = graph.components(prefixes)
    members = store.materialise(roots.join(likely.select(F.col("doc_id").alias("id"), "n").hint("merge"), "id").withColumn("weight", F.ceil(F.col("n") / WEIGHT)), "members")
    dealt = dealt_blocks(members, percent)
    links = store.materialise(_links(packed, dealt, percent), "links", sweep=True)
    store.discard(likely, packed, prefixes, roots, members, dealt)
    united = graph.components(links)
    # written first, so that the last join deals out both sides anew and a large class can be split
    of_class = classes.select("digest", "rep").join(united.select(F.col("id").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    of_class = store.materialise(of_class, "classes")
    store.discard(links, united)
    found = screened.where("n > 0").select("doc_id", "row", "n", "digest").join(of_class, "digest").select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(screened.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.documents(spark, sf_dir)).drop("row")
