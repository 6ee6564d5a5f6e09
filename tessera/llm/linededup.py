"""Fuzzy line dedup: one line of each group of near-equal lines stays, at its first place in the corpus.

1. Every line has a 64-bit id by its characters, so equal lines are one from the start.
2. A line's set holds its 8-character shingles; a shorter line is its own shingle. One-permutation MinHash over 60 bins, empty
   bins filled from the next full one, gives 12 bands of 5: a pair of Jaccard similarity 0.8 meets in some band with
   probability 1 - (1 - 0.8 ** 5) ** 12 = 0.99, one of 0.9 almost surely.
3. Each line is compared with the smallest id of each of its buckets, by the exact Jaccard similarity of their sets (0.8 or
   more links). Where that leaves a component of lines that share buckets in several groups, its lines meet: all of them in one
   block, or, where they are more than a block takes, in every bucket that holds several groups, in blocks as op2's documents
   do. So every pair that a band found is compared or known to be joined, and only buckets cost a square: components don't,
   which chance matches join to one large component as the corpus grows.
4. Distributed union-find joins the links. Of a component's places (doc_id, hash of the text, line number) the smallest stays, all others go.

Lines end with U+000A. Blank lines (of U+0020 and U+0009 to U+000D) are no lines here and stay. Null text stays null, empty text empty. Rows with equal doc_id
and text count as one document: they keep the same lines. Rows of one doc_id with different texts are documents of their own.
A doc_id that is null takes part like a value of its own and sorts first. Very long texts and lines are taken whole. An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import graph, jaccard, store
from tessera.llm.textkernel import U64, distinct, exact_value, inverse_powers, mix, prefix_hash, scatter, slices, span_hash, text_buffers

SHINGLE, PERCENT = 8, 80
BANDS, ROWS = 12, 5
BINS = BANDS * ROWS
#: Bytes of a line that count as one line in a block.
WEIGHT = 1024
#: Up to so many lines an open component meets as a whole: as many as share a block.
WHOLE = jaccard.BLOCK
#: Components of so many lines at most that share a block are multiplied together, and so many pairs of entries at a time.
FEW, _PAIRS = 32, 1 << 20
#: Stands for an empty bin; the one hash in 2**32 that equals it counts as empty too.
_EMPTY = np.uint32(0xFFFFFFFF)
_SPACES = " \t\n\x0b\x0c\r"
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*map(ord, _SPACES)]] = True


class Lines:
    """The lines of a batch of texts, as spans of its bytes."""

    def __init__(self, texts: pa.Array):
        data, at = text_buffers(texts)
        self.data, self.at = data, at
        self.prefix = prefix_hash(data, exact_value)
        breaks = np.flatnonzero(data == 10)
        # every document has one line more than breaks; a document's end is a line's end
        self.doc = np.sort(np.concatenate([np.searchsorted(at, breaks, side="right") - 1, np.arange(len(at) - 1)]))
        self.start = np.sort(np.concatenate([breaks + 1, at[:-1]]))
        self.end = np.sort(np.concatenate([breaks, at[1:]]))
        first = np.searchsorted(self.doc, np.arange(len(at) - 1))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        self.blank = self.start == self.end
        for k in np.flatnonzero(~self.blank & _BLANK[data[np.minimum(self.start, len(data) - 1)]]).tolist() if len(data) else ():
            self.blank[k] = _BLANK[data[self.start[k] : self.end[k]]].all()
        self.id = span_hash(self.prefix, self.start, self.end).view(np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of all lines, with repeats, and the line of each: SHINGLE characters in a row, or a shorter line."""
        data, n = self.data, len(self.data)
        heads = (data & 0xC0) != 0x80
        if heads.all():
            prefix, inverse, start, end = self.prefix, inverse_powers(n), self.start, self.end
        else:
            # from bytes to characters: only their first bytes count
            rank = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(heads, out=rank[1:])
            place = np.append(np.flatnonzero(heads), n)
            prefix, inverse = self.prefix[place], inverse_powers(n)[place[:-1]]
            start, end = rank[self.start], rank[self.end]
        size = end - start
        count = np.maximum(0, size - SHINGLE + 1)
        # the places, among all characters, where a shingle begins: a line's first ones
        edge = np.zeros(len(prefix) + 1, dtype=np.int8)
        np.add.at(edge, start[count > 0], 1)
        np.add.at(edge, (start + count)[count > 0], -1)
        begins = np.cumsum(edge[: max(0, len(prefix) - SHINGLE)], dtype=np.int8).view(bool)
        hashes = scatter(((prefix[SHINGLE:] - prefix[:-SHINGLE])[: len(begins)] * inverse[: len(begins)])[begins]) if len(begins) else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(start)), count)
        short = np.flatnonzero((size > 0) & (count == 0))
        return np.concatenate([hashes, self.id[short].view(U64)]), np.concatenate([owner, short])


def band_keys(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """BANDS keys for each of n sets, from hashes and the set of each."""
    found = np.full(n * BINS, _EMPTY)
    place = (hashes >> U64(32)) * U64(BINS)
    place >>= U64(32)
    place += (owner * BINS).view(U64)
    np.minimum.at(found, place.view(np.int64), hashes.astype(np.uint32))
    full = found.reshape(n, BINS).astype(U64)
    row, column = np.nonzero(full == U64(_EMPTY))
    original = full.copy()
    for step in range(1, BINS):
        if not len(row):
            break
        value = original[row, (column + step) % BINS]
        ready = value != U64(_EMPTY)
        full[row[ready], column[ready]] = value[ready] + U64(step << 32)
        row, column = row[~ready], column[~ready]
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=U64)[None, :], n, axis=0)
    for k in range(ROWS):
        keys = mix(keys * U64(0x9DDFEA08EB382D69) + full[:, k::ROWS])
    return keys


def _row(text: Column) -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(text.cast("string"))


def _places(docs: DataFrame) -> DataFrame:
    """(id, doc_id, row, line) of every line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = Lines(batch.column(1))
            keep = np.flatnonzero(~lines.blank)
            yield pa.RecordBatch.from_arrays([pa.array(lines.id[keep]), *(batch.column(k).take(pa.array(lines.doc[keep])) for k in (0, 2)), pa.array(lines.number[keep])], names=["id", "doc_id", "row", "line"])

    return docs.mapInArrow(run, "id long, doc_id long, row long, line long")


def _bands(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            keys, ids = [], []
            # texts of ASCII only need no step from bytes to characters, so they go by themselves
            plain = pc.fill_null(pc.string_is_ascii(batch.column(1)), True)
            for piece in slices([batch.filter(plain), batch.filter(pc.invert(plain))], "text", 1 << 18):
                lines = Lines(piece.column(1))
                keep = np.flatnonzero(~lines.blank)
                if len(keep):
                    own, first = np.unique(lines.id[keep], return_index=True)
                    keys.append(band_keys(*lines.shingles(), len(lines.id))[keep[first]])
                    ids.append(own)
            if keys:
                yield graph.star_batch([*graph.star_keys(np.concatenate(keys).ravel(), np.repeat(np.concatenate(ids), BANDS), parts)])

    return docs.mapInArrow(run, graph.STAR_KEYS)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, text) of wanted (id, doc_id, row, line) places, with the sizes of their sets."""
    lists = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = Lines(batch.column(0))
            first = np.searchsorted(lines.doc, np.arange(batch.num_rows + 1))
            asked = batch.column(1)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            line, ids = (asked.flatten().field(k).to_numpy() for k in (0, 1))
            at = first[doc] + line
            sound = at < first[doc + 1]
            at, ids = at[sound], ids[sound]
            at, ids = at[lines.id[at] == ids], ids[lines.id[at] == ids]
            text = [lines.data[s:e].tobytes() for s, e in zip(lines.start[at].tolist(), lines.end[at].tolist(), strict=True)]
            own = pa.array(text, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(x) for x in line_sets(own)], pa.int64()), own], names=["id", "n", "text"])

    # the lists grow with the corpus: never broadcast
    return docs.join(lists.hint("merge"), docs["doc_id"].eqNullSafe(lists["doc_id"]) & (docs["row"] == lists["row"])).select("text", "wanted").mapInArrow(run, "id long, n long, text string")


def line_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, which is a single line."""
    hashes, owner = Lines(texts).shingles()
    # lines shorter than a shingle come last
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    # line by line: many short sorts cost a fraction of one by two keys
    at = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for first, last in zip(at[:-1], at[1:], strict=True):
        hashes[first:last].sort()
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))) if len(texts) else []


def similar(a: pa.Array, b: pa.Array, percent: int = PERCENT) -> np.ndarray:
    """Whether the shingle sets of a[i] and b[i], which are single lines, have Jaccard similarity percent / 100 at least."""
    n = len(a)
    sets = []
    for texts in (a, b):
        hashes, owner = Lines(texts).shingles()
        sets.append(distinct((owner.astype(U64) << U64(44)) | (hashes >> U64(20))))
    both = np.sort(np.concatenate(sets))
    row = (both >> U64(44)).astype(np.int64)
    equal = np.bincount(row[1:][both[1:] == both[:-1]], minlength=n)
    return 100 * equal >= percent * (np.bincount(row, minlength=n) - equal)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 1 << 18):
            ok = pa.array(similar(batch.column(2), batch.column(3)))
            yield batch.select(["a", "b"]).filter(ok)

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _open_members(pairs: DataFrame, grouped: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, root, group, n, weight) of the lines of components of pairs whose lines are in several groups so far, a written table."""
    roots = graph.components(pairs)
    state = roots.join(grouped.withColumnRenamed("root", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    # written, so that the next join deals out both sides anew and a large component can be split
    several = store.materialise(state.groupBy("root").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("root"), "several")
    sizes = texts.groupBy("id").agg(F.first("n").alias("n"), F.ceil(F.first(F.octet_length("text")) / F.lit(WEIGHT)).alias("weight"))
    members = store.materialise(state.join(several.hint("merge"), "root").join(sizes.hint("merge"), "id").select("id", "root", "group", "n", "weight"), "members")
    store.discard(roots, several)
    return members


def _buckets(members: DataFrame, texts: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, root, n, weight), and the written tables behind it: which open lines have to meet. A component that counts as `most` lines at most meets as
    a whole. In a larger one, which chance matches may have joined, a line meets those of its buckets that hold several groups; root is the bucket's key."""
    large = store.materialise(members.groupBy("root").agg(F.sum("weight").alias("load")).where(F.col("load") > most).select("root"), "large")
    if large.isEmpty():
        return members.drop("group"), [large]
    small = members.join(large.hint("merge"), "root", "left_anti").select("id", "root", "n", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            lines = Lines(batch.column(4))
            keys = band_keys(*lines.shingles(), len(lines.id)).view(np.int64).ravel()
            again = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(k).take(again) for k in range(4))], names=["key", "id", "group", "n", "weight"])

    inside = members.join(large.hint("merge"), "root")
    # rows with equal doc_id and text give a line several times
    told = texts.select("id", "text").dropDuplicates(["id"]).join(inside.hint("merge"), "id").select("id", "group", "n", "weight", "text")
    keyed = store.materialise(told.mapInArrow(run, "key long, id long, group long, n long, weight long"), "keyed")
    # buckets of the same lines are one; written, so that the join deals out both sides anew and a large bucket can be split
    held = keyed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = store.materialise(held.where("low <> high").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "buckets")
    return small.unionByName(keyed.join(kept.hint("merge"), "key").select("id", F.col("key").alias("root"), "n", "weight")), [large, keyed, kept]


def few_links(root: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The places of both ends of all links between sets of one root. root rises."""
    _, at, count = np.unique(root, return_inverse=True, return_counts=True)
    own = np.arange(len(root)) - (np.cumsum(count) - count)[at]
    base = (np.cumsum(count**2) - count**2)[at]
    hashes, owner = np.concatenate([*sets, np.zeros(0, U64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    # a hash of its own for each component
    hashes += mix(at.astype(U64))[owner]
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(hashes)))
    # each entry meets those after it that have the same hash
    after = np.repeat(start + size, size) - np.arange(len(hashes)) - 1
    first = np.flatnonzero(after)
    total = np.cumsum(after[first])
    overlap = np.zeros(int((count**2).sum()), dtype=np.int64)
    edges = np.searchsorted(total, np.arange(_PAIRS, int(total[-1]) + _PAIRS, _PAIRS)).tolist() if len(total) else []
    for low, high in zip([0, *edges[:-1]], [*edges[:-1], len(first)], strict=True) if edges else ():
        place, n = first[low:high], after[first[low:high]]
        x = np.repeat(place, n)
        y = x + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + 1
        x, y = owner[x], owner[y]
        x, y = np.minimum(x, y), np.maximum(x, y)
        same = at[x] == at[y]
        if not same.all():
            x, y = x[same], y[same]
        overlap += np.bincount(base[x] + own[x] * count[at[x]] + own[y], minlength=len(overlap))
    found = np.flatnonzero(overlap)
    head = np.cumsum(count) - count
    of = np.searchsorted(np.cumsum(count**2), found, side="right")
    inside = found - (np.cumsum(count**2) - count**2)[of]
    x, y = head[of] + inside // count[of], head[of] + inside % count[of]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    linked = 100 * overlap[found] >= percent * (n[x] + n[y] - overlap[found])
    return x[linked], y[linked]


def meeting_links(ids: np.ndarray, side: np.ndarray, group: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Stars of spanning forests of the links of a block, whose components don't meet each other. Where one has more than FEW lines, those
    of its largest group are joined already and don't meet each other."""
    order = np.argsort(root, kind="stable")
    roots, count = np.unique(root, return_counts=True)
    first = np.cumsum(count) - count
    few = order[np.repeat(count <= FEW, count)]
    x, y = few_links(root[few], [sets[k] for k in few.tolist()])
    x, y = ids[few[x]], ids[few[y]]
    differ = x != y
    found, star = graph.local_components(x[differ], y[differ])
    stars = [(found[found != star], star[found != star])]
    for k in np.flatnonzero(count > FEW).tolist():
        own = order[first[k] : first[k] + count[k]]
        _, at, size = np.unique(group[own], return_inverse=True, return_counts=True)
        rest, left = at != size.argmax(), side[own] == 0
        right = ~left if (~left).any() else left
        for x, y in ((left & rest, right), (left & ~rest, right & rest if right is not left else right & False)):
            x, y = own[x], own[y]
            if len(x) and len(y):
                both = np.concatenate([x, y])
                stars.append(jaccard.block_links(ids[both], np.repeat([0, 1], [len(x), len(y)]), [sets[j] for j in both.tolist()], PERCENT))
    a, b = (np.concatenate([s[k] for s in stars]) for k in (0, 1))
    return a, b


def _block_links(dealt: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Stars of spanning forests of the links of each block."""

    def product(table: pa.Table) -> pa.Table:
        ids, side, group, root = (table.column(x).to_numpy() for x in ("id", "side", "group", "root"))
        a, b = meeting_links(ids, side, group, root, line_sets(table.column("text").combine_chunks()))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    own = texts.select("id", "text").dropDuplicates(["id"]).join(members.select("id", "group").hint("merge"), "id")
    return own.join(dealt.hint("merge"), "id").groupBy("block").applyInArrow(product, "a long, b long")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, lines): the numbers, from 0, of each document's lines that go. row: _row() of its text."""
    store.bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row(F.col("text")).alias("row"))
    parts = graph.part_count(docs)
    # cut into lines twice rather than written: files are dearer than a second pass over the texts
    places = _places(docs)
    firsts = store.materialise(places.groupBy("id").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("n")), "firsts")
    pairs = store.materialise(graph.stars(_bands(docs, parts)).distinct(), "pairs", sweep=True)
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = store.materialise(_texts(docs, firsts.join(asked, "id").select("id", "first.doc_id", "first.row", "first.line")), "lines", sweep=True)
    links = store.materialise(_verified(pairs, texts), "links", sweep=True)
    united = graph.components(links)
    members = _open_members(pairs, united, texts)
    if not members.isEmpty():
        meeting, behind = _buckets(members, texts, WHOLE)
        dealt = jaccard.dealt_blocks(meeting, PERCENT, "root")
        store.discard(*behind)
        more = store.materialise(_block_links(dealt, members, texts), "more", sweep=True)
        led, united = united, graph.components(united.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
        store.discard(led, dealt, more)
    store.discard(pairs, texts, links, members)
    grouped = firsts.join(united, "id", "left")
    # written first, so that the join below deals out both sides anew and a large component can be split
    keepers = store.materialise(grouped.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("keeper")), "roots")
    kept = grouped.where((F.col("n") > 1) | F.col("root").isNotNull()).join(keepers, "root", "left").select("id", F.coalesce("keeper", "first").alias("keeper"))
    kept = store.materialise(kept, "keepers")
    gone = places.join(kept, "id").where(~F.struct("doc_id", "row", "line").eqNullSafe(F.col("keeper")))
    gone = store.materialise(gone.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines")), "gone", sweep=True)
    store.discard(united, keepers, kept, firsts)
    return gone


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with text without the lines that go, and how many lines they had and lost (blank lines aside) in two columns named by `counts`.
    Columns of these two names are replaced."""
    docs = docs.drop(*(x for x in docs.columns if x.lower() in {y.lower() for y in counts}))
    schema = docs.schema
    key, row, off = store.fresh([*docs.columns, *counts], "gone_id", "gone_row", "gone_lines")
    gone = dropped_lines(docs).select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("lines").alias(off))
    text_at = [x.lower() for x in schema.names].index("text")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"`{x}` long" for x in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, schema.names[text_at]):
            out, lines, dropped = [], [], []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(len(schema)).to_pylist(), strict=True):
                split = text.split("\n") if text else []
                out.append("\n".join([x for k, x in enumerate(split) if k not in off]) if gone and (off := set(gone)) else text)
                lines.append(sum(1 for x in split if x.strip(_SPACES)))
                dropped.append(len(gone or ()))
            columns = [*batch.columns[: len(schema)]]
            columns[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*schema.names, *counts])

    joined = docs.join(gone.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(gone[key]) & (_row(docs["text"]) == gone[row]), "left")
    return joined.select(*(docs[f"`{x}`"] for x in schema.names), off).mapInArrow(run, ddl)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(store.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
