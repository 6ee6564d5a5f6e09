"""Relational steps of file conversion as DataFrame -> DataFrame functions: splits, selections, orders, runs, lookups, unions.

Functions keep to built-in operators, so Catalyst plans them, but for the two whose steps depend on one another (in_order). Windows partition by the container (a document, a batch), which
bounds a task by one container; nothing is ordered over a whole table but for a top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- splits ---------------------------------------------------------------------------------------------------------


def even_split(pages: DataFrame, by: str, order: str, parts: int) -> DataFrame:
    """`part` (from 1): each container's rows in `parts` runs, the first ones longer by one where it doesn't divide."""
    return pages.withColumn("part", F.ntile(parts).over(Window.partitionBy(by).orderBy(order)))


def in_order(rows: DataFrame, by: str, order: list[str], made: str, kind: str, scan: Callable[[], Callable[[tuple], object]]) -> DataFrame:
    """The rows with a column `made` that a scan of each container in its order gives: scan() begins a container, and what it returns
    takes the values of by, `order` and the rest of the columns, row by row. Rows stream by, sorted; a task holds a scan's state only."""
    names = rows.columns
    place = names.index(by)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{made}` {kind}"])
    arrow = {"int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = object(), None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[place] != key:
                    key, step = row[place], scan()
                out.append(step(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*names, made])

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, ddl)


def split_by_size(pages: DataFrame, by: str, order: str, size: str, target: float) -> DataFrame:
    """`part` (from 1): greedy runs whose sizes add up to `target` at most; a row over it stands alone."""

    def scan() -> Callable[[tuple], int]:
        part, total = 0, 0.0

        def step(row: tuple) -> int:
            nonlocal part, total
            part, total = (part, total + row[2]) if part and total + row[2] <= target else (part + 1, row[2])
            return part

        return step

    return in_order(pages.select(by, order, F.col(size).cast("double")), by, [order], "part", "int", scan).select(by, order, "part")


# -- page specs -----------------------------------------------------------------------------------------------------


def spec_pages(spec: Column, total: Column) -> Column:
    """Array of page numbers of a spec such as `3, 7-5, -2, 9-` in its order, repeats kept; null if the spec can't be read or
    names a page beyond the total."""
    tokens = F.filter(F.split(F.trim(spec), r"[,，;；、\s]+"), lambda t: t != "")

    def bounds(t: Column) -> Column:
        first = F.regexp_extract(t, r"^(\d*)(-?)(\d*)$", 1)
        last = F.regexp_extract(t, r"^(\d*)(-?)(\d*)$", 3)
        lone = ~F.contains(t, F.lit("-"))
        a = F.when(first != "", first.try_cast("int")).when(~lone, 1)
        b = F.when(lone, a).when(last != "", last.try_cast("int")).otherwise(total)
        good = t.rlike(r"^\d+$|^\d+-\d*$|^-\d+$") & (a >= 1) & (b >= 1) & (a <= total) & (b <= total)
        return F.when(good, F.sequence(a, b))

    ranges = F.transform(tokens, bounds)
    return F.when((F.size(tokens) > 0) & (total > 0) & ~F.exists(ranges, lambda r: r.isNull()), F.flatten(ranges))


def select_pages(pages: DataFrame, by: str, page: str, spec: Column) -> DataFrame:
    """The pages that a spec names, with `pos` (from 0) in its order; also a reordering. Containers that the spec doesn't fit give no rows; see spec_errors."""
    totals = pages.groupBy(by).agg(F.max(page).alias("_total"))
    wanted = totals.select(by, F.posexplode(spec_pages(spec, F.col("_total"))).alias("pos", page))
    return wanted.join(pages, [by, page])


def spec_errors(pages: DataFrame, by: str, page: str, spec: Column) -> DataFrame:
    """The containers, with their page count, that a spec doesn't fit."""
    totals = pages.groupBy(by).agg(F.max(page).cast("long").alias("total"))
    return totals.where(spec_pages(spec, F.col("total").cast("int")).isNull())


def remove_pages(pages: DataFrame, by: str, page: str, spec: Column) -> DataFrame:
    """What a spec leaves; a container of which nothing would be left, or that the spec doesn't fit, stays whole."""
    totals = pages.groupBy(by).agg(F.max(page).alias("_total"))
    gone = totals.select(by, "_total", F.array_distinct(spec_pages(spec, F.col("_total"))).alias("_gone")).where(F.size("_gone") < F.col("_total"))
    return pages.join(gone.select(by, F.explode("_gone").alias(page)), [by, page], "left_anti")


def insert_blanks(pages: DataFrame, by: str, page: str, after: list[int]) -> DataFrame:
    """Container, new page number and old one (null: blank), with a blank page after each named page; 0 is the front."""
    totals = pages.groupBy(by).agg(F.max(page).alias("_total"))
    blanks = totals.select(by, "_total", F.explode(F.array(*map(F.lit, after))).alias("_at")).where(F.col("_at") <= F.col("_total"))
    both = pages.select(by, F.col(page).cast("double").alias("_o"), F.col(page).alias("old")).unionByName(blanks.select(by, (F.col("_at") + 0.5).alias("_o"), F.lit(None).cast("int").alias("old")))
    return both.select(by, F.row_number().over(Window.partitionBy(by).orderBy("_o")).alias("new"), "old")


def merge_in_order(pages: DataFrame, batch: str, file_order: str, page: str) -> DataFrame:
    """`merged` (from 1): one run of pages for each batch, file after file."""
    return pages.withColumn("merged", F.row_number().over(Window.partitionBy(batch).orderBy(file_order, page)))


def outline_ranges(bookmarks: DataFrame, by: str, page: str, title: str, total: str) -> DataFrame:
    """(by, title, first, last): from each bookmark, counted from 0, to before the next; the first title of a page counts, and
    pages before the first bookmark are a part without a title."""
    own = Window.partitionBy(by).orderBy(page)
    one = bookmarks.groupBy(by, page).agg(F.min(title).alias(title), F.max(total).alias("_total"))
    ranges = one.select(by, title, F.col(page).alias("first"), (F.lead(page).over(own) - 1).alias("_next"), "_total").select(by, title, "first", F.coalesce("_next", F.col("_total") - 1).alias("last"))
    front = one.groupBy(by).agg(F.min(page).alias("_least")).where("_least > 0").select(by, F.lit(None).cast("string").alias(title), F.lit(0).cast(dict(bookmarks.dtypes)[page]).alias("first"), (F.col("_least") - 1).alias("last"))
    return ranges.unionByName(front)


# -- orders, names, duplicates ----------------------------------------------------------------------------------------


def newest(frames: list[DataFrame], added: str, ties: list[str], n: int) -> DataFrame:
    """The n newest rows of a union by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(F.desc(added), *ties).limit(n)


def inherit_batch(links: DataFrame, output: str, group: str) -> DataFrame:
    """Each output's group: that of its inputs if they share one (0 is none), else null."""
    known = F.when(F.col(group) != 0, F.col(group))
    return links.groupBy(output).agg(F.when(F.min(known) == F.max(known), F.min(known)).alias("group_id"))


def unique_names(files: DataFrame, by: str, order: str, name: str, style: str = " (%d)") -> DataFrame:
    """`unique_name`: repeated names of a batch get ` (2)`, ` (3)`, ... before the extension, in order, skipping names that are taken.

    A made name may meet a given one, which then counts as repeated. Each name's next number is remembered, so the work is linear."""

    def scan() -> Callable[[tuple], str | None]:
        taken: set[str | None] = set()
        following: dict[str, int] = {}

        def step(row: tuple) -> str | None:
            given = found = row[2]
            if given is not None and given in taken:
                stem, dot, ext = given.rpartition(".")
                stem, ext = (stem, dot + ext) if stem else (given, "")
                k = following.get(given, 2)
                while (found := stem + style % k + ext) in taken:
                    k += 1
                following[given] = k + 1
            taken.add(found)
            return found

        return step

    return in_order(files.select(by, order, name), by, [order], "unique_name", "string", scan)


def keep_last(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of equal keys the last row."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def best_by(rows: DataFrame, by: str, score: Column, ordinal: str, columns: list[str]) -> DataFrame:
    """Each group's row of the highest score, the first of equal ones: a partial aggregate, no window."""
    best = F.max_by(F.struct(*columns, score.alias("score")), F.struct(score, -F.col(ordinal)))
    return rows.groupBy(by).agg(best.alias("_b")).select(by, "_b.*")


def weighted_mode(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Each group's value of the largest weight, the smallest of equal ones."""
    sums = rows.groupBy(by, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(by).agg(F.max_by(value, F.struct(F.col("_w"), -F.col(value))).alias("mode"), F.max("_w").alias("weight"))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """`upper_median`, the element at size / 2 of the sorted values, and `mean_median`, the mean of the middle two.

    Places come from a sort, which spills, so no group has to fit in memory. Nulls don't count."""
    own = Window.partitionBy(by)
    placed = rows.where(F.col(value).isNotNull()).select(by, value, F.row_number().over(own.orderBy(value)).alias("_k"), F.count("*").over(own).alias("_n"))
    upper, lower = F.floor(F.col("_n") / 2) + 1, F.floor((F.col("_n") - 1) / 2) + 1
    middle = placed.where((F.col("_k") == upper) | (F.col("_k") == lower))
    return middle.groupBy(by).agg(F.max(value).alias("upper_median"), ((F.max(value) + F.min(value)) / 2).alias("mean_median"))


# -- runs and intervals -----------------------------------------------------------------------------------------------


def islands(rows: DataFrame, by: str, order: str, begins: Column) -> DataFrame:
    """`island` (from 1): a row for which `begins` holds starts a new run; the first row always does."""
    own = Window.partitionBy(by).orderBy(order)
    flagged = rows.withColumn("_b", F.when(F.row_number().over(own) == 1, 1).otherwise(F.coalesce(begins.cast("int"), F.lit(0))))
    return flagged.withColumn("island", F.sum("_b").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def previous(column: str, by: str, order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(by).orderBy(order))


def interval_lookup(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str, ordinal: str, value: str, width: float = 1.0) -> DataFrame:
    """Each point with the value of the interval [start, end) that holds it, the last by `ordinal` where several do; null if none does.

    Points and intervals meet by an equi-join on the key and a stretch of time. The stretches of a level are twice as long as those of
    the level below, from `width` seconds or units on; an interval takes the lowest level at which it touches three stretches at most,
    and a point one stretch of every level that intervals take (some fifty at most). So neither long intervals nor keys with many of
    both multiply rows. Repeated points are looked up once and come back as often as they were."""

    def number(c: Column, kind: str) -> Column:
        return F.unix_micros(c.cast("timestamp")) / 1_000_000 if kind.startswith("timestamp") else c.cast("double")

    kind = dict(intervals.dtypes)[start]
    sound = intervals.where(intervals[start] < intervals[end])
    first, last = number(sound[start], kind), number(sound[end], kind)
    level = F.greatest(F.lit(0), F.ceil(F.log2((last - first) / F.lit(width)))).cast("int")
    spread = sound.select(sound[by].alias("iv_by"), sound[start].alias("iv_start"), sound[end].alias("iv_end"), sound[ordinal].alias("iv_ordinal"), sound[value].alias("iv_value"), first.alias("iv_first"), last.alias("iv_last"), level.alias("iv_level"))
    levels = [r[0] for r in spread.select("iv_level").distinct().collect()]
    stretch = lambda c, n: F.floor(c / (F.lit(float(width)) * F.pow(F.lit(2.0), n)))
    spread = spread.withColumn("iv_stretch", F.explode(F.sequence(stretch(F.col("iv_first"), F.col("iv_level")), stretch(F.col("iv_last"), F.col("iv_level")))))
    names = [f"`{c}`" for c in points.columns]
    once = points.groupBy(*names).agg(F.count("*").alias("iv_count"))
    placed = once.withColumn("iv_at", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("iv_place", stretch(number(F.col(at), dict(points.dtypes)[at]), F.col("iv_at")))
    hits = placed.join(spread, (F.col(by) == F.col("iv_by")) & (F.col("iv_at") == F.col("iv_level")) & (F.col("iv_place") == F.col("iv_stretch")) & (F.col(at) >= F.col("iv_start")) & (F.col(at) < F.col("iv_end")), "left")
    found = hits.groupBy(*names, "iv_count").agg(F.max_by("iv_value", "iv_ordinal").alias(value))
    return found.withColumn("iv_count", F.explode(F.sequence(F.lit(1), "iv_count"))).drop("iv_count")


def lookup_by_name(rows: DataFrame, dimension: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """The rows with the value that the dimension has under their name, the last by `order` where it has several; null if it has none."""
    last = dimension.groupBy(F.col(name).alias("by_name")).agg(F.max_by(value, order).alias(value))
    return rows.join(last, rows[name] == last["by_name"], "left").drop("by_name")


def timeline_problems(cues: DataFrame, by: str, order: str, start: str, end: str) -> DataFrame:
    """Counts by container: cues that end before they start, that last no time, and that start before the one before ends."""
    before = F.lag(end).over(Window.partitionBy(by).orderBy(order))
    flagged = cues.select(by, (F.col(end) < F.col(start)).alias("r"), (F.col(end) == F.col(start)).alias("e"), (F.col(start) < before).alias("o"))
    return flagged.groupBy(by).agg(F.count_if("r").alias("reversed"), F.count_if("e").alias("empty"), F.count_if("o").alias("overlapping"))


def cue_ends(cues: DataFrame, by: str, start: str, duration: str, ties: list[str], default_ms: int = 2000) -> DataFrame:
    """`end_ms`: the cue's own duration, else up to the next start, else the default; one millisecond at least."""
    following = F.lead(start).over(Window.partitionBy(by).orderBy(start, *ties))
    return cues.withColumn("end_ms", F.greatest(F.coalesce(F.col(start) + F.col(duration), following, F.col(start) + default_ms), F.col(start) + 1))


def repeated_lines(lines: DataFrame, by: str, page: str, key: Column, least: int = 3, share: float = 0.6) -> DataFrame:
    """(by, key): running heads and feet, i.e. keys on max(least, share of the pages) pages of a container or more."""
    pages = lines.groupBy(by).agg(F.count_distinct(page).alias("_pages"))
    found = lines.groupBy(by, key.alias("key")).agg(F.count_distinct(page).alias("on_pages"))
    return found.join(pages, by).where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("_pages") * share))).select(by, "key", "on_pages")


# -- tables -----------------------------------------------------------------------------------------------------------


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """A union by name, columns in the order in which they first occur, text throughout, gaps empty."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    out = None
    for f in frames:
        text = f.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in f.columns else F.lit("").alias(c) for c in names))
        out = text if out is None else out.unionByName(text)
    return out


def first_seen_columns(cells: DataFrame, by: str, row: str, ordinal: str, key: str) -> DataFrame:
    """(by, key, col_no): the union of keys of a container's rows, in the order of their first occurrence."""
    first = cells.groupBy(by, key).agg(F.min(F.struct(row, ordinal)).alias("_f"))
    return first.select(by, key, (F.row_number().over(Window.partitionBy(by).orderBy("_f")) - 1).alias("col_no"))


def key_join_counts(spine: DataFrame, manifest: DataFrame, by: str, ref: str, ident: str) -> DataFrame:
    """By container: references that are found, unknown references, and entries that nothing refers to."""
    both = spine.select(by, F.col(ref).alias("_k"), F.lit(1).alias("_s")).join(manifest.select(by, F.col(ident).alias("_k"), F.lit(1).alias("_m")), [by, "_k"], "full")
    return both.groupBy(by).agg(F.count_if(F.col("_s").isNotNull() & F.col("_m").isNotNull()).alias("found"), F.count_if(F.col("_m").isNull()).alias("unknown"), F.count_if(F.col("_s").isNull()).alias("unused"))


def every_kind(files: DataFrame, compatibility: DataFrame, batch: str, kind: str, operation: str) -> DataFrame:
    """(batch, operation): operations that take every kind of a batch, by counting matches."""
    kinds = files.select(batch, kind).distinct()
    needed = kinds.groupBy(batch).agg(F.count("*").alias("_n"))
    hits = kinds.join(compatibility, kind).groupBy(batch, operation).agg(F.count("*").alias("_m"))
    return hits.join(needed, batch).where("_m = _n").select(batch, operation)


def archive_plan(entries: DataFrame, archive: str, most_entry: int = 64 << 20, most_total: int = 512 << 20) -> DataFrame:
    """By archive: files, bytes, kept and skipped files, and why the archive is refused as a whole, if it is.

    entries: name, size, is_dir, skip_reason."""
    files = entries.withColumn("_file", ~F.col("is_dir")).withColumn("_why", F.when(F.col("size") > most_entry, "entry_too_large").otherwise(F.col("skip_reason")))
    sums = files.groupBy(archive).agg(
        F.count_if("_file").alias("files"), F.coalesce(F.sum(F.when(F.col("_file"), F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("_file") & F.col("_why").isNull()).alias("kept"), F.count_if(F.col("_file") & F.col("_why").isNotNull()).alias("skipped"),
    )
    return sums.withColumn("refused", F.when(F.col("files") == 0, "only_directories").when(F.col("bytes") > most_total, "too_large").when(F.col("kept") == 0, "nothing_usable"))


def pick_asset(assets: DataFrame, by: str, name: str, size: str, word: str = "release") -> DataFrame:
    """Each release's asset: one whose name has the word before others, then the smallest, then by name."""
    rank = F.struct((~F.contains(F.lower(name), F.lit(word))).alias("other"), F.col(size).alias("size"), F.col(name).alias("name"))
    return assets.groupBy(by).agg(F.min(rank).alias("_b")).select(by, F.col("_b.name").alias(name), F.col("_b.size").alias(size))
