"""URL filters by a cascade of Bloom filters, with DataFrame functions only.

Level 0 holds the listed keys. Level 1 holds those other keys of the corpus that level 0 lets through, level 2 the listed
keys that level 1 lets through, and so on, until a level lets no wrong key through. As every key of the corpus was tried
against every level, membership is exact for all of them, and a page is judged by bit tests alone, without a join.

A filter's size follows the number of keys that it holds. It goes to executors as a literal only up to `most_bits`; above
that the listed keys are joined instead, with the same result.

Null urls and urls without "://" have an empty host and path, which no rule fits and no list holds. Repeated rows are judged
alike. An empty table gives an empty result, an empty list lists nothing. Of the pages' columns only the id and the url are used.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store

BITS_PER_KEY, HASHES, MOST_BITS = 16, 6, 1 << 23


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the query and the labels whose hosts are listed (fixed values).
RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `bits` is a power of two, `words` its 64-bit words, as signed numbers."""

    number: int
    bits: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _places(key, self.number, self.bits)]
        held = tests[0]
        for t in tests[1:]:
            held = held & t
        return held


def _places(key: Column, number: int, bits: int) -> list[Column]:
    low = F.lit((1 << 31) - 1)
    a = F.xxhash64(F.lit(2 * number), key).bitwiseAND(low)
    b = F.xxhash64(F.lit(2 * number + 1), key).bitwiseAND(low)
    return [(a + b * k).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)]


def _level(keys: DataFrame, number: int, n: int) -> Level:
    bits = max(64, 1 << (n * BITS_PER_KEY - 1).bit_length())
    at = keys.select(F.explode(F.array(*_places(F.col("key"), number, bits))).alias("at"))
    # at most bits / 64 rows, whose number most_bits bounds
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).collect()
    words = [0] * (bits // 64)
    for row in found:
        words[row["word"]] = row["mask"]
    return Level(number, bits, tuple(words))


def build_cascade(universe: DataFrame, most_bits: int = MOST_BITS) -> list[Level] | None:
    """Levels for a universe of distinct (key, listed boolean); None if a filter would exceed `most_bits`."""
    levels: list[Level] = []
    alive = universe
    while True:
        inside = alive.where(F.col("listed") == (len(levels) % 2 == 0))
        n = inside.count()
        if not n:
            return levels
        if n * BITS_PER_KEY > most_bits:
            return None
        levels.append(_level(inside, len(levels), n))
        alive = alive.where(levels[-1].holds(F.col("key")))


def listed_by(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the number of levels that hold it in a row is odd."""
    out = F.lit(False)
    for k in range(len(levels) - 1, -1, -1):
        out = levels[k].holds(key) & (F.lit(True) if k == len(levels) - 1 else ~out)
    return out


def judge(pages: DataFrame, listed: Column, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", most_bits: int = MOST_BITS) -> DataFrame:
    """Each page's id, host, path, rule and verdict. `listed` says of a host in column `key` whether it is listed.

    The longest rule that fits (by host and path together, then by host) gives the verdict, else the cascade: a listed host is blocked.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    hosts = split.select(F.col("host").alias("key")).distinct()
    universe = store.materialise(hosts.select("key", F.coalesce(listed, F.lit(False)).alias("listed")), "hosts")
    levels = build_cascade(universe, most_bits)
    if levels is None:
        keys = universe.where("listed").select(F.col("key").alias("host"), F.lit(True).alias("is_listed"))
        split = split.join(keys, "host", "left").withColumn("is_listed", F.coalesce(F.col("is_listed"), F.lit(False)))
    else:
        store.discard(universe)
        split = split.withColumn("is_listed", listed_by(levels, F.col("host")))
    name, verdict = F.lit(None).cast("string"), F.when(F.col("is_listed"), "block").otherwise("allow")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = rule.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return split.select(id_column, "host", "path", name.alias("rule"), verdict.alias("verdict"))


def has_label(labels: tuple[str, ...]) -> Column:
    """Whether a host, in column `key`, has one of the labels between its dots."""
    return F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels)))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(store.documents(spark, sf_dir, "pages"), has_label(LISTED_LABELS))


OP5_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT page_id, host, path, CASE
    {"".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}' " for r in sorted(RULES, key=lambda r: -len(r.name)))}
    END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
    {"".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}' " for r in RULES)}
    WHEN list_has_any(string_split(host, '.'), {list(LISTED_LABELS)}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
