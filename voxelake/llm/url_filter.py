"""URL filters: longest-prefix rules first, then a Bloom filter cascade over hosts.

Everything here is DataFrame expressions. The cascade's levels alternate: level 1 encodes the listed keys,
level 2 those unlisted keys of the universe that level 1 lets through, level 3 the listed keys that level 2
lets through, and so on until a level lets nothing wrong through. As the levels are built over the complete
key universe of the corpus, membership is exact, and a row is judged by bit tests alone, without a join.

Sizes. Keys are distinct hosts, which grow far slower than rows. A level has ``bits_per_key`` bits for each key
it encodes; `MAX_FILTER_BITS` bounds what is sent to a task. A universe that needs more is cut by a hash of the key
into shards that each have a cascade within the bound; the rows of each shard are then judged in a pass of their own,
so nothing unbounded is ever broadcast and no row is shuffled, whatever share of them one host has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voxelake.llm.common import written

#: 32 MiB over all levels.
MAX_FILTER_BITS = 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest fitting rule, else null. Rules are tried longest first, ties by name."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def _bits(key: Column, level: int, hashes: int, m: int) -> list[Column]:
    """Bit positions of a key: double hashing on two 31-bit halves of one XXH64, so nothing overflows."""
    h = F.xxhash64(key, F.lit(level))
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
    return [(low + high * i) % F.lit(m) for i in range(hashes)]


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``m`` bits as 64-bit words, read through a scalar subquery."""

    words: DataFrame
    m: int
    hashes: int
    number: int

    def has(self, key: Column) -> Column:
        words, out = self.words.scalar(), None
        for bit in _bits(key, self.number, self.hashes, self.m):
            word = F.element_at(words, (F.shiftright(bit, 6) + 1).cast("int"))
            hit = F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = hit if out is None else out & hit
        return out


@dataclass(frozen=True)
class Cascade:
    """Levels over a universe; `contains` is exact for its keys."""

    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """The first level that does not have the key decides; past the last, the last level's own kind does."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 0))
        return out


def _level(keys: DataFrame, count: int, number: int, bits_per_key: int, hashes: int) -> Level:
    m = 64 * max(1, -(-count * bits_per_key // 64))
    bits = keys.select(F.explode(F.array(*_bits(F.col("key"), number, hashes, m))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")
    )
    # words no key touches are zero; the array has m / 64 entries, which MAX_FILTER_BITS bounds
    filled = keys.sparkSession.range(m // 64).withColumnRenamed("id", "slot")
    filled = filled.join(words, F.col("slot") == F.col("at"), "left")
    packed = filled.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("word", F.lit(0)).alias("word")))).alias("w"))
    return Level(written(packed.select(F.col("w.word").alias("words")), f"bloom{number}"), m, hashes, number)


def build_cascade(universe: DataFrame, bits_per_key: int = 10, hashes: int = 6, max_levels: int = 40) -> Cascade | None:
    """The cascade of ``universe`` (key string, listed boolean; a row per key), or None past `MAX_FILTER_BITS`.

    An empty universe or no listed key gives a cascade of no level, which contains nothing. Raises if ``max_levels``
    do not make it exact, which is a matter of too few bits a key: each level lets about a hundredth through.
    """
    universe = written(universe, "keys")
    mine, other = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    levels: list[Level] = []
    count, bits = mine.count(), 0
    while count:
        if (bits := bits + count * bits_per_key) > MAX_FILTER_BITS:
            return None
        if len(levels) == max_levels:
            raise RuntimeError(f"the cascade is not exact after {max_levels} levels: raise bits_per_key")
        levels.append(_level(mine, count, len(levels) + 1, bits_per_key, hashes))
        # the keys of the other kind that this level lets through are what the next one encodes
        mine, other = written(other.filter(levels[-1].has(F.col("key"))), "passed"), mine
        count = mine.count()
    return Cascade(levels)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))


def build_cascades(universe: DataFrame, bits_per_key: int = 10, hashes: int = 6) -> list[Cascade]:
    """One cascade for each shard of `shard_of`, as many as keep each within `MAX_FILTER_BITS`."""
    listed, others = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    # deeper levels encode about a hundredth of the other keys, then of these
    shards = max(1, math.ceil((listed * 1.1 + others * 0.02) * bits_per_key / MAX_FILTER_BITS))
    while True:
        found = []
        for i in range(shards):
            found.append(build_cascade(universe.filter(shard_of(F.col("key"), shards) == i), bits_per_key, hashes))
            if found[-1] is None:
                break
        else:
            return found
        shards *= 2


def filter_urls(pages: DataFrame, rules: list[Rule], listed, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: (``id_col``, host, path, rule, verdict).

    The longest fitting rule gives the verdict; other urls are blocked if and only if their host is a listed key.
    ``listed`` maps a distinct host's column to a boolean column (or is a DataFrame of one string column, the list).
    Null urls and urls without ``://`` have empty host and path, fit only rules with neither, and an empty host is
    a key like any other. Repeated rows are judged alike, each once; extra columns are ignored.
    """
    parts = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("__url"))
    hosts = parts.select(host_of(F.col("__url")).alias("key")).distinct()
    if isinstance(listed, DataFrame):
        keys = listed.select(F.col(listed.columns[0]).alias("key")).distinct()
        universe = hosts.join(keys.withColumn("__in", F.lit(True)), "key", "left")
        universe = universe.select("key", F.coalesce("__in", F.lit(False)).alias("listed"))
    else:
        universe = hosts.select("key", F.coalesce(listed(F.col("key")), F.lit(False)).alias("listed"))
    cascades = build_cascades(written(universe, "universe"))
    judged = parts.select(id_col, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    out = None
    for i, cascade in enumerate(cascades):
        mine = judged.filter(shard_of(host, len(cascades)) == i) if len(cascades) > 1 else judged
        by_list = F.when(cascade.contains(host), F.lit("block")).otherwise(F.lit("allow"))
        mine = mine.select(
            id_col,
            "host",
            "path",
            longest_rule(rules, host, path, lambda r: r.name).alias("rule"),
            F.coalesce(longest_rule(rules, host, path, lambda r: r.verdict), by_list).alias("verdict"),
        )
        out = mine if out is None else out.unionByName(mine)
    return out
