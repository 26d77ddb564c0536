"""Approximate nearest neighbours by a hash-prefix forest.

A tree turns vectors by two random rotations and names each by a string of `SYMBOLS` symbols: the coordinate it is
largest in, with its sign; then the same within groups of `GROUP` coordinates of the second rotation; then signs of
single coordinates. Vectors of small angles share long prefixes. A tree is the sorted array of its strings.

A query descends every tree to its longest prefix match and then ascends all trees at the same pace: prefixes are
shortened by one symbol in all trees, tree by tree, until their matches are about `enough` distinct rows. So a match
in a dense region has a long prefix and one in a sparse region a short one. The candidates are then compared exactly,
by double-precision inner products of the original vectors, summed from the first component to the last.

The stated queries meet all rows in blocks: a block of about `BLOCK_ROWS` rows has its own forest, which is built
once and which all queries stream through in batches, so a task holds one block however many rows, queries or copies
of a vector there are. Rows are shuffled once, queries once a block of rows. Rows of equal id and vector are one row
with a count, and rows fall into blocks by hash. Only the best ``k`` of each query and block leave it.

For inner products of vectors of unequal lengths, a block's vectors get one more coordinate that makes them all as
long as its longest (queries get zero there), so that the angle orders as the product does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxelake.llm.common import tune, written

TREES = 200
SYMBOLS = 32
#: Coordinates that the first symbol chooses from at most; groups that later symbols stand for, and their coordinates.
FIRST, GROUPS, GROUP = 64, 3, 8
#: Candidates sought in a block of n rows for k neighbours: this many times k ** 0.5 * n ** 0.75,
#: and 10 * k at least.
EFFORT = 0.55
BLOCK_ROWS = 16384
#: Queries answered at a time.
BATCH_QUERIES = 256


def enough_of(rows: int, k: int) -> int:
    """Distinct candidates that the ascent gathers in a block of so many rows."""
    return min(rows, max(10 * k, math.ceil(EFFORT * math.sqrt(k) * rows**0.75)))


class Hashes:
    """The hash strings of one dimension, as integers whose highest bits are the first symbol; the same everywhere."""

    def __init__(self, dim: int, trees: int):
        rng = np.random.default_rng(dim)
        first = min(dim, FIRST)
        self.groups = [range(a, min(a + GROUP, first)) for a in range(0, min(first, GROUPS * GROUP), GROUP)]
        turn = lambda n: np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :n].astype(np.float32)
        self.rotations = [(turn(first), turn(self.groups[-1].stop)) for _ in range(trees)]
        wide = (2 * first - 1).bit_length()
        singles = min(first, SYMBOLS - 1 - len(self.groups))
        bits = [wide] + [(2 * len(g) - 1).bit_length() for g in self.groups] + [1] * singles
        #: How far a prefix of so many symbols is shifted to the right, by its length.
        self.shifts = [sum(bits)] + [sum(bits[n:]) for n in range(1, len(bits) + 1)]
        self.bits = bits

    @staticmethod
    def largest(y: np.ndarray) -> np.ndarray:
        """Twice the place of the largest coordinate, and one more if it is negative."""
        at = np.abs(y).argmax(1)
        return 2 * at + (y[np.arange(len(y)), at] < 0)

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        one, two = (x @ r for r in self.rotations[tree])
        symbols = [self.largest(one), *(self.largest(two[:, g.start : g.stop]) for g in self.groups)]
        symbols += [one[:, i] < 0 for i in range(len(self.bits) - len(symbols))]
        out = np.zeros(len(x), np.int64)
        for symbol, bits in zip(symbols, self.bits, strict=True):
            out = out << bits | symbol
        return out


class Forest:
    """Trees over the vectors of a block."""

    def __init__(self, x: np.ndarray, trees: int = TREES):
        square = (x * x).sum(1)
        self.x, self.longest = x, float(np.sqrt(square.max()))
        full = np.hstack([x, np.sqrt(np.maximum(0, self.longest**2 - square))[:, None]]) / self.longest
        full = full.astype(np.float32)
        self.hashes = Hashes(full.shape[1], trees)
        self.keys = np.empty((trees, len(x)), np.int64)
        self.order = np.empty((trees, len(x)), np.int32)
        for t in range(trees):
            key = self.hashes.strings(full, t)
            self.order[t] = np.argsort(key, kind="stable")
            self.keys[t] = key[self.order[t]]

    def ranges(self, strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the sorted rows that share the query's first ``lengths`` symbols: from, up to."""
        shift = np.array(self.hashes.shifts)[lengths]
        low, high = np.empty(strings.shape, np.int64), np.empty(strings.shape, np.int64)
        for t, keys in enumerate(self.keys):
            first = strings[t] >> shift << shift
            low[t] = keys.searchsorted(first)
            high[t] = keys.searchsorted(first | ((1 << shift) - 1), "right")
        return low, high

    def longest_matches(self, strings: np.ndarray) -> np.ndarray:
        """For each query the symbols of its longest prefix match in any tree."""
        found = np.full(strings.shape[1], self.hashes.shifts[0], np.int64)
        for t, keys in enumerate(self.keys):
            at = np.searchsorted(keys, strings[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(keys) - 1)):
                # the bits below the highest differing one are no match
                _, exponent = np.frexp((keys[near] ^ strings[t]).astype(np.float64))
                found = np.minimum(found, exponent)
        return (np.array(self.hashes.shifts[1:])[None, :] >= found[:, None]).sum(1)

    def rows_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The distinct rows of one range a tree."""
        n = high - low
        starts = np.repeat(low + np.arange(len(low)) * len(self.x) - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        mark = np.zeros(len(self.x), bool)
        mark[self.order.reshape(-1)[starts + np.arange(len(starts))]] = True
        return np.flatnonzero(mark)

    def candidates(self, queries: np.ndarray, enough: int, own: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """For each query the rows that the ascent gathers, without those in ``own``, which do not count.

        Of the matches of all trees so many are distinct as are expected of random ones, so the ascent stops where
        their sum says ``enough``, or further up if less than half of that are rows of others. The sum only grows on
        the way up, so the length where it stops is found by bisection.
        """
        total = len(self.x)
        if enough >= total:
            for i in range(len(queries)):
                yield self.without(np.arange(total), own, i)
            return
        unit = queries / np.sqrt((queries * queries).sum(1))[:, None]
        unit = np.hstack([unit, np.zeros((len(unit), 1))]).astype(np.float32)
        strings = np.stack([self.hashes.strings(unit, t) for t in range(len(self.keys))])
        # no more than all rows of each tree, which is what the empty prefix matches
        wanted = min(total * -math.log(1 - enough / total), total * len(self.keys))
        top = self.longest_matches(strings)
        length = np.zeros_like(top)
        while (length < top).any():
            middle = (length + top + 1) // 2
            low, high = self.ranges(strings, middle)
            reached = (high - low).sum(0) >= wanted
            length, top = np.where(reached, middle, length), np.where(reached, top, middle - 1)
        low, high = self.ranges(strings, length)
        low_before, high_before = self.ranges(strings, np.minimum(length + 1, len(self.hashes.shifts) - 1))
        for i in range(len(queries)):
            # trees beyond the one that brings enough keep prefixes of one symbol more
            before = high_before[:, i] - low_before[:, i]
            more = np.cumsum(high[:, i] - low[:, i] - before) + before.sum()
            stop = int(np.searchsorted(more, wanted)) + 1
            lo, hi = (np.concatenate((up[:stop, i], down[stop:, i])) for up, down in ((low, low_before), (high, high_before)))
            at = self.without(self.rows_of(lo, hi), own, i)
            others = total - (len(own[i]) if own else 0)
            while len(at) < min(enough / 2, others) and length[i] > 0:
                length[i] -= 1
                lo, hi = self.ranges(strings[:, [i]], length[[i]])
                at = self.without(self.rows_of(lo[:, 0], hi[:, 0]), own, i)
            yield at

    @staticmethod
    def without(at: np.ndarray, own: list[np.ndarray] | None, i: int) -> np.ndarray:
        return np.setdiff1d(at, own[i], assume_unique=True) if own and len(own[i]) else at

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, enough: int, counts: np.ndarray | None = None):
        """(query id, row id, score) of each query's best k by score, then id; never a row with the query's own id.

        ``counts`` says how often each row is there, once if not given.
        """
        by_id = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids, query_ids, side, sorter=by_id) for side in ("left", "right"))
        own = [by_id[a:b] for a, b in zip(first, last, strict=True)]
        for i, at in enumerate(self.candidates(queries, enough, own)):
            if not len(at):
                continue
            q = queries[i]
            score = self.x[at] @ q
            if len(at) > k:
                # the product's rounding depends on how many rows are taken together: what it may hide stays in
                slack = 4 * len(q) * np.finfo(np.float64).eps * self.longest * float(np.sqrt(q @ q))
                at = at[score >= np.partition(score, len(score) - k)[len(score) - k] - slack]
            score = np.zeros(len(at))
            for component, factor in zip(self.x[at].T, q, strict=True):
                score += component * factor
            best = np.lexsort((ids[at], -score))[:k]
            if counts is not None:
                best = np.repeat(best, np.minimum(counts[at[best]], k))[:k]
            yield np.full(len(best), query_ids[i]), ids[at[best]], score[best]


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", enough: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id is divisible by ``every``.

    ``enough`` is the number of candidates sought in a block, by default `enough_of` its rows.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows of null id, take no part;
    vectors are compared with those of their own dimension only. Rows that repeat a query's id are its own and never
    its candidates; if such rows differ, the least vector is the query. Other repeated rows are candidates each. Ties
    go to the smaller id. An empty table gives an empty result; other columns are ignored.
    """
    spark = tune(vectors.sparkSession)
    v = F.col("v")
    usable = F.col("id").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(usable)
    # a row repeated any number of times is one row of a block
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("n"))
    rows = written(rows.withColumns({"v": v.cast("array<double>"), "dim": F.size("v")}), "vectors")
    # a row a dimension; the driver takes the sum alone
    sizes = written(rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "sizes")
    total = sizes.agg(F.sum("blocks")).first()[0]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, blocks = rows.join(sizes, "dim"), F.col("blocks")
    placed = rows.select("dim", F.pmod(F.xxhash64("id", "v"), blocks).alias("block"), F.lit(False).alias("asks"), "id", "v", "n")
    queries = rows.filter(F.col("id") % every == 0).groupBy("dim", "blocks", "id").agg(F.min("v").alias("v"))
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("asks"), "id", "v", F.lit(1).cast("long").alias("n"))
    # a block's rows come first, then its queries
    # three partitions a block, so that hashing rarely puts two blocks into one
    met = placed.unionByName(asked).repartition(3 * total, "dim", "block").sortWithinPartitions("dim", "block", "asks", "id")

    def run(batches):
        def table(parts):
            held = pa.Table.from_batches(parts).combine_chunks()
            flat = held.column("v").combine_chunks().flatten().to_numpy()
            return held.column("id").to_numpy(), flat.reshape(held.num_rows, -1), held.column("n").to_numpy()

        def answers(forest, ids, counts, query_ids, q):
            seek = enough_of(len(ids), k) if enough is None else min(enough, len(ids))
            for at in range(0, len(q), BATCH_QUERIES):
                parts = list(forest.nearest(q[at : at + BATCH_QUERIES], query_ids[at : at + BATCH_QUERIES], ids, k, seek, counts))
                if parts:
                    a, b, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

        now, parts, forest = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a == b:
                    continue
                if tuple(key[a, :2]) != now:
                    now, parts, forest = tuple(key[a, :2]), [], None
                piece = batch.slice(a, b - a)
                if not key[a, 2]:
                    parts.append(piece)
                elif parts:
                    if forest is None:
                        ids, x, counts = table(parts)
                        forest = Forest(x)
                    query_ids, q, _ = table([piece])
                    yield from answers(forest, ids, counts, query_ids, q)

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
