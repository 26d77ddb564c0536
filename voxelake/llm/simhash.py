"""SimHash near-duplicates: pigeonhole blocks over distinct fingerprints, verified Hamming distances, components.

Fingerprints. A shingle of `words` words votes on 64 bits with its XXH64; a bit is set if over half of a text's
shingles set it. One pass over the texts writes (id, fingerprint); everything after works on distinct fingerprints.

Links. Cut in `BLOCKS` blocks, two fingerprints with at most 3 differing bits agree on at least three blocks, so each
choice of three blocks of six is a table, and pairs meet in the bucket of their common 32 bits or so. A bucket of
over `HOT` fingerprints, which a large group of near copies makes, is split again in the same way over the bits it
does not share (16 bits or so are left), and once more if need be (9 bits, so 512 fingerprints at most). Every bucket
that is worked on is bounded, no close pair is lost, and no bucket is cut off. Within a bucket, distances are verified
and only the edges of a spanning star of each of its components leave the task, never all pairs.

Components. Alternating large-star and small-star rounds on the edges, each written to the shared folder, until
nothing changes: a number of rounds that grows with the logarithm of the largest component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxelake.llm.common import join_facts, scratch, tune, written

BLOCKS = 6
#: Fingerprints of a bucket above which it is split again.
HOT = 1024
SEED = 42
#: Shingles hashed at a time; bounds memory, not the text.
CHUNK_SHINGLES = 1 << 16
# fixed value: what separates words
SEPARATORS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and the ASCII controls 9 to 13, A-Z lower-cased."""
    text = ascii_lower(text)
    for c in SEPARATORS[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fingerprint(text: str, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text of no word."""
    import xxhash

    said = words_of(text)
    if not said:
        return 0
    n = max(1, len(said) - words + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK_SHINGLES):
        part = said[at : at + CHUNK_SHINGLES + words - 1]
        shingles = map(" ".join, zip(*(part[i:] for i in range(words)))) if len(part) >= words else [" ".join(part)]  # noqa: B905
        hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (votes * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed integer; null texts as empty ones."""
    kind = docs.schema[id_col].dataType.simpleString()
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


def fingerprinted(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """The rows with all their columns and ``__fp``, as in `fingerprints`."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = np.array([fingerprint(t or "", words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, "__fp"])

    schema = StructType([*docs.schema.fields, StructField("__fp", LongType())])
    return docs.mapInArrow(run, schema)


def split_masks(free: list[int], close: int) -> list[tuple[int, list[int]]]:
    """For each choice of blocks of the free bits that a close pair must agree on: (its mask, the bits then free).

    `BLOCKS` blocks with ``close`` differing bits leave BLOCKS - close blocks untouched.
    """
    blocks = [b.tolist() for b in np.array_split(np.array(free), BLOCKS)]
    out = []
    for chosen in combinations(range(BLOCKS), BLOCKS - close):
        mask = sum(1 << bit for i in chosen for bit in blocks[i])
        out.append((mask, [bit for i, block in enumerate(blocks) if i not in chosen for bit in block]))
    return out


def bucket_masks(level: int, close: int) -> list[int]:
    """Masks of all tables of a level, in order: table t of a level is split into the tables t * k to t * k + k - 1
    of the next, for k choices of blocks."""
    masks = [(0, list(range(64)))]
    for _ in range(level):
        masks = [(mask | more, rest) for mask, free in masks for more, rest in split_masks(free, close)]
    return [mask for mask, _ in masks]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def bucketed(fps: DataFrame, level: int, close: int) -> DataFrame:
    """(fp, tab, bits): ``fps`` (fp, tab of the level above) in every table of this level that is below its own."""
    masks = _signed(bucket_masks(level, close))
    fan = len(split_masks(list(range(64)), close))

    def run(batches):
        steps = np.arange(fan)
        for batch in batches:
            fp, above = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            tab = (above[:, None] * fan + steps).reshape(-1)
            fp = np.repeat(fp, fan)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(tab), pa.array(fp & masks[tab])], names=["fp", "tab", "bits"])

    return fps.mapInArrow(run, "fp long, tab long, bits long")


def bucket_stars(values: np.ndarray, close: int) -> list[tuple[int, int]]:
    """Edges (fingerprint, least of its component) among the distinct values of a bucket, linked at ``close`` bits."""
    values = np.unique(values)
    label = np.arange(len(values))
    unsigned = values.view(np.uint64)
    pairs = []
    for at in range(0, len(values), 256):
        far = np.bitwise_count(unsigned[at : at + 256, None] ^ unsigned[None, :])
        a, b = np.nonzero(far <= close)
        a += at
        pairs.append(np.stack([a[a < b], b[a < b]]))
    a, b = np.concatenate(pairs, axis=1)
    while len(a):
        # least label of both ends, then pointer jumping, until the ends of every pair agree
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_pairs = label[a] != label[b]
        a, b = a[open_pairs], b[open_pairs]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return list(zip(values[moved].tolist(), values[label[moved]].tolist(), strict=True))


def star_edges(buckets: DataFrame, close: int) -> DataFrame:
    """(a, b) with b < a: spanning stars of every bucket. Rows of a bucket arrive one after another."""
    placed = buckets.repartition("tab", "bits").sortWithinPartitions("tab", "bits")

    def run(batches):
        def stars(fp, cuts):
            out = [e for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j - i > 1 for e in bucket_stars(fp[i:j], close)]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            fp, tab, bits = held
            if not len(fp):
                continue
            cuts = np.flatnonzero((tab[1:] != tab[:-1]) | (bits[1:] != bits[:-1])) + 1
            if len(cuts):  # the last bucket may go on in the next batch
                yield from stars(fp, [0, *cuts.tolist()])
                held = [h[cuts[-1] :] for h in held]
        if len(held[0]):
            yield from stars(held[0], [0, len(held[0])])

    return placed.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, close: int = 3, hot: int = HOT) -> DataFrame:
    """Edges (a, b), b < a, that connect all of ``distinct`` (fp) that are linked at ``close`` bits or fewer."""
    rows, found, level = distinct.select("fp", F.lit(0).cast("long").alias("tab")), [], 1
    while True:
        buckets = bucketed(rows, level, close)
        counts = buckets.groupBy("tab", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        counts = written(counts, "buckets")
        # a bucket of one has no pair; the others are few
        shared = join_facts(buckets, counts.withColumn("rows", F.col("n")), ["tab", "bits"], "rows", F.col("fp")).filter("n is not null")
        shared = written(shared.select("fp", "tab", "bits", "n"), "shared")
        # 512 fingerprints at most are in a bucket of the third level
        small = shared if level == 3 else shared.filter(F.col("n") <= hot)
        found.append(star_edges(small.select("fp", "tab", "bits"), close))
        if level == 3 or counts.filter(F.col("n") > hot).isEmpty():
            break
        rows, level = shared.filter(F.col("n") > hot).select("fp", "tab"), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root): every node of ``edges`` (a, b) but the roots, with the least node of its component.

    Large-star: each node links its larger neighbours to its least neighbour. Small-star: each node links its smaller
    neighbours and itself to the least of them. At the fixed point the edges are stars around the least nodes.
    """
    edges = written(edges, "edges")
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least").select("a", F.least("a", "m").alias("m"), "n")
        # the centre of a large star is a hot key
        large = join_facts(both, least, ["a"], "n", F.col("b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a != b").distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        joined = join_facts(large, least, ["a"], "n", F.col("b"))
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select("a", F.col("b").alias("root"))
        state = now


def named_components(prints: DataFrame, close: int, hot: int) -> DataFrame:
    """(fp, first, n, root, component_id) of the distinct fingerprints of ``prints`` (id, fp): the least id that has
    the fingerprint, the rows that have it, and its component's least fingerprint and least id."""
    with scratch(prints.sparkSession, "of_fp"):
        distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
        roots = components(links(distinct.select("fp"), close, hot))
        named = distinct.join(roots, distinct.fp == roots.a, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
        named = written(named, "named")
        least = written(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")), "components")
        return written(join_facts(named, least, ["root"], "prints", F.col("fp")).select("fp", "first", "n", "root", "component_id"), "of_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, close: int = 3, hot: int = HOT) -> DataFrame:
    """(``id_col``, fingerprint, component_id): a row per input row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id reachable over links of at most
    ``close`` differing bits, the row's own included. Null texts count as empty, and texts of no word, fingerprint
    zero, link like any other. A null id is no smallest id, but if a component has only such, its id is null.
    Repeated rows share fingerprint and component. An empty table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "prints")
    # a group of copies is a hot key on the side of the rows
    out = join_facts(prints, named_components(prints, close, hot).select("fp", "n", "component_id"), ["fp"], "n", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, close: int = 3, hot: int = HOT) -> DataFrame:
    """The rows with all their columns that stand for their `near_duplicates` component: those of its smallest id, and
    of the least of this id's fingerprints in the component.

    Rows that repeat an id and a fingerprint are one document and stay together. Of a component that has only null ids
    one row stays. A row stays or goes with its own component, whatever becomes of other rows of its id.
    The kept fingerprints grow with the rows, so they are never broadcast: the join is a merge of unique keys at every
    size.
    """
    rows = written(fingerprinted(docs, text_col, words), "printed")
    of_fp = named_components(rows.select(F.col(id_col).alias("id"), F.col("__fp").alias("fp")), close, hot)
    # a component's least id is the least of some of its fingerprints; the least of those is kept
    kept = of_fp.filter(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("fp").alias("__kept"))
    kept = written(kept.select("__kept", F.col("component_id").alias("__id")), "kept")
    same = (F.col("__fp") == F.col("__kept")) & F.col(id_col).eqNullSafe(F.col("__id"))
    out = rows.join(kept.filter("__id is not null").hint("merge"), same, "left_semi").drop("__fp")
    of_none = rows.filter(F.col(id_col).isNull()).join(kept.filter("__id is null").hint("merge"), same, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = of_none.groupBy("__fp").agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return out.unionByName(one.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
