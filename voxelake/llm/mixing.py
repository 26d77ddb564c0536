"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Rates minimise the token-weighted relative entropy to one copy of everything,

    sum_i size_i * (w_i log w_i - w_i + 1) / tilt_i   subject to   sum_{i in s} size_i * w_i = target_s,  w_i <= cap,

whose dual has one variable a source and gives exponentially tilted rates w_i = min(cap, exp(lambda_s * tilt_i)). The
tilt says how readily a document departs from one copy; by default it falls with the size class (`size_tilt`), so a
source that must grow repeats its short documents more than its long ones, and one that must shrink keeps the long.

The dual's gradient and curvature depend on the documents only through the words of each source at each tilt. Those
sums are taken over all documents in one distributed aggregation (`size_tilt` has 64 values at most, so they are few
rows a source). Each Newton iteration then joins them with the sources' current variables, sums gradient and curvature
over the cluster, and writes the next variables as a table; a bracket safeguards the step, as the cap makes the dual
piecewise smooth. The driver sees one number an iteration, the largest miss.

Rates become copies by error diffusion from large documents to small, within hashed buckets of a source of about
`BUCKET_ROWS` rows, so a source of any size is spread over tasks, and what a bucket misses of its share is
about half of a small document.

Sources themselves, a row each with a name and three numbers, are ranked by name and by ratio in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelake.llm.common import scratch, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 512
#: Iterations at most, and the largest miss of a target, as a share of it, at which they stop.
NEWTON_STEPS, NEWTON_MISS = 60, 1e-10
#: Size class at which the tilt is a half.
HALF_TILT_CLASS = 8
#: Elements of an array that repeats a row.
REPEATS = 1000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the five ASCII controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add ``target`` to ``sources`` (__source, __words, ...; a row a source).

    Sources by code point, null last, get the weights in turn and share ``share`` of all words. A target stops at
    ``cap`` times the source's words, and the excess goes to the others by weight until none is above: a level
    theta with sum(min(weight * theta, cap * words)) = share * all words. Sorted by cap * words / weight, the level
    that holds if just the sources before are capped rises while they are and falls after, so theta is its maximum.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    by_ratio = Window.orderBy("__ratio", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    ranked = sources.withColumn("__rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__most", cap * F.col("__words")).withColumn("__ratio", F.col("__most") / F.col("__weight"))
    ranked = ranked.withColumn(
        "__theta",
        (share * F.sum("__words").over(everything) - before("__most")) / (F.sum("__weight").over(everything) - before("__weight")),
    )
    theta = F.max("__theta").over(everything)
    return ranked.withColumn("target", F.least(F.col("__weight") * theta, F.col("__most"))).drop("__rank", "__weight", "__most", "__ratio", "__theta")


def size_tilt(size: Column) -> Column:
    """1 for a document of no word, and less for each binary digit of its number of words: at most 64 values."""
    digits = F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0))
    return HALF_TILT_CLASS / (HALF_TILT_CLASS + digits.cast("double"))


def balance(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(__source, __lambda): the dual variable of each source by distributed, safeguarded Newton iterations.

    ``cells`` is (__source, __tilt, __mass): the words of a source at a tilt; ``targets`` is (__source, target). A
    target at the cap is met by the variable that caps every document; sources of no words stay at one copy.
    """
    spark, log_cap = cells.sparkSession, math.log(cap)
    cells = written(cells.select("__source", F.col("__tilt").alias("t"), F.col("__mass").cast("double").alias("m")), "cells")
    whole = cells.groupBy("__source").agg(F.min("t").alias("least"), F.sum("m").alias("mass"), F.sum(F.col("m") * F.col("t")).alias("moment"))
    state = targets.join(whole, targets["__source"].eqNullSafe(whole["__source"])).select(
        targets["__source"].alias("__name"), "target", "mass", "moment", (-40 / F.col("least")).alias("low"), (log_cap / F.col("least")).alias("high")
    )
    # the start is exact for a constant tilt and for targets at the cap
    guess = F.log(F.col("target") / F.col("mass")) * F.col("mass") / F.col("moment")
    guess = F.when(F.col("mass") == 0, 0.0).when(F.col("target") >= cap * F.col("mass") * (1 - NEWTON_MISS), F.col("high")).otherwise(F.greatest("low", F.least("high", guess)))
    state = written(state.select("__name", "target", "low", "high", guess.alias("at"), F.lit(1.0).alias("miss")), "dual")
    for _ in range(NEWTON_STEPS):
        if not (state.agg(F.max("miss")).first()[0] or 0.0) > NEWTON_MISS:
            break
        each = cells.join(state, F.col("__source").eqNullSafe(F.col("__name")))
        tilted = F.exp(F.least(F.col("at") * F.col("t"), F.lit(log_cap)))
        slope = F.when(F.col("at") * F.col("t") < log_cap, F.col("m") * F.col("t") * tilted).otherwise(0.0)
        sums = each.groupBy("__name", "target", "low", "high", "at").agg(F.sum(F.col("m") * tilted).alias("got"), F.sum(slope).alias("slope"), F.sum("m").alias("mass"))
        short = F.col("got") < F.col("target")
        sums = sums.withColumn("low", F.when(short, F.col("at")).otherwise(F.col("low"))).withColumn("high", F.when(short, F.col("high")).otherwise(F.col("at")))
        newton = F.col("at") + (F.col("target") - F.col("got")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton >= F.col("low")) & (newton <= F.col("high"))
        miss = F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        # a met target keeps its variable, whatever the others still do
        done = (miss <= NEWTON_MISS) | (F.col("mass") == 0)
        at = F.when(done, F.col("at")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = sums.select("__name", "target", "low", "high", at.alias("at"), F.when(done, 0.0).otherwise(miss).alias("miss"))
        state = written(state, "dual")
    # sums of doubles depend on their order in the last digits; rates must not
    return state.select(F.col("__name").alias("__source"), F.round("at", 12).alias("__lambda"))


def copies_by_key(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    tilt: Column | None = None,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """(id, source, size, times, words, target, rate, copies): a row for each distinct id, source, size and tilt,
    which ``times`` rows have; ``words`` and ``target`` are the source's."""
    sized = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        (word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))).alias("__size"),
        *([] if tilt is None else [tilt.cast("double").alias("__tilt")]),
    )
    with scratch(docs.sparkSession, "sizes", "sources"):
        # the texts are scanned once; all that follows reads this narrow table
        sized = written(sized if tilt is not None else sized.withColumn("__tilt", size_tilt(F.col("__size"))), "sizes")
        cells = written(sized.groupBy("__source", "__tilt").agg(F.sum("__size").alias("__mass"), F.count("*").alias("__n")), "masses")
        sources = cells.groupBy("__source").agg(F.sum("__mass").alias("__words"), F.sum("__n").alias("__rows"))
        sources = written(source_targets(sources, weights, share, cap), "targets")
        dual = balance(cells, sources.select("__source", "target"), cap)
        named = sources.select(F.col("__source").alias("__name"), "__words", "__rows", "target")
        sources = named.join(dual, named["__name"].eqNullSafe(dual["__source"])).select("__name", "__words", "__rows", "target", "__lambda")
        sources = written(sources, "sources")
    rows = sized.groupBy("__source", "__id", "__size", "__tilt").agg(F.count("*").alias("__times"))
    # a row a source: Spark broadcasts it only below its size threshold, else joins by shuffle and splits skew
    rows = rows.join(sources, F.col("__source").eqNullSafe(F.col("__name")))
    rows = rows.withColumn("__rate", F.least(F.lit(float(cap)), F.exp(F.col("__lambda") * F.col("__tilt"))))
    bucket = F.pmod(F.xxhash64("__id", "__size"), F.greatest(F.lit(1), F.ceil(F.col("__rows") / BUCKET_ROWS)))
    doc = F.struct(
        (-F.col("__size")).alias("k"),
        F.xxhash64("__id").alias("h"),
        F.col("__id").alias("id"),
        F.col("__size").alias("size"),
        F.col("__rate").alias("rate"),
        F.col("__times").alias("times"),
    )
    packed = rows.groupBy("__source", "__words", "target", bucket.alias("__bucket")).agg(F.array_sort(F.collect_list(doc)).alias("__docs"))
    floor = "cast(floor(d.rate) as int)"
    wanted = f"greatest({floor}, least({floor} + 1, cast(floor({cap}) as int), cast(floor((d.rate * d.size * d.times + a.owed) / (d.size * d.times) + 0.5D) as int)))"
    copies = f"if(d.size = 0, cast(floor(d.rate + 0.5D) as int), {wanted})"
    diffused = (
        "aggregate(__docs, named_struct('owed', 0D, 'out', cast(array() as array<int>)), (a, d) -> element_at(transform(array("
        f"{copies}), n -> named_struct('owed', a.owed + (d.rate - n) * d.size * d.times, 'out', concat(a.out, array(n)))), 1), a -> a.out)"
    )
    out = packed.withColumn("__copies", F.expr(diffused))
    out = out.select(F.col("__source").alias("source"), F.col("__words").alias("words"), "target", F.explode(F.arrays_zip("__docs", "__copies")).alias("x"))
    doc = F.col("x.__docs")
    return out.select(
        doc["id"].alias("id"), "source", doc["size"].alias("size"), doc["times"].alias("times"), "words", "target", doc["rate"].alias("rate"), F.col("x.__copies").alias("copies")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(``id_col``, size, source_size, target, rate, copies, taken): a row per input row.

    Options: ``source_col``; ``size``, by default the words of ``text``; ``tilt`` (positive), by default `size_tilt`,
    while a constant one gives all documents of a source one rate; ``weights``, ``share`` and ``cap`` as in
    `source_targets`. Null sources are one source, the last. Documents of no words take none but still get copies by
    their rate. Repeated rows of one id, source and size get the same copies. An empty table gives an empty result.
    Reruns agree: ties are broken by hashes of ids, never by row order. Other columns are ignored.
    """
    out = copies_by_key(docs, id_col=id_col, **options)
    # a row per repeat, by two short arrays instead of one that holds all
    out = out.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.col("times") - F.col("__run") * REPEATS))))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target", "rate", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as `mix` gives it copies, with its own columns.

    ``size``, if given, is taken from the columns of ``docs``. Edge cases are those of `mix`. The copies grow with the
    rows, so they are never broadcast: the join is a merge of unique keys at every size.
    """
    keys = copies_by_key(docs, id_col=id_col, source_col=source_col, **options)
    keys = written(keys.select(*[F.col(c).alias(f"__{c}") for c in ("id", "source", "size", "copies")]).filter("__copies > 0"), "copies")
    size = options.get("size")
    own = word_count(F.col("text")) if size is None else size.cast("long")
    joined = docs.withColumn("__own", own).join(
        keys.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__size"))
    )
    names = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*names, F.explode(F.sequence(F.lit(1), "__copies")).alias("__nth")).select(*names)
