"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of an Arrow batch handed to Python. Whole documents travel in it, so it is far below Spark's default of 10,000.
BATCH_ROWS = 512
#: Bytes after which a batch is closed early, where Spark offers that setting.
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for whole long texts; changes no result.

    Results are lazy and read these settings when they run, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's spark.checkpoint.dir. Only a local master, whose executors
    are this machine, may go without it and gets a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxelake-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths handed out in this process, for `clean`.
_PATHS: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        _PATHS.remove(path)
        path = hadoop.Path(path)
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete what operators wrote to the shared folder. Results that were not yet stored read those tables, so call
    it when they have been."""
    _delete(spark, list(_PATHS))


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Delete on leaving the tables written within, but those of the labels in ``keep``, which what follows reads."""
    before = len(_PATHS)
    yield
    _delete(spark, [p for p in _PATHS[before:] if p.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and losing an executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Hot keys are those of more than `HOT_ROWS` rows and of more than a `HOT_KEYS`-th of all, so `HOT_KEYS` at most.
HOT_ROWS, HOT_KEYS = 50_000, 1000
#: Parts over which the rows of a hot key are spread.
SALTS = 1024


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row for each value of ``keys`` and says in ``count`` how many
    rows have it. Both have the keys by the same names, and no other name in common.

    However many rows share a key, no task gets them all. The facts of hot keys, `HOT_KEYS` rows at most whatever the
    tables' sizes, are broadcast; rows of a hot key then go through the join of all others under salts that no fact
    has, spread by a hash of ``spread``. ``count`` is dropped; keys are compared by equality, so null keys have no facts.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    told = [c for c in facts.columns if c not in (*keys, count)]
    pack = lambda name: F.struct(*[F.col(c) for c in told]).alias(name)
    named = lambda df, tag: df.select(*[F.col(k).alias(f"__{tag}_{k}") for k in keys], pack(f"__{tag}"))
    hot, cold = named(facts.filter(F.col(count) > limit), "hot"), named(facts.filter(F.col(count) <= limit), "cold")
    same = lambda tag: [F.col(k) == F.col(f"__{tag}_{k}") for k in keys]
    out = rows.join(F.broadcast(hot), same("hot"), "left")
    out = out.withColumn("__salt", F.when(F.col("__hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    out = out.join(cold.withColumn("__no_salt", F.lit(0).cast("long")), [*same("cold"), F.col("__salt") == F.col("__no_salt")], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("__hot")[c], F.col("__cold")[c]).alias(c) for c in told])
