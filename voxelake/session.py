"""Session construction and table loading shared by every module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine's expressions rely on; none of them changes a plan's parallelism.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # rows alone do not bound a batch that goes to Python: 10,000 long texts are gigabytes
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def get_session(app: str = "voxelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings. ``master`` defaults to the cluster's own, or local[*]."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for key, value in (REQUIRED_CONF | conf).items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to a session that somebody else made."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the reader prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out over all cores, several tasks each, for work that takes long a row: a small table is one
    task otherwise. The rows are shuffled, so they should be narrow. Rows of equal ``keys``, if given, stay together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names}
