"""A medical-imaging projection of relational order tables: studies, instances, pixel metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelake.dims import TAG_OF
from voxelake.session import table

STUDY_ROOT, SERIES_ROOT, INSTANCE_ROOT = (f"1.2.826.0.1.3680043.8.498.{i}." for i in (1, 2, 3))
MODALITIES = {"1": ("CT", "1.2.840.10008.5.1.4.1.1.2"), "2": ("MR", "1.2.840.10008.5.1.4.1.1.4"), "3": ("US", "1.2.840.10008.5.1.4.1.1.6.1"), "4": ("CR", "1.2.840.10008.5.1.4.1.1.1"), "5": ("SC", "1.2.840.10008.5.1.4.1.1.7")}
BITS = (8, 16, 24, 32, 16, 8, 1)
SYNTAXES = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.90", "1.2.840.10008.1.2.5", "1.2.3.4")


def text(root: str, *parts) -> Column:
    """``root`` and the parts, dots between them."""
    return F.concat(F.lit(root), F.concat_ws(".", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def by_priority(i: int) -> Column:
    """Modality (0) or SOP class (1) of an order's priority."""
    digit = F.substring("o_orderpriority", 1, 1)
    out = F.lit(None).cast("string")
    for key, pair in MODALITIES.items():
        out = F.when(digit == key, F.lit(pair[i])).otherwise(out)
    return out


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, with its patient from the customer table (an equi-join that Spark plans by size)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey",
        F.concat(F.lit("MRN-"), F.col("o_custkey").cast("string")).alias("PatientID"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit("^")).alias("PatientName"),
        text(STUDY_ROOT, "o_orderkey").alias("StudyInstanceUID"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("StudyDate"),
        by_priority(0).alias("Modality"),
        by_priority(1).alias("SOPClassUID"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("absent")).when(F.col("o_orderkey") % 7 == 0, F.lit("empty")).otherwise(F.lit("filled")).alias("accession_state"),
    )


def study_dataset() -> Column:
    """The attribute map of a `studies` row: the accession number is absent, empty or filled."""
    col = lambda k: F.struct(F.lit(TAG_OF[k]).alias("key"), F.col(k).alias("value"))
    fixed = F.array(*[col(k) for k in ("SOPClassUID", "StudyDate", "Modality", "PatientName", "PatientID", "StudyInstanceUID")])
    number = F.when(F.col("accession_state") == "empty", F.lit("")).otherwise(F.concat(F.lit("ACC"), F.col("o_orderkey").cast("string")))
    extra = F.array(F.struct(F.lit(TAG_OF["AccessionNumber"]).alias("key"), number.alias("value")), F.struct(F.lit("00111001").alias("key"), F.lit("private").alias("value")))
    here = F.filter(extra, lambda e: (e["key"] == "00111001") & (F.col("o_orderkey") % 2 == 1) | (e["key"] != "00111001") & (F.col("accession_state") != "absent"))
    return F.map_from_entries(F.concat(fixed, here))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, with its identifiers and pixel metadata."""
    line = table(spark, sf_dir, "lineitem")
    at = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) - 1).cast("int") % len(values) + 1)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    bits = at(BITS, "l_linenumber")
    return line.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        cents.alias("cents"),
        text(INSTANCE_ROOT, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents).alias("SOPInstanceUID"),
        text(SERIES_ROOT, "l_orderkey", "l_suppkey").alias("SeriesInstanceUID"),
        at(SYNTAXES, "l_linenumber").alias("TransferSyntaxUID"),
        F.lit(1).alias("SamplesPerPixel"),
        F.col("l_quantity").cast("int").alias("Rows"),
        (F.col("l_quantity").cast("int") % 7).alias("Columns"),
        bits.alias("BitsAllocated"),
        bits.alias("BitsStored"),
        (bits - F.when(F.col("l_returnflag") == "R", 2).otherwise(1)).alias("HighBit"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("PixelRepresentation"),
        F.when(F.col("l_returnflag") == "A", "MONOCHROME1").otherwise("MONOCHROME2").alias("PhotometricInterpretation"),
        (F.col("l_linenumber").cast("int")).alias("NumberOfFrames"),
        F.lit(None).cast("int").alias("PlanarConfiguration"),
    )


PIXEL_KEYS = ("SamplesPerPixel", "Rows", "Columns", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation", "PhotometricInterpretation", "NumberOfFrames", "PlanarConfiguration")


def pixel_fields() -> dict[str, Column]:
    return {k: F.col(k) for k in PIXEL_KEYS}
