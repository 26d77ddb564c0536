"""De-identification of files: read, transform, write, with failures as rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelake.dims import TAG_OF
from voxelake.operators.deid import Plan, deidentify_nested, starter_plan
from voxelake.sources import dicom_file

# fixed values: the named text and whole-number attributes of a dataset
TEXT_NAMES = """PatientName PatientID PatientBirthDate PatientSex StudyInstanceUID SeriesInstanceUID SOPInstanceUID SOPClassUID Modality
StudyDate StudyDescription SeriesDescription AccessionNumber Manufacturer ManufacturerModelName StationName InstitutionName""".split()
INT_NAMES = "SeriesNumber InstanceNumber Rows Columns BitsAllocated".split()


def named_attributes(ds: Column) -> list[Column]:
    """Columns by keyword of a flat dataset: texts default to empty, whole numbers to null, frames to one, the
    transfer syntax to Explicit VR Little Endian."""
    at = lambda k: F.try_element_at(ds, F.lit(TAG_OF[k]))
    texts = [F.coalesce(at(k), F.lit("")).alias(k) for k in TEXT_NAMES]
    numbers = [F.trim(at(k)).try_cast("int").alias(k) for k in INT_NAMES]
    frames = F.coalesce(F.trim(at("NumberOfFrames")).try_cast("int"), F.lit(1)).alias("NumberOfFrames")
    syntax = F.coalesce(F.nullif(at("TransferSyntaxUID"), F.lit("")), F.lit("1.2.840.10008.1.2.1")).alias("TransferSyntaxUID")
    return [*texts, *numbers, frames, syntax]


def anonymize_files(spark: SparkSession, source: str, target: str, plan: Plan | None = None) -> DataFrame:
    """Read all files under ``source``, apply the plan at every level, write what can be written to ``target``.

    Returns (path, name, ok, error, written, shared_name): a row per input file. ``ok`` says that ``written`` is there,
    else ``error`` says why it could not be read or encoded: one bad file fails alone. ``shared_name`` tells base names
    that several inputs have; outputs are named by a hash of their input's path, so none overwrites another, and a task
    that runs twice writes the same files. Each file is read once; the report is kept in ``_report`` of the target.
    """
    dicom_file.register(spark)
    files = spark.read.format("dicom").load(source)
    done = files.withColumn("dataset", deidentify_nested(F.col("dataset"), plan or starter_plan()))
    target = target.rstrip("/")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for path, dataset, pixels, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = None
                if error is None:
                    try:
                        dicom_file.write_file(store, root, name := hashlib.sha256(path.encode()).hexdigest()[:32] + ".dcm", dataset, pixels)
                    except ValueError as problem:
                        name, error = None, str(problem)
                rows.append((path, path.rsplit("/", 1)[-1], error is None, error, name))
            types = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "name", "ok", "error", "written"])

    schema = "path string, name string, ok boolean, error string, written string"
    done.select("path", "dataset", "pixel_data", "error").mapInArrow(write, schema).write.mode("overwrite").parquet(f"{target}/_report")
    report = spark.read.schema(schema).parquet(f"{target}/_report")
    shared = report.groupBy("name").agg((F.count("*") > 1).alias("shared_name"))
    return report.join(shared, "name").select("path", "name", "ok", "error", "written", "shared_name")


def from_event(dataset: Column, identifier: Column) -> Column:
    """The dataset of a service event: its own, else its identifier; an error if it has neither."""
    return F.coalesce(dataset, identifier, F.raise_error(F.lit("the event has neither dataset nor identifier")))
