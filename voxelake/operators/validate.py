"""Validation of datasets: general issues, and mandatory attributes by SOP class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxelake.dims import IOD_PROFILES, TAG_OF, dim_iod
from voxelake.functions.pixels import metadata_error
from voxelake.functions.tags import let, tag_label

PIXEL_FIELDS = ("SamplesPerPixel", "Rows", "Columns", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation")


def blank(ds: Column, tag: str) -> Column:
    """Absent, null or nothing but blanks."""
    return F.coalesce(F.trim(F.try_element_at(ds, F.lit(tag))), F.lit("")) == ""


def pixel_columns(ds: Column) -> dict[str, Column]:
    """Integer columns of the pixel metadata, by keyword; what is missing or no integer is null."""
    whole = lambda k: F.try_element_at(ds, F.lit(TAG_OF[k])).try_cast("int")
    out = {k: whole(k) for k in (*PIXEL_FIELDS, "PlanarConfiguration")}
    out["NumberOfFrames"] = F.coalesce(whole("NumberOfFrames"), F.lit(1))
    out["PhotometricInterpretation"] = F.try_element_at(ds, F.lit(TAG_OF["PhotometricInterpretation"]))
    return out


def pixel_error(ds: Column) -> Column:
    """The first thing wrong with the pixel metadata: a missing or unreadable field, else a violated rule. The map is
    made once a row, and each field of it found and read once."""
    texts = (*PIXEL_FIELDS, "PlanarConfiguration", "NumberOfFrames", "PhotometricInterpretation")
    found = lambda ds: F.struct(*[F.try_element_at(ds, F.lit(TAG_OF[k])).alias(k) for k in texts])
    whole = lambda raw: F.struct(*[raw[k].try_cast("int").alias(k) for k in texts[:-1]])
    return let(let(ds, found), lambda raw: let(whole(raw), lambda n: _pixel_error(raw, n)))


def _pixel_error(raw: Column, whole: Column) -> Column:
    out = F.lit(None).cast("string")
    several = whole["SamplesPerPixel"] > 1
    # fixed values: the message texts; planes must be told of pixels of several samples, right after their number
    for k in reversed((PIXEL_FIELDS[0], "PlanarConfiguration", *PIXEL_FIELDS[1:], "PhotometricInterpretation")):
        asked = several if k == "PlanarConfiguration" else F.lit(True)
        label = f"({TAG_OF[k][:4]},{TAG_OF[k][4:]})"
        out = F.when(asked & raw[k].isNull(), F.lit(f"Required pixel metadata tag {k} {label} is missing.")).otherwise(out)
        if k != "PhotometricInterpretation":
            bad = asked & raw[k].isNotNull() & whole[k].isNull()
            out = F.when(bad, F.concat(F.lit(f"Pixel metadata tag {label} must be an integer, got '"), raw[k], F.lit("'."))).otherwise(out)
    fields = {k: whole[k] for k in (*PIXEL_FIELDS, "PlanarConfiguration")}
    fields |= {"NumberOfFrames": F.coalesce(whole["NumberOfFrames"], F.lit(1)), "PhotometricInterpretation": raw["PhotometricInterpretation"]}
    return F.coalesce(out, metadata_error(fields))


def dataset_issues(ds: Column) -> Column:
    """Messages of general issues, in order."""
    rules = [F.when(blank(ds, TAG_OF[k]), F.lit(f"Missing required tag {k} ({TAG_OF[k][:4]},{TAG_OF[k][4:]}).")) for k in ("SOPClassUID", "SOPInstanceUID", "Modality")]
    rules.append(F.when(F.try_element_at(ds, F.lit(TAG_OF["TransferSyntaxUID"])).isNull(), F.lit("TransferSyntaxUID (0002,0010) is absent. File meta information may be missing or incomplete.")))
    rows = F.try_element_at(ds, F.lit(TAG_OF["Rows"]))
    rules.append(F.when(rows.isNotNull(), F.concat(F.lit("Pixel metadata inconsistency: "), pixel_error(ds))))
    burned = F.upper(F.trim(F.try_element_at(ds, F.lit(TAG_OF["BurnedInAnnotation"])))) == "YES"
    rules.append(F.when(burned, F.lit("BurnedInAnnotation is 'YES' — pixel data may contain PHI. Review pixel content before distribution.")))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def validate(df: DataFrame, id_col: str, ds_col: str) -> DataFrame:
    """(id, seq, message): a row per issue."""
    return df.select(F.col(id_col), F.posexplode(dataset_issues(F.col(ds_col))).alias("seq", "message"))


def validate_sop_class(df: DataFrame, id_col: str, ds_col: str, sop_class: Column | None = None) -> DataFrame:
    """(id, type, seq, severity, tag8, message): a row per missing mandatory attribute of the row's SOP class.

    Type 1 attributes must be present and not blank, type 2 present. A missing class is one error, a class without
    requirements one warning. The requirements, 110 fixed rows, are broadcast; nothing is shuffled.
    """
    uid = F.try_element_at(F.col(ds_col), F.lit(TAG_OF["SOPClassUID"])) if sop_class is None else sop_class
    rows = df.select(F.col(id_col), F.col(ds_col).alias("__ds"), F.nullif(F.trim(uid), F.lit("")).alias("__uid"))
    joined = rows.join(F.broadcast(dim_iod(df.sparkSession)), F.col("__uid") == F.col("sop_class_uid"), "left")
    there = F.map_contains_key("__ds", F.col("tag8"))
    filled = F.coalesce(F.trim(F.try_element_at("__ds", F.col("tag8"))), F.lit("")) != ""
    finding = (
        F.when(F.col("__uid").isNull(), F.lit("no class"))
        .when(F.col("sop_class_uid").isNull(), F.lit("no profile"))
        .when((F.col("type") == 1) & ~filled, F.lit("type 1"))
        .when((F.col("type") == 2) & ~there, F.lit("type 2"))
    )
    out = joined.withColumn("__finding", finding).filter("__finding is not null")
    found, label = F.col("__finding"), F.concat(F.col("label"), F.lit(" "), tag_label(F.col("tag8")))
    # fixed values: the texts of the findings
    message = (
        F.when(found == "no class", F.lit("[error] SOPClassUID is absent — cannot determine which IOD to validate against."))
        .when(found == "no profile", F.concat(F.lit("[warning] SOP Class '"), F.col("__uid"), F.lit("' is not in the built-in IOD profile table. No mandatory-attribute checks were performed.")))
        .when(found == "type 1", F.concat(F.lit("[error] "), F.col("profile"), F.lit(" requires "), label, F.lit(" (Type 1 — must be present and non-empty).")))
        .otherwise(F.concat(F.lit("[warning] "), F.col("profile"), F.lit(" expects "), label, F.lit(" (Type 2 — must be present, may be empty).")))
    )
    severity = F.when(found.isin("no class", "type 1"), F.lit("error")).otherwise(F.lit("warning"))
    return out.select(id_col, F.coalesce("type", F.lit(0)).alias("type"), F.coalesce("seq", F.lit(0)).alias("seq"), severity.alias("severity"), "tag8", message.alias("message"))


def finding_counts(ds: Column, sop_class: Column | None = None) -> Column:
    """struct(errors, warnings): how many findings of `validate_sop_class` a dataset has, without their rows."""
    uid = F.nullif(F.trim(F.try_element_at(ds, F.lit(TAG_OF["SOPClassUID"])) if sop_class is None else sop_class), F.lit(""))
    errors, warnings = F.when(uid.isNull(), 1).otherwise(0), F.when(uid.isNull() | uid.isin(*IOD_PROFILES), 0).otherwise(1)
    for name, (_, one, two) in IOD_PROFILES.items():
        tags = lambda keys: F.array(*[F.lit(TAG_OF[k]) for k in keys])
        empty = F.size(F.filter(tags(one), lambda t: F.coalesce(F.trim(F.try_element_at(ds, t)), F.lit("")) == ""))
        absent = F.size(F.array_except(tags(two), F.map_keys(ds)))
        errors, warnings = F.when(uid == name, empty).otherwise(errors), F.when(uid == name, absent).otherwise(warnings)
    return F.struct(errors.alias("errors"), warnings.alias("warnings"))
