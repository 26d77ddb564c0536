"""Expressions on small inputs with known results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from voxelake.functions import dates, person_name as pn, pixels as px, tags, text, uids


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_tags(spark):
    got = column(spark, ["PatientName", "(0010,0010)", "10,10", "7fe00010", " (0008, 103E) ", "nope", None, "00100010"], tags.parse_tag)
    assert got == ["00100010", "00100010", "00100010", "7FE00010", "0008103E", None, None, "00100010"]
    assert column(spark, ["00111001", "00100010"], tags.is_private) == [True, False]
    assert column(spark, ["00100010", "00111001"], tags.tag_name) == ["Tag.PatientName", "Tag(0011,1001)"]
    assert one(spark, tags.tag_of_int(F.lit(0x1_0010_0010)), tags.tag_of_pair(F.lit(0x10), F.lit(0x10)), tags.tag_of_pair(F.lit(-1), F.lit(0)))[:] == ("00100010", "00100010", None)
    assert column(spark, ["PatientName", "00111001"], tags.query_key) == ["PatientName", "00111001"]


def test_uid_grammar(spark):
    cases = {"1" * 64: True, "1" * 65: False, "": False, "1.2.03.4": False, "1.02.3": False, "1.0.2": True, "0": True, "1.2.3.": False, ".1.2.3": False, "1..2.3": False, "1.2.a": False, "1.2.3-4": False, "1.2.3 4": False}
    assert column(spark, list(cases) + [None], lambda c: uids.is_valid_uid(c)) == [*cases.values(), False]


def test_remap_uid(spark):
    def expected(u):
        number = int.from_bytes(hashlib.sha256(f"voxelake\0{u}".encode()).digest()[:16], "big")
        return f"2.25.{number}"[:64]

    given = [f"1.2.3.{i}" for i in range(300)]
    assert column(spark, given, lambda c: uids.remap_uid(c)) == [expected(u) for u in given]
    assert column(spark, [" ", None, " 1.2 "], lambda c: uids.remap_uid(c)) == ["", None, expected("1.2")]
    with pytest.raises(ValueError):
        uids.remap_uid(F.lit("1"), root="1" * 61)
    with pytest.raises(ValueError):
        uids.generate_uid("1.a")


def test_shift_date(spark):
    cases = [("20260101", 30, "20260131"), ("20260101", -1, "20251231"), ("20260315", 0, "20260315"), ("20261231", 1, "20270101"), ("20260101120000.000000", 10, "20260111120000.000000"), ("20260101143022.000000+0530", 1, "20260102143022.000000+0530"), ("", 10, ""), ("2026", 10, "2026"), ("99991399", 1, "99991399"), ("00010101", -30, "00010101"), ("99991231", 1, "99991231"), (None, 1, None)]
    rows = spark.createDataFrame(cases, "v string, n int, want string")
    assert [r for r in rows.select(dates.shift_date(F.col("v"), F.col("n")).alias("got"), "want").collect() if r.got != r.want] == []


def test_person_names(spark):
    raw = "Yamada^Taro^^Dr^PhD=山田^太郎=やまだ^たろう"
    name = pn.parse_person_name(F.lit(raw))
    row = one(spark, name["family_name"], name["ideographic"], name["error"], pn.display_name(name), pn.format_person_name(name))
    assert row[:] == ("Yamada", "山田^太郎", None, "Dr Taro Yamada, PhD", raw)
    errors = column(spark, ["A=B=C=D", "A^B^C^D^E^F", "A"], lambda c: pn.parse_person_name(c)["error"])
    assert errors[0] and errors[1] and errors[2] is None
    assert column(spark, ["=山田^太郎", "==あ^い"], lambda c: pn.display_name(pn.parse_person_name(c))) == ["山田 太郎", "あ い"]


def test_character_sets(spark):
    cases = [("山田太郎", "ISO_IR 192", True), ("山田太郎", "ISO 2022 IR 87", True), ("홍길동", "ISO 2022 IR 149", True), ("张伟", "GB18030", True), ("山田", "", False), ("é", "ISO_IR 100", True), ("山", "ISO_IR 100", False), ("A", "ISO 2022 IR 13", False)]
    rows = spark.createDataFrame(cases, "v string, cs string, want boolean")
    assert [r for r in rows.select("v", "cs", text.can_encode(F.col("v"), F.col("cs")).alias("got"), "want").collect() if r.got != r.want] == []
    back = rows.filter("want").select("v", text.decode_text(text.encode_text(F.col("v"), F.col("cs")), F.col("cs")).alias("b"))
    assert all(r.v == r.b for r in back.collect())
    assert one(spark, text.valid_for_write(F.lit("ascii"), F.lit("ISO 2022 IR 13")))[0]
    assert column(spark, ["Latin-1", "nope"], text.preferred_charset) == ["ISO_IR 100", None]


def test_pixel_arithmetic(spark):
    row = one(spark, px.rescale(F.lit(100.0), F.lit(2.0), F.lit(-1024.0)), px.voi_bounds(F.lit(40.0), F.lit(400.0)), px.voi_window(F.lit(40.0), F.lit(40.0), F.lit(400.0)), px.voi_window(F.lit(1.0), F.lit(1.0), F.lit(0.0)), px.voi_window(F.lit(5.0), F.lit(1.0), F.lit(1.0)))
    assert row[0] == -824 and row[1][:] == (-160.0, 239.0) and row[2] == 127.81954887218045 and row[3] is None and row[4] == 255.0
    lut = column(spark, [-9.5, 1.9, 2.0, 99.0], lambda c: px.voi_lut(c, F.lit(1), F.array(*map(F.lit, (10, 20, 30)))), "double")
    assert lut == [10, 10, 20, 30]
    assert one(spark, px.ybr_to_rgb(F.lit(235.0), F.lit(128.0), F.lit(128.0)))[0][:] == (235, 235, 235)
    assert one(spark, px.ybr_to_rgb(F.lit(235.0), F.lit(128.0), F.lit(128.0), partial=True))[0][:] == (255, 255, 255)


def test_metadata_rules(spark):
    good = {"SamplesPerPixel": 1, "Rows": 2, "Columns": 2, "BitsAllocated": 16, "BitsStored": 12, "HighBit": 11, "PixelRepresentation": 0, "NumberOfFrames": 1, "PlanarConfiguration": None, "PhotometricInterpretation": "MONOCHROME2"}
    changes = [({}, None), ({"Rows": 0}, "Rows"), ({"BitsAllocated": 24, "BitsStored": 24, "HighBit": 23}, "BitsAllocated"), ({"BitsStored": 17, "HighBit": 16}, "BitsStored (17)"), ({"HighBit": 16}, "HighBit (16) must be less"), ({"HighBit": 10}, "HighBit (10) must equal"), ({"PixelRepresentation": 2}, "PixelRepresentation"), ({"PhotometricInterpretation": "HSV"}, "Unsupported"), ({"SamplesPerPixel": 3}, "MONOCHROME2 usually"), ({"SamplesPerPixel": 3, "PhotometricInterpretation": "RGB"}, "PlanarConfiguration")]
    for change, start in changes:
        m = {k: F.lit(v) if v is not None else F.lit(None).cast("int") for k, v in (good | change).items()}
        got = one(spark, px.metadata_error(m))[0]
        assert (got is None) if start is None else got.startswith(start), (change, got)
    sizes = one(spark, px.frame_sizes({k: F.lit(v) for k, v in good.items()}))[0]
    assert (sizes.frame_pixels, sizes.frame_bytes) == (4, 8)
    assert one(spark, px.length_error(F.lit(4), F.lit(3), F.lit(True)), px.length_error(F.lit(4), F.lit(3), F.lit(False)), px.length_error(F.lit(5), F.lit(4), F.lit(True)))[0] is None
