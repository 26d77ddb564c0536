import base64
import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from voxelake.llm import common, warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_type": F.lit(1), "payload": F.lit(2)})


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" + "é" * (i % 3)) for i in range(200)]
    rows += [(500, None, None), (501, "http://a\r\nWARC-Type: evil", ""), (502, "http://é/", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, None, "only null ids"), (503, "u", "long" * 500_000), (-4, "u", "<p>1</p>é")]
    got = W.archive(pages(spark, rows)).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = set()
    for i, _, h in rows:
        f = first.get(h or "")
        revisit = f is not None and i != f
        want.add((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", f if revisit else None))
    assert len(got) == len(rows) and {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert W.archive(pages(spark, [])).collect() == []


def test_repeated_rows(spark):
    got = W.archive(pages(spark, [(1, "u", "a"), (1, "u", "a"), (2, "u", "a")])).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_members_are_plain_gzip_and_filters_skip(spark):
    path = common.new_path(spark, "warc-test")
    W.write_pages(pages(spark, [(i, f"http://{'ab'[i % 2]}/{i}", f"{i % 5}") for i in range(50)]), path)
    folder = path.removeprefix("file://")
    import os

    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".gz")]
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == 50
    df = spark.read.format("warc").load(path)
    assert df.filter("record_type = 'revisit'").count() == 45 and df.filter("target_uri like 'http://a/%'").count() == 25
    assert df.filter("record_type in ('response')").select("payload").collect()[0][0] is not None
    # a DataFrame that was filtered once reads all of its records the next time, and two filters do not mix
    assert df.count() == 50 and df.filter("record_type = 'response'").unionByName(df.filter("record_type = 'revisit'")).count() == 50
    assert df.count() == 50
    # every predicate of a scan is tested on the headers: the reader refuses before it inflates
    where = [("eq", "record_type", "response"), ("starts", "target_uri", "http://"), ("in", "record_id", [f"urn:page:{i}" for i in range(50)])]
    assert W.scan(spark, path, where=where).count() == 5 and W.scan(spark, path, where=[("starts", "refers_to", "urn:page:0")]).count() == 9
    reader = W.WarcReader({"path": path, "payload": "full", "where": json.dumps(where)})
    read = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(read) == 5 and all(r["payload"] for r in read)
    with pytest.raises(ValueError):
        W.WarcReader({"path": path, "where": json.dumps([("eq", "payload", "x")])})


def test_other_ids_and_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(f"p{i:03d}", "u", "" if i % 3 else f"own {i}") for i in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = W.archive(df).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id != "p001" and r.payload_bytes == 0} == {(i, "revisit", "p001") for i, _, h in rows if not h and i != "p001"}
    assert len(got) == 301 and sum(r.record_type == "response" for r in got) == 101


def test_foreign_archives(spark, tmp_path):
    """Without manifest, extra field or one member a record; and uncompressed."""
    row = {"record_type": "response", "record_id": "urn:page:1", "target_uri": "http://x", "warc_date": "d", "payload": b"body" * 1000, "refers_to": None}
    raw = W.build_record(row) + W.build_record(row | {"record_type": "revisit", "refers_to": "urn:page:1"}) + W.build_record(row)
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw[:3000]) + gzip.compress(raw[3000:]))
    df = W.register(spark) or spark.read.format("warc").load(f"file://{tmp_path}")
    assert df.count() == 6 and df.filter("record_type = 'response'").select("payload_digest").distinct().count() == 1
    assert df.filter("record_type = 'revisit'").count() == 2


def test_cut_records_are_errors():
    data = W.gzip_member(W.build_record({"record_type": "response", "record_id": "x", "target_uri": None, "warc_date": "d", "payload": b"abc" * 99, "refers_to": None}))
    with pytest.raises(EOFError):
        list(W.records(W._Gzip(io.BytesIO(data[:-60]), 0, len(data) - 60), lambda r: True, "full"))


def test_a_split_archive_is_read_twice_alike(spark, monkeypatch):
    monkeypatch.setattr(W, "SPLIT_BYTES", 200)
    path = common.new_path(spark, "warc-test")
    W.write_pages(pages(spark, [(i, None, f"{i % 9}") for i in range(80)]), path)
    assert sorted(W.read_pages(spark, path).collect()) == sorted(W.read_pages(spark, path).collect()) and W.read_pages(spark, path).count() == 80
