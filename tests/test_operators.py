"""Dataset operators, sources and services on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.dims import MARKERS, TAG_OF
from voxelake.operators import deid, djson, frames, model, multipart, qido, service, transfer, validate
from voxelake.sources import dicom_file, dicomweb

NAME, PATIENT, UID = TAG_OF["PatientName"], TAG_OF["PatientID"], TAG_OF["SOPInstanceUID"]


def maps(spark, *datasets):
    return spark.createDataFrame([(i, d) for i, d in enumerate(datasets)], "id int, ds map<string,string>")


def out(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_deidentify(spark):
    full = {NAME: "A^B", PATIENT: "1", TAG_OF["PatientAddress"]: "x", TAG_OF["StudyDate"]: "20260101", "00111001": "p", UID: "1.2\\1.3", TAG_OF["PatientSex"]: None}
    df = maps(spark, full, {}, {TAG_OF["Modality"]: "CT"})
    got = out(df, deid.deidentify(F.col("ds"), deid.starter_plan({NAME: "Nobody"})))
    assert got[0][NAME] == "Nobody" and got[0][PATIENT] == "ANON" and got[0][TAG_OF["StudyDate"]] == "" and got[0][TAG_OF["PatientSex"]] == ""
    assert TAG_OF["PatientAddress"] not in got[0] and "00111001" not in got[0]
    assert got[0][UID].count("\\") == 1 and got[0][UID].startswith("2.25.")
    assert set(got[1]) == set(MARKERS) and got[2][TAG_OF["Modality"]] == "CT"
    plan = deid.Plan([(NAME, "DELETE", None), (PATIENT, "EMPTY", None), (NAME, "REPLACE", "x")], remove_private=False)
    assert plan.final == [(NAME, "REPLACE", "x"), (PATIENT, "EMPTY", None)]
    with pytest.raises(ValueError):
        deid.Plan([(NAME, "SHIFT_DATE", "1")])


def test_audit_withholds_previous_values(spark):
    df = maps(spark, {NAME: "secret"}, {})
    assert deid.audit(df, "id", "ds", deid.starter_plan()).filter("previous_value is not null").count() == 0
    raw = deid.audit(df, "id", "ds", deid.starter_plan(), redact_previous=False)
    assert raw.count() == 96 and raw.filter("previous_value = 'secret'").count() == 1


def test_nested(spark):
    dataset = {NAME: {"vr": "PN", "Value": [{"Alphabetic": "A"}]}, "00111001": {"vr": "SQ", "Value": [{"00111002": {"vr": "LO", "Value": ["x"]}}]}, TAG_OF["ReferencedSeriesSequence"]: {"vr": "SQ", "Value": [{NAME: {"vr": "PN", "Value": [{"Alphabetic": "B"}]}, "00111001": {"vr": "LO"}, UID: {"vr": "UI", "Value": ["1.2"]}}]}}
    df = spark.createDataFrame([(0, json.dumps(dataset)), (1, None), (2, "{}")], "id int, j string")
    found = model.elements(df, "id", "j")
    assert [(r.tag8, len(r.path)) for r in found.collect()] == [(NAME, 0), ("00111001", 0), ("00111002", 1), ("00081115", 0), (NAME, 1), ("00111001", 1), (UID, 1)]
    kept, counted = model.private_removed(found)
    assert kept.count() == 4 and found.filter(counted).count() == 2
    new = json.loads(out(df, deid.deidentify_nested(F.col("j"), deid.starter_plan()))[0])
    item = new[TAG_OF["ReferencedSeriesSequence"]]["Value"][0]
    assert item[NAME]["Value"] == [{"Alphabetic": "Anonymous"}] and "00111001" not in item and item[UID]["Value"][0].startswith("2.25.")


def test_presence_states_survive(spark):
    df = maps(spark, {NAME: None}, {NAME: ""}, {})
    assert out(df, F.map_contains_key("ds", NAME)) == [True, True, False]
    assert out(df, model.get(F.col("ds"), NAME, F.lit("default"))) == [None, "", "default"]
    assert [json.loads(x) for x in out(df, djson.encode(F.col("ds")))] == [{NAME: {"vr": "PN"}}, {NAME: {"vr": "PN", "Value": [{"Alphabetic": ""}]}}, {}]


def test_json_round_trip(spark):
    df = maps(spark, {NAME: 'A^B "q"', PATIENT: "é\\x", TAG_OF["StudyDate"]: "20260101"})
    assert out(df, djson.decode(djson.encode(F.col("ds"))))[0] == {NAME: 'A^B "q"', PATIENT: "é\\x", TAG_OF["StudyDate"]: "20260101"}
    assert out(df, djson.from_message(djson.message(F.col("ds"))))[0][NAME] == 'A^B "q"'
    many = spark.createDataFrame([(0, '[{"00100010":{}},{}]'), (1, "{}")], "id int, j string")
    assert [len(x) for x in out(many, djson.split_array(F.col("j")))] == [2, 1]


def test_validation(spark):
    ct = {TAG_OF["SOPClassUID"]: "1.2.840.10008.5.1.4.1.1.2", UID: "1", TAG_OF["Modality"]: " ", TAG_OF["BurnedInAnnotation"]: " yes", TAG_OF["Rows"]: "x"}
    df = maps(spark, ct, {}, {TAG_OF["SOPClassUID"]: "9"})
    assert [m[:22] for m in out(df, validate.dataset_issues(F.col("ds")))[0]] == ["Missing required tag M", "TransferSyntaxUID (000", "Pixel metadata inconsi", "BurnedInAnnotation is "]
    found = validate.validate_sop_class(df, "id", "ds").collect()
    by_id = {i: [r for r in found if r.id == i] for i in range(3)}
    assert len(by_id[0]) == 13 + 10 + 1 and len(by_id[1]) == 1 and by_id[1][0].severity == "error" and by_id[2][0].severity == "warning"


def test_codecs(spark):
    df = spark.createDataFrame([(0, "1.2.840.10008.1.2"), (1, "9.9"), (2, None)], "id int, uid string")
    rows = transfer.classify(df, "uid").orderBy("id").collect()
    assert [r.encapsulated for r in rows] == [False, True, True] and rows[1].syntax_name == "Unknown Transfer Syntax 9.9"
    assert out(transfer.find_codec(df, "uid"), "codec_name") == ["native-uncompressed", None, None]
    assert transfer.supported(df, "uid", yes=False).count() == 2


def test_query_builder(spark):
    q = qido.Query().modality("MR").limit(3).study_date("-19991231").patient_id("a b").include_field("all").include_field("00100010").offset(40).limit(7)
    assert q.to_query_string() == "Modality=MR&StudyDate=-19991231&PatientID=a+b&includefield=all&includefield=PatientName&offset=40&limit=7"
    with pytest.raises(ValueError):
        q.limit(-1)
    df = spark.createDataFrame([("a_1", "20260105"), ("ab1", "20260205")], "PatientID string, StudyDate string")
    assert qido.Query().patient_id("a_*").apply(df, []).count() == 1
    assert qido.Query().study_date("20260201-").apply(df, []).count() == 1


@pytest.mark.parametrize("size", [1, 3, 32, 128, 4096])
def test_multipart_in_any_chunks(size):
    parts = [multipart.Part(b"\r\n--no boundary\r\n", {"x-a": "1"}), multipart.Part(b"-"), multipart.Part(bytes(range(255, -1, -1)) * 9), multipart.Part(b"")]
    body, kind = multipart.build(parts)
    body = b"preamble\r\n" + body
    got = list(multipart.parse((body[i : i + size] for i in range(0, len(body), size)), kind))
    assert [p.body for p in got] == [p.body for p in parts] and got[0].headers["x-a"] == "1"


def test_multipart_edges():
    assert list(multipart.parse([], "multipart/related; boundary=x")) == []
    with pytest.raises(ValueError):
        multipart.build([])
    assert [p.body for p in multipart.parse([b"--x\r\nA: b\r\n\r\ncut short"], "multipart/related; boundary=x")] == [b"cut short"]
    with pytest.raises(ValueError):
        list(multipart.parse([b"--x\r\n\r\n" + bytes(100)], 'multipart/related; boundary="x"', max_part=50))


def test_frames(spark):
    meta = {"rows": 1, "columns": 2, "samples": 1, "bits_allocated": 16, "pixel_representation": 1, "frames": 2, "planar": 0}
    data = np.array([1, -2, 3, -4], "<i2").tobytes()
    rows = [(0, *meta.values(), "1.2.840.10008.1.2.1", data), (1, *meta.values(), "9", data), (2, *meta.values(), "1.2.840.10008.1.2.1", None), (3, *meta.values(), "1.2.840.10008.1.2.1", data[:4])]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{k} int" for k in meta) + ", syntax string, pixel_data binary")
    got = frames.decode(df, "id", {}).orderBy("id", "frame").collect()
    assert [r.pixels for r in got if r.id == 0] == [[1.0, -2.0], [3.0, -4.0]]
    assert all(r.error for r in got if r.id > 0)
    got = frames.decode(df.filter("id = 1"), "id", {"9": lambda data, m: [np.zeros((1, 2))] * 2}).collect()
    assert [r.pixels for r in got] == [[0.0, 0.0]] * 2
    x = np.array([[0, 10], [20, 30]], np.uint8)
    assert (frames.from_png(frames.to_png(x)) == x).all()
    assert frames.raster(x, "MONOCHROME1", window=False).ravel().tolist() == [255, 170, 85, 0]
    assert frames.raster(np.array([[[235, 128, 128]]], np.uint8), "YBR_FULL").ravel().tolist() == [235, 235, 235]


def test_messages_and_negotiation(spark):
    message = {PATIENT: "x", "PixelData": b"\0\1", "items": [{"SOPInstanceUID": "1"}]}
    assert list(service.unframe(service.frame(message) * 2)) == [message] * 2
    for bad in (b"\0\0\0\0", b"\0\0", b"\xff\xff\xff\xff{}", b"\0\0\0\x02[]"):
        with pytest.raises(ValueError):
            list(service.unframe(bad))
    n = service.negotiate(F.lit("X"), "X", F.array(F.lit("1"), F.lit("2")), ["2"])
    assert spark.range(1).select(n["accepted"]).first()[0] == ["2"]


def test_files(spark, tmp_path):
    dicom_file.register(spark)
    dataset = {TAG_OF["SpecificCharacterSet"]: {"vr": "CS", "Value": ["ISO_IR 192"]}, TAG_OF["SOPClassUID"]: {"vr": "UI", "Value": ["1.2"]}, UID: {"vr": "UI", "Value": ["1.2.3"]}, NAME: {"vr": "PN", "Value": [{"Alphabetic": "山田^太郎"}]}, "00111001": {"vr": "OB", "InlineBinary": "AAE="}, "00081115": {"vr": "SQ", "Value": [{NAME: {"vr": "PN", "Value": [{"Alphabetic": "B"}]}}]}, TAG_OF["Rows"]: {"vr": "US", "Value": [7]}}
    data = dicom_file.encode(dataset, b"\1\2\3")
    back, pixels = dicom_file.parse(data)
    assert all(back[t] == e for t, e in dataset.items()) and pixels == b"\1\2\3\0"
    (tmp_path / "bad.dcm").write_bytes(b"not a file")
    (tmp_path / "good.dcm").write_bytes(data)
    (tmp_path / "cut.dcm").write_bytes(data[:-300])
    rows = spark.read.format("dicom").option("stopBeforePixels", "true").load(f"file://{tmp_path}").collect()
    assert len(rows) == 3 and sum(r.error is not None for r in rows) >= 1 and all(r.pixel_data is None for r in rows)
    with pytest.raises(ValueError):
        dicom_file.encode({})
    # a name that the default repertoire lacks is no file, and nothing else in its place
    with pytest.raises(ValueError, match="00100010"):
        dicom_file.encode({t: e for t, e in dataset.items() if t != TAG_OF["SpecificCharacterSet"]})


class Fake:
    streams = True

    def __init__(self, *responses):
        self.responses, self.calls = list(responses), []

    def request(self, method, url, headers=None, body=None):
        self.calls.append((method, url, headers, body))
        return self.responses.pop(0)

    def stream(self, method, url, headers=None, body=None, chunk_size=1):
        r = self.request(method, url, headers, body)
        return dicomweb.Response(r.status, r.headers, chunks=[r.body[i : i + 5] for i in range(0, len(r.body), 5)])


def test_client():
    slept = []
    inner = Fake(dicomweb.Response(503), dicomweb.Response(503), dicomweb.Response(200, body=b'[{"00100020":{"vr":"LO","Value":["1"]}}]'))
    transport = dicomweb.BearerTransport(dicomweb.RetryTransport(inner, sleep=slept.append), "t")
    client = dicomweb.Client("http://x/", transport)
    assert len(client.search_studies(qido.Query().patient_id("a b"))) == 1
    assert inner.calls[0][1] == "http://x/studies?PatientID=a+b" and inner.calls[0][2]["Authorization"] == "Bearer t"
    assert len(slept) == 2 and 1 <= slept[0] <= 1.1 and 2 <= slept[1] <= 2.2
    body, kind = multipart.build([b"one", b"two"])
    inner.responses = [dicomweb.Response(200, {"Content-Type": kind}, body), dicomweb.Response(500), dicomweb.Response(200)]
    assert [p.body for p in client.iter_parts("1.2")] == [b"one", b"two"]
    with pytest.raises(dicomweb.DicomwebError):
        dicomweb.Client("http://x", Fake(dicomweb.Response(404))).study_metadata("1.2")
    with pytest.raises(ValueError):
        client.retrieve("1/2")
    assert dicomweb.backoff_delay(9) == 60


def test_search_source(spark):
    dicomweb.register(spark)
    item = '{"00100020":{"vr":"LO","Value":["%s"]},"00080060":{"vr":"CS","Value":["CT"]}}'
    page = lambda n: f"http://x/studies?Modality=CT&limit=2&offset={n}"
    answers = {page(0): f"[{item % 1},{item % 2}]", page(2): f"[{item % 3}]"}
    options = {"url": "http://x", "pages": "2", "pageSize": "2", "responses": json.dumps(answers)}
    df = spark.read.format("dicomweb").options(**options, **{"match.Modality": "CT"}).load()
    # filters are applied to what was read, and leave nothing behind for the next plan
    assert df.filter("PatientID = '2'").count() == 1 and df.filter("PatientID = '3'").unionByName(df.filter("PatientID = '1'")).count() == 2
    assert sorted(r.PatientID for r in df.collect()) == ["1", "2", "3"]
    with pytest.raises(Exception, match="404"):
        spark.read.format("dicomweb").options(**options).load().collect()


def test_search_source_reads_all_pages(spark):
    dicomweb.register(spark)
    item = lambda n: '{"00100020":{"vr":"LO","Value":["%d"]}}' % n  # noqa: E731, UP031
    page = lambda n, size, ids: {f"http://x/studies?limit={size}&offset={n}": f"[{','.join(map(item, ids))}]"}
    read = lambda answers, **options: sorted(int(r.PatientID) for r in spark.read.format("dicomweb").options(url="http://x", responses=json.dumps(answers), **options).load().collect())
    assert read(page(0, 1000, range(1000)) | page(1000, 1000, range(1000, 1003)) | page(1003, 1000, [])) == list(range(1003))
    assert read(page(0, 1000, [])) == []
    # a server that never gives more than two
    assert read(page(0, 3, [1, 2]) | page(2, 3, [3, 4]) | page(4, 3, [5]) | page(5, 3, []), pageSize="3") == [1, 2, 3, 4, 5]
    # pages is a hint: what follows the last of them is read too
    assert read(page(0, 2, [1, 2]) | page(2, 2, [3, 4]) | page(4, 2, [5, 6]) | page(6, 2, [7]), pageSize="2", pages="2") == [1, 2, 3, 4, 5, 6, 7]
    assert read(page(0, 3, [1, 2]) | page(2, 1, [3]) | page(3, 3, [4]), pageSize="3", pages="2") == [1, 2, 3, 4]
    # a server that ignores offsets has given all, unless its answer is as long as what was asked for
    assert read(page(0, 9, [1, 2]) | page(2, 9, [1, 2]), pageSize="9") == [1, 2]
    with pytest.raises(Exception, match="does not page"):
        read(page(0, 1, [1]) | page(1, 1, [1]), pageSize="1")


def test_short_pages_with_a_warning_go_on():
    answers = [dicomweb.Response(200, {"Warning": "299 x: more"}, b"[{}]"), dicomweb.Response(200, body=b'[{"1":{}}]')]
    pages = dicomweb.Client("http://x", Fake(*answers)).pages("series", qido.Query(), 5, 10, short_ends=True, study="1.2")
    assert list(pages) == [[{}], [{"1": {}}]]


def test_batch(spark, tmp_path):
    from voxelake.operators import batch

    dataset = {TAG_OF["SOPClassUID"]: {"vr": "UI", "Value": ["1.2"]}, UID: {"vr": "UI", "Value": ["1.2.3"]}, NAME: {"vr": "PN", "Value": [{"Alphabetic": "Ada"}]}}
    for folder in "ab":
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "same.dcm").write_bytes(dicom_file.encode(dataset, b"\1\2"))
    (tmp_path / "in" / "bad.dcm").write_bytes(b"x")
    rows = batch.anonymize_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert sorted((r.name, r.ok, r.shared_name) for r in rows) == [("bad.dcm", False, False), ("same.dcm", True, True), ("same.dcm", True, True)]
    back = [dicom_file.parse(p.read_bytes()) for p in (tmp_path / "out").glob("*.dcm")]
    assert len(back) == 2 and all(d[NAME]["Value"][0]["Alphabetic"] == "Anonymous" and p == b"\1\2" for d, p in back)
    named = maps(spark, {NAME: "A", TAG_OF["Rows"]: " 7", TAG_OF["Columns"]: "x"}).select(*batch.named_attributes(F.col("ds"))).first()
    assert (named.PatientName, named.Rows, named.Columns, named.NumberOfFrames, named.Modality) == ("A", 7, None, 1, "")


def test_associations():
    import asyncio

    from voxelake.sources import association as a

    async def talk():
        stored = []

        async def store(dataset):
            await asyncio.sleep(0)
            if dataset.get("fail"):
                raise ValueError("cannot store")
            stored.append(dataset)

        async def find(query):
            return [query]

        async with await a.Server("STORE", ["1.2", "1.3"], find=find, store=store, queue_size=2).start() as server:
            for called, classes in (("OTHER", ["1.2"]), ("STORE", ["9"])):
                with pytest.raises(a.AssociationRejected):
                    await a.Association.connect("127.0.0.1", server.bound_port, "ME", called, classes)
            async with await a.Association.connect("127.0.0.1", server.bound_port, "ME", "ANY-SCP", ["1.3", "9"]) as peer:
                assert peer.accepted == ["1.3"] and await peer.c_echo() == 0
                assert await peer.c_find({PATIENT: "1"}) == [{PATIENT: "1"}] and await peer.c_move({}, "X") == 0
                assert await asyncio.gather(*(peer.c_store({"n": i, "data": bytes([i])}) for i in range(20))) == [0] * 20
                with pytest.raises(RuntimeError, match="cannot store"):
                    await peer.c_store({"fail": True})
            with pytest.raises(a.AssociationClosed):
                await peer.c_echo()
        assert [d["n"] for d in stored] == list(range(20)) and stored[3]["data"] == b"\3"

    asyncio.run(talk())


def test_stream(spark, tmp_path):
    from voxelake.streaming import store

    df = spark.range(100).withColumn("uid", (F.col("id") % 40).cast("string"))
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = store.incoming(spark, f"{tmp_path}/in", df.schema, files_per_trigger=2)
    store.store(stream, f"{tmp_path}/out", f"{tmp_path}/state", transform=lambda b: b.filter("id >= 10"), now=True).awaitTermination()
    assert spark.read.schema(df.schema).parquet(f"{tmp_path}/out").count() == 90


def test_retrieved_rows_leave_a_task_in_batches(monkeypatch, spark):
    """Batches bounded in rows and bytes, not one a row, in the order of the rows."""
    import pyarrow as pa

    held, options = [], {"url": "http://host/dicom", "transport": "voxelake.sources.dicomweb:EchoTransport"}
    monkeypatch.setattr(dicomweb, "spread", lambda df: type("Kept", (), {"mapInArrow": lambda self, run, text: held.append(run)})(), raising=False)
    ids = ["0" if i % 50 == 0 else f"1.{i}" for i in range(6000)]
    given = [pa.RecordBatch.from_pydict({"study": ids[:3000]}), pa.RecordBatch.from_pydict({"study": ids[3000:]})]
    df = spark.range(1).selectExpr("'1' as study")
    for ask in (dicomweb.retrieve_parts, dicomweb.retrieve_whole, dicomweb.retrieve_metadata):
        ask(df, options, "study")
        out = list(held.pop()(given))
        assert [x for b in out for x in b.column("study").to_pylist()] == ids
        assert sum(x == "status 404" for b in out for x in b.column("error").to_pylist()) == 120
        assert [b.num_rows for b in out] == [4096, 1904]
    monkeypatch.setattr(dicomweb, "BATCH_BYTES", 1000)
    dicomweb.retrieve_whole(df, options, "study")
    out = list(held.pop()(given))
    assert sum(b.num_rows for b in out) == 6000
    assert max(sum(len(x or b"") for x in b.column("body").to_pylist()) for b in out) < 1200


def test_pixel_rules_look_at_the_dataset_once(spark):
    """The map stood in the plan once for every field and rule that reads it."""
    ds = F.create_map(F.lit("00280010"), F.concat(F.lit("made "), F.col("id").cast("string")))
    for error in (validate.pixel_error(ds), transfer.capability_error(ds, F.lit("1.2.840.10008.1.2"), F.lit(b"\0"))):
        plan = spark.range(1).select(error.alias("error"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("made ") == 1


def test_framed_messages_keep_bytes_at_any_depth():
    sent = {"a": [{"b": b"\x00\xff"}, (1, bytearray(b"x"))], "c": {"__bytes__": "AAE=", "d": 1}, "e": {"__bytes__": "AAE="}}
    assert list(service.unframe(service.frame(sent) + service.frame({}))) == [{"a": [{"b": b"\x00\xff"}, [1, b"x"]], "c": {"__bytes__": "AAE=", "d": 1}, "e": b"\x00\x01"}, {}]
    with pytest.raises(TypeError):
        service.frame({"a": object()})


@pytest.mark.parametrize("name", ["association_session", "http_session", "deid_nested", "retrieve_whole"])
def test_long_rows_are_dealt_over_the_cores(spark, tmp_path, name):
    """A table of one row group was one task of as many servers, requests or datasets as it has rows."""
    import __spark_entry__ as entry

    if not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the generated tables")
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_keys_of_remapped_identifiers_are_those_of_their_texts(spark):
    from voxelake.functions import uids

    df = spark.createDataFrame([("1.2.3",), (" 1.2.3 ",), ("",), ("  ",), (None,), *((f"1.{i}",) for i in range(200))], "uid string")
    rows = df.select(uids.remap_uid(F.col("uid")).alias("text"), uids.uid_of_key(uids.remap_key(F.col("uid"))).alias("by_key"), F.octet_length(uids.remap_key(F.col("uid"))).alias("n")).collect()
    assert all(r.text == r.by_key for r in rows) and {r.n for r in rows} == {16, 0, None}


def test_rollup_of_orders_that_stand_twice(spark, tmp_path):
    """Distinct studies and series, all instances; no row is expanded for each kind of thing to count."""
    import datetime

    import __spark_entry__ as entry

    day = datetime.datetime(1995, 1, 1)
    spark.createDataFrame([(1, "A#B"), (2, "C#D")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, day, "1-URGENT"), (1, 2, day, "1-URGENT"), (1, 2, day, "2-HIGH"), (2, 1, day, "9"), (3, 9, day, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 7), (1, 7), (1, 8), (2, 7), (3, 7)]
    full = [(o, 1, s, i, 1.0, 1.0, "A", "F") for i, (o, s) in enumerate(lines)]
    spark.createDataFrame(full, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = entry.queries()["hierarchy_rollup"](spark, str(tmp_path))
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in df.collect()} == {("CT", 2, 1, 2, 6), ("MR", 1, 1, 2, 3), (None, 1, 1, 1, 1)}


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """By rows alone, 400 texts of 100 kB were one batch."""
    from voxelake.session import prepare

    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    import pyarrow as pa

    rows = prepare(spark).range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    n = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(n) > 40_000_000 and max(n) < 10_000_000
