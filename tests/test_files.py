"""Files in all syntaxes, in steps and with faults; batch jobs; transports."""

import http.server
import json
import struct
import threading

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voxelake.dims import TAG_OF
from voxelake.functions import charsets
from voxelake.operators import batch, deid, multipart, validate
from voxelake.plans.more import FILE_SYNTAXES, FILE_TEXTS, plain_file
from voxelake.sources import dicom_file as D, dicomweb

KEYS = [k for k in range(1, 90) if k % 11 and k % 7]


@pytest.mark.parametrize("key", KEYS)
def test_files_laid_out_by_hand_survive(key):
    """Read, written and read again: syntax, text, fragments and the order of bytes stay as they were."""
    data = plain_file(key)
    dataset, pixels = D.parse(data)
    assert dataset[TAG_OF["TransferSyntaxUID"]]["Value"] == [FILE_SYNTAXES[key % 6]]
    assert dataset[TAG_OF["PatientName"]]["Value"] == [{"Alphabetic": FILE_TEXTS[key % 4][1]}]
    again, same = D.parse(D.encode(dataset, pixels))
    assert same == pixels and all(again[t] == e for t, e in dataset.items())
    if key % 6 in (0, 1, 2, 4, 5):
        # the dataset is the same to the last bit; file meta gets what it lacked
        start = data.index(struct.pack(">HH" if key % 6 == 2 else "<HH", 0x0008, 0x0005 if FILE_TEXTS[key % 4][0] else 0x0016), 132)
        assert D.encode(dataset, pixels).endswith(data[start:])
    if key % 6 >= 4:
        assert D.frames(pixels, 2) == [b"abcd", str(key).zfill(8).encode()]
    words = struct.unpack((">" if key % 6 == 2 else "<") + "3H", pixels) if key % 6 < 4 else None
    assert words in (None, (key, 1, 2)) and dataset[TAG_OF["Rows"]]["Value"] == [key]
    # metadata alone: no pixels, and everything before them
    head, none = D.parse(data, True)
    assert none is None and head == {t: e for t, e in dataset.items() if t != D.PIXELS}


class Steps:
    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n=None):
        piece = self.data[self.at : None if n is None else self.at + n]
        self.at += len(piece)
        return piece


def test_metadata_are_read_in_steps(monkeypatch):
    monkeypatch.setattr(D, "FIRST_BYTES", 64)
    for key in KEYS[:12]:
        dataset, _ = D.parse(plain_file(key))
        native = {t: e for t, e in dataset.items() if t != TAG_OF["TransferSyntaxUID"]}
        big = D.encode(native, b"\1\2" * 5_000_000)
        file = Steps(big)
        head, none = D.read_file(file, len(big), True, False)
        assert none is None and file.at < 4096 and head[TAG_OF["PatientName"]] == dataset[TAG_OF["PatientName"]]
        # a file without pixels is read to its end, and one that is cut short is an error
        bare = D.encode(native)
        assert D.read_file(Steps(bare), len(bare), True, False)[0][UID]["Value"] == [f"1.2.{key}"]
        with pytest.raises((ValueError, struct.error)):
            D.read_file(Steps(bare[:-3]), len(bare) - 3, True, False)


UID = TAG_OF["SOPInstanceUID"]
BASE = {TAG_OF["SOPClassUID"]: {"vr": "UI", "Value": ["1.2"]}, UID: {"vr": "UI", "Value": ["1.2.3"]}}


def test_pixels_of_an_icon_are_not_those_of_the_file():
    icon = {"00880200": {"vr": "SQ", "Value": [{D.PIXELS: {"vr": "OW", "InlineBinary": "AAE="}}]}}
    dataset, pixels = D.parse(D.encode(BASE | icon, b"\7\7"))
    assert pixels == b"\7\7" and dataset["00880200"]["Value"] == icon["00880200"]["Value"]
    head, none = D.parse(D.encode(BASE | icon, b"\7\7"), True)
    assert none is None and head["00880200"] == dataset["00880200"]


def test_text_that_its_character_set_cannot_decode_stays_bytes():
    data = D.encode(BASE | {TAG_OF["PatientName"]: {"vr": "PN", "InlineBinary": "TfxsbGVy"}})
    dataset, _ = D.parse(data)
    assert dataset[TAG_OF["PatientName"]] == {"vr": "PN", "InlineBinary": "TfxsbGVy"} and D.encode(dataset) == data


def test_what_cannot_be_encoded_is_an_error():
    for tag, element in (("00280010", {"vr": "US", "Value": [70000]}), ("00280010", {"vr": "US", "Value": ["x"]}), ("00100010", {"vr": "PN", "Value": [{"Alphabetic": "山"}]}), ("00100020", {"vr": "LO", "Value": ["x" * 70000]})):
        with pytest.raises(ValueError):
            D.encode(BASE | {tag: element})
    jpeg = {TAG_OF["TransferSyntaxUID"]: {"vr": "UI", "Value": ["1.2.840.10008.1.2.4.50"]}}
    for pixels in (b"no items", b"", b"\xfe\xff\x00\xe0\xff\0\0\0"):
        with pytest.raises(ValueError):
            D.encode(BASE | jpeg, pixels)
    assert D.frames(b"\xfe\xff\x00\xe0\0\0\0\0" + b"\xfe\xff\x00\xe0\2\0\0\0ab" * 3) == [b"ababab"]
    with pytest.raises(ValueError):
        D.frames(b"\xfe\xff\x00\xe0\0\0\0\0" + b"\xfe\xff\x00\xe0\2\0\0\0ab" * 3, 2)


CHARS = {"ISO_IR 100": "aé^=ÿ", "ISO_IR 192": "a山é^=😀", "GB18030": "a张^=伟é", "\\ISO 2022 IR 87": "aZ^=山田太郎", "\\ISO 2022 IR 149": "aZ^=김희중洪", "ISO_IR 144": "aЖ^=д"}


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_character_sets_round_trip(data):
    charset = data.draw(st.sampled_from(sorted(CHARS)))
    text = data.draw(st.text(CHARS[charset], max_size=12))
    assert charsets.decode(charsets.encode(text, charset), charset) == text


def test_character_sets_of_the_standard():
    """Encoded names as the standard prints them."""
    assert charsets.decode(b"Yamada^Tarou=\033$B;3ED\033(B^\033$BB@O:\033(B=\033$B$d$^$@\033(B^\033$B$?$m$&\033(B", "\\ISO 2022 IR 87") == "Yamada^Tarou=山田^太郎=やまだ^たろう"
    assert charsets.decode(b"Hong^Gildong=\033$)C\373\363^\033$)C\321\316\324\327=\033$)C\310\253^\033$)C\261\346\265\277", "\\ISO 2022 IR 149") == "Hong^Gildong=洪^吉洞=홍^길동"
    for text, charset in (("é", None), ("山", "ISO_IR 100"), ("é", "nonsense")):
        with pytest.raises(ValueError):
            charsets.encode(text, charset)
    assert charsets.encode("ascii", "nonsense") == b"ascii"


def test_folders_are_planned_by_size_and_listed_by_tasks(spark, tmp_path, monkeypatch):
    for i, key in enumerate(KEYS[:30]):
        folder = tmp_path / f"a{i % 5}" / f"b{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{key}.dcm").write_bytes(plain_file(key))
    (tmp_path / "a0" / "_hidden").mkdir()
    (tmp_path / "a0" / "_hidden" / "x.dcm").write_bytes(b"x")
    for most in (512, 3):
        monkeypatch.setattr(D, "LISTED_FOLDERS", most)
        reader = D.DicomReader({"path": f"file://{tmp_path}"})
        parts = reader.partitions()
        names = [n for p in parts for n in reader.files(p)]
        assert len(names) == len(set(names)) == 30 and (most == 512) == all(not p.folders for p in parts)
    D.register(spark)
    assert spark.read.format("dicom").load(f"file://{tmp_path}/a0/b0").count() == 2


def test_a_batch_runs_twice_alike(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for key in KEYS[:8]:
        (tmp_path / "in" / f"{key}.dcm").write_bytes(plain_file(key))
    (tmp_path / "in" / "7.dcm").write_bytes(plain_file(7))  # readable, without identifiers
    for _ in range(2):
        rows = batch.anonymize_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
        assert sum(r.ok for r in rows) == 8 and [r.error for r in rows if not r.ok] == ["the file meta needs SOPClassUID and SOPInstanceUID"]
        assert sorted(p.name for p in (tmp_path / "out").glob("*.dcm")) == sorted(r.written for r in rows if r.ok)


def test_events_of_nested_items(spark):
    inner = {"00100010": {"vr": "PN", "Value": [{"Alphabetic": "B"}]}, "00080018": {"vr": "UI", "Value": ["1.2", "1.3"]}}
    ds = {"00080020": {"vr": "DA", "Value": ["20200131"]}, "00091010": {"vr": "SQ", "Value": [inner]}, "00081115": {"vr": "SQ", "Value": [inner, {}]}}
    df = spark.createDataFrame([(1, json.dumps(ds)), (2, None)], "id int, dataset string")
    plan = deid.Plan([("00100010", "DELETE", None), ("00080018", "REMAP_UID", None), ("00080020", "SHIFT_DATE", 1)])
    events = deid.audit_nested(df, "id", "dataset", plan, redact_previous=False).collect()
    assert len(events) == 3 * 4 and {(tuple(e.path), tuple(e.item_path)) for e in events} == {((), ()), (("00091010",), (0,)), (("00081115",), (0,)), (("00081115",), (1,))}
    out = json.loads(df.select(deid.deidentify_nested(F.col("dataset"), plan)).first()[0])
    item = out["00081115"]["Value"][0]
    told = next(e for e in events if e.path == ["00081115"] and e.item_path == [0] and e.tag8 == "00080018")
    assert json.loads(told.new_value) == item["00080018"]["Value"] == json.loads(told.replacement) and told.previous_value == '["1.2", "1.3"]'
    gone = next(e for e in events if e.path == ["00081115"] and e.item_path == [0] and e.tag8 == "00100010")
    assert (gone.present, gone.after_present, gone.previous_value, gone.new_value) == (True, False, "B", None) and "00091010" not in out
    shifted = next(e for e in events if not e.path and e.tag8 == "00080020")
    assert (shifted.previous_value, shifted.new_value) == ("20200131", "20200201")
    hidden = deid.audit_nested(df, "id", "dataset", plan).filter("previous_value is not null").count()
    report = deid.reports(deid.audit_nested(df, "id", "dataset", plan), "id", plan).collect()
    assert hidden == 0 and len(report) == 1 and len(json.loads(report[0].report)["events"]) == 12


def test_counts_are_those_of_the_findings(spark):
    rows = [(1, {TAG_OF["SOPClassUID"]: "1.2.840.10008.5.1.4.1.1.2", TAG_OF["Rows"]: " ", TAG_OF["PatientName"]: ""}), (2, {TAG_OF["SOPClassUID"]: "9.9"}), (3, {TAG_OF["SOPClassUID"]: " "}), (4, {}), (5, {TAG_OF["SOPClassUID"]: "1.2.840.10008.5.1.4.1.1.7"})]
    df = spark.createDataFrame(rows, "id int, ds map<string, string>")
    found = validate.validate_sop_class(df, "id", "ds").groupBy("id").agg(F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning"))
    counts = df.select("id", validate.finding_counts(F.col("ds")).alias("n")).select("id", "n.*")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, counts.collect()))


def test_many_small_parts_in_one_chunk():
    parts = [b"x" * 10] * 2000
    body, kind = multipart.build(parts)
    assert [p.body for p in multipart.parse([body], kind, max_part=200)] == parts
    for size in (1, 7, 1000):
        big, kind = multipart.build([b"small", b"y" * 500])
        with pytest.raises(ValueError, match="larger"):
            list(multipart.parse((big[i : i + size] for i in range(0, len(big), size)), kind, max_part=200))


class Fails:
    """503 to the first requests; keeps what it was sent."""

    streams = True

    def __init__(self, times):
        self.times, self.bodies = times, []

    def request(self, method, url, headers=None, body=None):
        self.bodies.append(body if isinstance(body, bytes) else b"".join(body))
        return dicomweb.Response(503 if len(self.bodies) <= self.times else 200)

    stream = request


def test_a_lazy_store_is_never_sent_again_empty():
    inner = Fails(1)
    client = dicomweb.Client("http://x", dicomweb.RetryTransport(inner, sleep=lambda _: None))
    with pytest.raises(dicomweb.DicomwebError, match="503"):
        client.store([b"one"] * 20, lazily=True)
    assert len(inner.bodies) == 1 and inner.bodies[0].count(b"one") == 20
    # a body at hand is sent again whole
    inner = Fails(2)
    assert dicomweb.Client("http://x", dicomweb.RetryTransport(inner, sleep=lambda _: None)).store([b"one"]).status == 200
    assert len(inner.bodies) == 3 and len(set(inner.bodies)) == 1
    inner = Fails(1)
    assert dicomweb.RetryTransport(inner, sleep=lambda _: None).request("POST", "x", body=iter([b"a"])).status == 503 and inner.bodies == [b"a"]


class Handler(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    connections: list = []

    def setup(self):
        super().setup()
        self.connections.append(self)

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])) if "Content-Length" in self.headers else self.chunks()
        self.answer(200, self.path.encode() + b" " + body)

    def chunks(self):
        out = b""
        while n := int(self.rfile.readline(), 16):
            out += self.rfile.read(n)
            self.rfile.readline()
        self.rfile.readline()
        return out

    def do_GET(self):
        self.answer(404 if self.path == "/no" else 200, b"x" * 200_000)

    def answer(self, status, body):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_pooled_connections():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        with dicomweb.PooledTransport(timeout=10) as pool:
            assert [pool.request("POST", f"{url}/a?b=1", {"X": "y"}, "é").body for _ in range(5)] == [b"/a?b=1 " + "é".encode()] * 5
            assert pool.request("GET", f"{url}/no").status == 404
            r = pool.stream("GET", f"{url}/x", chunk_size=65_536)
            assert sum(map(len, r.stream())) == 200_000
            assert pool.request("POST", f"{url}/c", None, iter([b"one", b"two"])).body == b"/c onetwo"
            assert len(Handler.connections) == 1
        with pytest.raises(RuntimeError):
            pool.request("GET", url)
    finally:
        server.shutdown()


def test_packed_events_are_those_of_the_rules(spark):
    """Only attributes that are there are worked on; the other rules' events follow from the plan."""
    pn = {"vr": "PN", "Value": [{"Alphabetic": "B"}]}
    cases = [{}, {"00100010": pn, "00081115": {"vr": "SQ", "Value": [{"00080018": {"vr": "UI", "Value": ["1.2"]}}, {}, {"00091010": {"vr": "SQ", "Value": [{"00100010": pn}]}}]}}, {"00120062": {"vr": "CS", "Value": ["NO"]}, "0020000d": {"vr": "UI"}}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(9, None)], "id int, dataset string")
    plan = deid.starter_plan()
    events = deid.audit_nested(df, "id", "dataset", plan, redact_previous=False).collect()
    packed = {(r.id, tuple(r.path), tuple(r.item_path)): r for r in deid.audited_datasets(df, "id", "dataset", plan, redact_previous=False).collect()}
    assert len(packed) == 7 and len(events) == 7 * len(plan.final) and all(r.events == len(plan.final) and len(r.told) <= 5 for r in packed.values())
    for e in events:
        tag, action, replacement = plan.final[e.pos]
        assert (e.tag8, e.action) == (tag, action)
        told = packed[e.id, tuple(e.path), tuple(e.item_path)].told.get(e.pos)
        absent = (False, False, None, "" if action == "REMAP_UID" else replacement, None)
        assert (e.present, e.after_present, e.previous_value, e.replacement, e.new_value) == (tuple(told) if told else absent)
    assert [e.replacement for e in events if e.id == 0 and e.action == "REMAP_UID"] == [""] * len(plan.tags("REMAP_UID"))
    assert [(e.present, e.after_present) for e in events if e.id == 0 and e.tag8 in plan.tags("REPLACE") and e.after_present] == [(False, True)] * 3


def test_many_small_files_are_several_partitions(tmp_path):
    """By their bytes alone, 90,000 files of 600 bytes were one task."""
    for i in range(2100):
        (tmp_path / f"{i}.dcm").write_bytes(b"x")
    reader = D.DicomReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert [len(p.names) for p in parts] == [1024, 1024, 52] and len({n for p in parts for n in p.names}) == 2100
