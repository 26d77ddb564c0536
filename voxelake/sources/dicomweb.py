"""DICOMweb: transports, client, and the ``dicomweb`` data source.

Transports are composable: HTTP at the bottom, bearer tokens and status-code retries around it. What a transport can
do is explicit (``streams``), so a client never takes a streaming path that the innermost transport lacks. Searches
become partitions of pages. Query attributes are given as options of the load (``match.<Keyword>``) and go into the
request; filters on the DataFrame are applied by Spark to what was read. (What a Python reader's ``pushFilters``
records stays with the loaded relation, so later plans of the same DataFrame would miss rows; this reader has none.)
"""

from __future__ import annotations

import hashlib
import http.client
import json
import random
import ssl
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from voxelake.dims import JSON_VR, TAG_OF
from voxelake.operators.multipart import Part, boundary_of, build, generate, new_boundary, parse
from voxelake.operators.qido import Query
from voxelake.session import spread

CHUNK = 65536
#: A batch of rows that leaves Python is closed at either.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20
# fixed values: the statuses that are tried again, and the limits of a retry
RETRYABLE = (429, 500, 502, 503, 504)
MAX_RETRIES, BACKOFF_BASE, BACKOFF_MAX, JITTER = 3, 1.0, 60.0, 0.1


class DicomwebError(RuntimeError):
    """A response that is no success."""


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    chunks: Iterable[bytes] | None = None

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)

    def stream(self) -> Iterator[bytes]:
        return iter(self.chunks) if self.chunks is not None else iter((self.body,))

    def drain(self) -> None:
        for _ in self.stream():
            pass


def body_bytes(body) -> bytes | Iterable[bytes] | None:
    """Text as UTF-8, byte strings and iterables as they are."""
    if isinstance(body, str):
        return body.encode()
    return bytes(body) if isinstance(body, bytearray) else body


class HttpTransport:
    """HTTP by the standard library; error statuses are responses. TLS client certificates by path."""

    streams = True

    def __init__(self, timeout: float = 30.0, cert: str | tuple[str, str] | None = None, verify: bool | str = True):
        self.timeout = timeout
        context = ssl.create_default_context(cafile=verify if isinstance(verify, str) else None)
        if verify is False:
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        if cert:
            context.load_cert_chain(*((cert,) if isinstance(cert, str) else cert))
        self.opener = urllib.request.build_opener(urllib.request.HTTPSHandler(context=context))

    def _open(self, method: str, url: str, headers: dict, body):
        request = urllib.request.Request(url, body_bytes(body), headers or {}, method=method)
        try:
            return self.opener.open(request, timeout=self.timeout)
        except urllib.error.HTTPError as error:
            return error

    def request(self, method: str, url: str, headers: dict | None = None, body=None) -> Response:
        with self._open(method, url, headers, body) as r:
            return Response(r.status, dict(r.headers), r.read())

    def stream(self, method: str, url: str, headers: dict | None = None, body=None, chunk_size: int = CHUNK) -> Response:
        r = self._open(method, url, headers, body)

        def chunks():
            with r:
                while piece := r.read(chunk_size):
                    yield piece

        return Response(r.status, dict(r.headers), chunks=chunks())


class PooledTransport:
    """HTTP over connections that stay open and are used again, ``pool_size`` a host at most; a context manager.

    A request takes an idle connection or opens one, and gives it back when its response has been read; what the pool
    has no room for is closed. A connection that the server has closed meanwhile is opened anew, once, if the body
    can be sent again.
    """

    streams = True

    def __init__(self, timeout: float = 30.0, cert: str | tuple[str, str] | None = None, verify: bool | str = True, pool_size: int = 10):
        self.timeout, self.pool_size, self.idle, self.lock, self.open = timeout, pool_size, {}, threading.Lock(), True
        self.context = ssl.create_default_context(cafile=verify if isinstance(verify, str) else None)
        if verify is False:
            self.context.check_hostname, self.context.verify_mode = False, ssl.CERT_NONE
        if cert:
            self.context.load_cert_chain(*((cert,) if isinstance(cert, str) else cert))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        with self.lock:
            self.open, held, self.idle = False, self.idle, {}
        for connections in held.values():
            for c in connections:
                c.close()

    def _connect(self, scheme: str, host: str):
        return http.client.HTTPSConnection(host, timeout=self.timeout, context=self.context) if scheme == "https" else http.client.HTTPConnection(host, timeout=self.timeout)

    def _give_back(self, key: tuple[str, str], connection) -> None:
        with self.lock:
            held = self.idle.setdefault(key, [])
            if self.open and len(held) < self.pool_size:
                held.append(connection)
                return
        connection.close()

    def _send(self, method: str, url: str, headers: dict | None, body):
        if not self.open:
            raise RuntimeError("the transport is closed")
        parts = urlsplit(url)
        key, target = (parts.scheme, parts.netloc), (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        with self.lock:
            held = self.idle.get(key) or []
            connection, used = (held.pop(), True) if held else (self._connect(*key), False)
        body = body_bytes(body)
        try:
            connection.request(method, target, body, headers or {})
            return key, connection, connection.getresponse()
        except (http.client.HTTPException, OSError):
            connection.close()
            if not used or not (body is None or isinstance(body, bytes)):
                raise
        connection = self._connect(*key)
        connection.request(method, target, body, headers or {})
        return key, connection, connection.getresponse()

    def request(self, method: str, url: str, headers: dict | None = None, body=None) -> Response:
        key, connection, r = self._send(method, url, headers, body)
        data = r.read()
        self._give_back(key, connection)
        return Response(r.status, dict(r.headers), data)

    def stream(self, method: str, url: str, headers: dict | None = None, body=None, chunk_size: int = CHUNK) -> Response:
        key, connection, r = self._send(method, url, headers, body)

        def chunks():
            try:
                while piece := r.read(chunk_size):
                    yield piece
            except BaseException:
                connection.close()
                raise
            self._give_back(key, connection)

        return Response(r.status, dict(r.headers), chunks=chunks())


class EchoTransport:
    """Answers each request from itself, for dry runs and tests: a search with one dataset of its parameters and path
    identifiers, a retrieval with parts that name its path, a store with the number and digest of what it got. Paths of
    a study of ``0`` are not found."""

    streams = True

    def request(self, method: str, url: str, headers: dict | None = None, body=None) -> Response:
        parts, headers = urlsplit(url), {k.lower(): v for k, v in (headers or {}).items()}
        path = parts.path.strip("/").split("/")
        if "studies" in path:
            path = path[path.index("studies") :]
        if path[1:2] == ["0"]:
            return Response(404)
        if method == "POST":
            got = list(parse([body] if isinstance(body, bytes) else body, headers["content-type"]))
            told = {"parts": len(got), "sha256": hashlib.sha256(b"".join(p.body for p in got)).hexdigest(), "authorization": headers.get("authorization")}
            return Response(200, {"Content-Type": "application/json"}, json.dumps(told).encode())
        known = dict(zip(path[::2], path[1::2]))  # noqa: B905
        if "multipart" in headers.get("accept", ""):
            data, kind = build([f"{name} {uid}".encode() for name, uid in known.items()], "application/dicom", "echo")
            return Response(200, {"Content-Type": kind}, data)
        values = {TAG_OF.get(k, k): v for k, v in parse_qsl(parts.query)} | {TAG_OF[k]: known[n] for n, k in (("studies", "StudyInstanceUID"), ("series", "SeriesInstanceUID"), ("instances", "SOPInstanceUID")) if n in known}
        if int(dict(parse_qsl(parts.query)).get("offset", "0")):
            return Response(200, {"Content-Type": "application/dicom+json"}, b"[]")
        found = [{tag: {"vr": JSON_VR.get(tag, "UN"), "Value": [{"Alphabetic": v} if JSON_VR.get(tag) == "PN" else v]} for tag, v in values.items()}]
        return Response(200, {"Content-Type": "application/dicom+json"}, json.dumps(found).encode())

    def stream(self, method: str, url: str, headers: dict | None = None, body=None, chunk_size: int = CHUNK) -> Response:
        r = self.request(method, url, headers, body)
        return Response(r.status, r.headers, chunks=[r.body[i : i + chunk_size] for i in range(0, len(r.body), chunk_size)])


class StaticTransport:
    """Recorded responses by url, for replays and tests: a mapping of url to body text; others are 404."""

    streams = False

    def __init__(self, responses: dict[str, str]):
        self.responses = responses

    def request(self, method: str, url: str, headers: dict | None = None, body=None) -> Response:
        found = self.responses.get(url)
        return Response(404) if found is None else Response(200, {"Content-Type": "application/dicom+json"}, found.encode())


def backoff_delay(attempt: int, base: float = BACKOFF_BASE, most: float = BACKOFF_MAX) -> float:
    return min(base * 2**attempt, most)


def backoff_column(attempt: Column, base: float = BACKOFF_BASE, most: float = BACKOFF_MAX) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


class RetryTransport:
    """Repeats requests that end in a retryable status; exceptions and streams are not repeated, nor are requests whose
    body is an iterable, which the first attempt has used up."""

    def __init__(self, inner, max_retries: int = MAX_RETRIES, base: float = BACKOFF_BASE, most: float = BACKOFF_MAX, jitter: float = JITTER, retryable=RETRYABLE, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.max_retries, self.base, self.most, self.jitter, self.retryable, self.sleep = inner, max_retries, base, most, jitter, retryable, sleep
        self.streams = getattr(inner, "streams", False)

    def request(self, method: str, url: str, headers: dict | None = None, body=None) -> Response:
        body = body_bytes(body)
        most = self.max_retries if body is None or isinstance(body, bytes) else 0
        for attempt in range(most + 1):
            response = self.inner.request(method, url, headers, body)
            if response.status not in self.retryable or attempt == most:
                return response
            delay = backoff_delay(attempt, self.base, self.most)
            self.sleep(delay + delay * self.jitter * random.random())
        raise AssertionError

    def stream(self, *args, **options) -> Response:
        return self.inner.stream(*args, **options)


class BearerTransport:
    """Sets the Authorization header."""

    def __init__(self, inner, token: str):
        self.inner, self.token, self.streams = inner, token, getattr(inner, "streams", False)

    def _headers(self, headers: dict | None) -> dict:
        return {k: v for k, v in (headers or {}).items() if k.lower() != "authorization"} | {"Authorization": f"Bearer {self.token}"}

    def request(self, method: str, url: str, headers: dict | None = None, body=None) -> Response:
        return self.inner.request(method, url, self._headers(headers), body)

    def stream(self, method: str, url: str, headers: dict | None = None, body=None, **options) -> Response:
        return self.inner.stream(method, url, self._headers(headers), body, **options)


def checked_uid(uid: str) -> str:
    if not uid or any(c not in "0123456789." for c in uid):
        raise ValueError(f"not a UID path segment: {uid!r}")
    return uid


class Client:
    """Searches, retrieval and storage at one base url."""

    def __init__(self, base_url: str, transport=None, headers: dict | None = None):
        self.base, self.transport, self.headers = base_url.rstrip("/"), transport or HttpTransport(), headers or {}

    def _url(self, *parts: str, query: Query | None = None) -> str:
        text = query.to_query_string() if query else ""
        return "/".join((self.base, *parts)) + (f"?{text}" if text else "")

    def _checked(self, response: Response) -> Response:
        if not 200 <= response.status < 300:
            response.drain()
            raise DicomwebError(f"status {response.status}")
        return response

    def _get(self, url: str, accept: str) -> Response:
        return self._checked(self.transport.request("GET", url, self.headers | {"Accept": accept}))

    def _page(self, *parts: str, query: Query | None = None) -> tuple[list[dict], bool]:
        """A search's answer, and whether the server warns that there is more of it."""
        response = self._get(self._url(*parts, query=query), "application/dicom+json")
        found = json.loads(response.body or b"[]")
        return found if isinstance(found, list) else [found], (response.header("warning") or "").startswith("299")

    def _search(self, *parts: str, query: Query | None = None) -> list[dict]:
        return self._page(*parts, query=query)[0]

    def pages(self, level: str, query: Query, size: int, offset: int = 0, stop: int | None = None, short_ends: bool = False, study: str = "", series: str = "") -> Iterator[list[dict]]:
        """The results of a search from ``offset`` up to ``stop``, or all, asked for ``size`` at a time.

        A server may hold back results beyond a limit of its own, so the next page starts behind what has come, and
        only an empty page is the end; with ``short_ends``, so is one of fewer than ``size`` without a warning.
        """
        parts = {"studies": ["studies"], "series": ["studies", study, "series"]}.get(level, ["studies", study, "series", series, "instances"])
        for uid in parts[1::2]:
            checked_uid(uid)
        before = None
        while stop is None or offset < stop:
            asked = size if stop is None else min(size, stop - offset)
            found, more = self._page(*parts, query=query.limit(asked).offset(offset))
            if not found:
                return
            if found == before and stop is None and len(found) != asked:
                return  # a server without paging has given all of it at once
            if found == before or (stop is not None and len(found) > asked):
                raise DicomwebError(f"the server does not page: limit={asked}, offset={offset}")
            yield found
            if short_ends and len(found) < asked and not more:
                return
            before, offset = found, offset + len(found)

    def search_studies(self, query: Query | None = None) -> list[dict]:
        return self._search("studies", query=query)

    def search_series(self, study: str, query: Query | None = None) -> list[dict]:
        return self._search("studies", checked_uid(study), "series", query=query)

    def search_instances(self, study: str, series: str, query: Query | None = None) -> list[dict]:
        return self._search("studies", checked_uid(study), "series", checked_uid(series), "instances", query=query)

    def _path(self, study: str, series: str | None, instance: str | None) -> list[str]:
        names = (("studies", study), ("series", series), ("instances", instance))
        return [x for name, uid in names if uid is not None for x in (name, checked_uid(uid))]

    def retrieve(self, study: str, series: str | None = None, instance: str | None = None, accept: str = 'multipart/related; type="application/dicom"') -> Response:
        """A study, a series of it, or an instance of that."""
        return self._get(self._url(*self._path(study, series, instance)), accept)

    def retrieve_parts(self, study: str, series: str | None = None, instance: str | None = None) -> list[Part]:
        response = self.retrieve(study, series, instance)
        return list(parse([response.body], response.header("content-type") or ""))

    def iter_parts(self, study: str, series: str | None = None, instance: str | None = None, chunk_size: int = CHUNK) -> Iterator[Part]:
        """Parts as they arrive, or from a buffered response where the transport does not stream."""
        if not getattr(self.transport, "streams", False):
            yield from self.retrieve_parts(study, series, instance)
            return
        headers = self.headers | {"Accept": 'multipart/related; type="application/dicom"'}
        response = self._checked(self.transport.stream("GET", self._url(*self._path(study, series, instance)), headers, chunk_size=chunk_size))
        try:
            yield from parse(response.stream(), response.header("content-type") or "")
        except ValueError:
            response.drain()  # so that the connection can be used again
            raise

    def study_metadata(self, study: str) -> list[dict]:
        return self._search("studies", checked_uid(study), "metadata")

    def store(self, instances: Iterable[bytes], content_type: str = "application/dicom", study: str | None = None, lazily: bool = False) -> Response:
        """Store instances, with a body made as it is sent if ``lazily`` and the transport streams."""
        boundary = new_boundary()
        url = self._url("studies", *([checked_uid(study)] if study else []))
        if lazily and getattr(self.transport, "streams", False):
            body, kind = generate(instances, content_type, boundary), f'multipart/related; type="{content_type}"; boundary="{boundary}"'
        else:
            body, kind = build(instances, content_type, boundary)
        headers = self.headers | {"Content-Type": kind, "Accept": "application/dicom+json"}
        if isinstance(body, bytes):
            return self._checked(self.transport.request("POST", url, headers, body))
        # a body made as it is sent is sent once: streams are never retried
        response = self.transport.stream("POST", url, headers, body)
        return self._checked(Response(response.status, response.headers, b"".join(response.stream())))


class Page(InputPartition):
    def __init__(self, offset: int, stop: int | None):
        self.offset, self.stop = offset, stop


def client_of(options: dict) -> Client:
    """``url``; ``token``; ``retries``; ``transport``: module:name of a factory of the innermost transport; or
    ``responses``: JSON of recorded ones."""
    if recorded := options.get("responses"):
        transport = StaticTransport(json.loads(recorded))
    elif factory := options.get("transport"):
        import importlib

        module, _, name = factory.partition(":")
        transport = getattr(importlib.import_module(module), name)()
    else:
        transport = PooledTransport(float(options.get("timeout", "30")))
    transport = RetryTransport(transport, int(options.get("retries", str(MAX_RETRIES))))
    return Client(options["url"], BearerTransport(transport, options["token"]) if options.get("token") else transport)


SCHEMA = ", ".join(f"{k} string" for k in ("PatientID", "PatientName", "Modality", "StudyDate", "AccessionNumber", "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID")) + ", dataset string"


class DicomwebReader(DataSourceReader):
    """A search: options ``level`` (studies, or series and instances with ``study`` and ``series``), ``pageSize``
    (results asked for at a time, 1,000 unless given), ``pages``, and any query attribute as ``match.<Keyword>``.

    All results are read. Without ``pages`` one partition asks for page after page until one is empty. With it, so
    many pages are partitions of their own and the last goes on behind its page, until a page is short of
    ``pageSize`` and the server does not warn of more; so ``pageSize`` should be within the server's own limit."""

    def __init__(self, options: dict):
        self.options, self.query = options, Query()
        by_lower = {k.lower(): k for k in TAG_OF}
        for key, value in options.items():
            if key.lower().startswith("match."):
                self.query = self.query.match(by_lower.get(key[6:].lower(), key[6:]), value)

    def partitions(self):
        size, pages = self._size(), max(1, int(self.options.get("pages", "1")))
        return [Page(i * size, (i + 1) * size if i + 1 < pages else None) for i in range(pages)]

    def _size(self) -> int:
        size = int(self.options.get("pagesize", "1000"))
        if size < 1:
            raise ValueError("pageSize must be positive")
        return size

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        level = self.options.get("level", "studies")
        uids = {k: self.options[k] for k in {"studies": [], "series": ["study"]}.get(level, ["study", "series"])}
        pages = client_of(self.options).pages(level, self.query, self._size(), partition.offset, partition.stop, "pages" in self.options and partition.stop is None, **uids)
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

        def value(item: dict, keyword: str):
            first = next(iter(item.get(TAG_OF[keyword], {}).get("Value", [])), None)
            first = first.get("Alphabetic") if isinstance(first, dict) else first
            return None if first is None else str(first)

        for found in pages:
            columns = [pa.array([value(i, n) for i in found], pa.string()) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([json.dumps(i, ensure_ascii=False) for i in found], pa.string())], names=names)


def _asked(df: DataFrame, keys: list[str | None], options: dict, schema: str, answer) -> DataFrame:
    """Rows of ``answer(client, uids)`` for each row of ``df``, behind its identifiers; a failed request is one row
    with its error. A task has one client, so its connections stay open; rows leave it in batches, of which the bytes
    are bounded too."""
    names = [k for k in keys if k]
    fields = [*names, *(f.strip().split(" ")[0] for f in schema.split(", ")), "error"]

    def run(batches):
        client, held, size = client_of(options), [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        for batch in batches:
            for uids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = [(*uids, *row, None) for row in answer(client, uids)]
                except (DicomwebError, ValueError, OSError) as problem:
                    rows = [(*uids, *[None] * (len(fields) - len(uids) - 1), str(problem))]
                for row in rows:
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text = ", ".join(f"`{n}` string" for n in names) + f", {schema}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(text))
    return spread(df.select(*[F.col(n).cast("string") for n in names])).mapInArrow(run, text)


def retrieve_parts(df: DataFrame, options: dict, study: str, series: str | None = None, instance: str | None = None) -> DataFrame:
    """(identifiers, pos, content_type, body, error): the parts of the study, series or instance of each row, as they
    arrive. ``options`` are those of the data source."""

    def answer(client: Client, uids):
        for pos, part in enumerate(client.iter_parts(*uids)):
            yield pos, part.content_type, part.body

    return _asked(df, [study, series, instance], options, "pos int, content_type string, body binary", answer)


def retrieve_whole(df: DataFrame, options: dict, study: str, series: str | None = None, instance: str | None = None) -> DataFrame:
    """(identifiers, content_type, body, error): the whole response for the study, series or instance of each row."""

    def answer(client: Client, uids):
        r = client.retrieve(*uids)
        yield r.header("content-type"), r.body

    return _asked(df, [study, series, instance], options, "content_type string, body binary", answer)


def retrieve_metadata(df: DataFrame, options: dict, study: str) -> DataFrame:
    """(study, pos, dataset, error): the metadata of each row's study, a DICOM JSON text an instance."""

    def answer(client: Client, uids):
        for pos, found in enumerate(client.study_metadata(*uids)):
            yield pos, json.dumps(found, ensure_ascii=False)

    return _asked(df, [study], options, "pos int, dataset string", answer)


def store_column(df: DataFrame, options: dict, id_col: str, contents_col: str, lazily: bool = False) -> DataFrame:
    """(id, status, response, error): one store request a row, of all its contents (an array of binaries)."""

    def run(batches):
        client = client_of(options)
        for batch in batches:
            rows = []
            for key, contents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    r = client.store(contents or [], lazily=lazily)
                    rows.append((key, r.status, r.body.decode("utf-8", "replace"), None))
                except (DicomwebError, ValueError, OSError) as problem:
                    rows.append((key, None, None, str(problem)))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=[id_col, "status", "response", "error"])

    return df.select(F.col(id_col).cast("string"), F.col(contents_col).cast("array<binary>")).mapInArrow(run, f"`{id_col}` string, status int, response string, error string")


class Stored(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class DicomwebWriter(DataSourceWriter):
    """Stores the column ``content`` (Part 10 bytes), up to ``batch`` instances a request."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        client, most, held, n = client_of(self.options), int(self.options.get("batch", "16")), [], 0
        for row in iterator:
            held.append(bytes(row.content))
            if len(held) == most:
                client.store(held)
                held, n = [], n + most
        if held:
            client.store(held)
        return Stored(n + len(held))


class DicomwebDataSource(DataSource):
    @classmethod
    def name(cls):
        return "dicomweb"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return DicomwebReader(dict(self.options))

    def writer(self, schema, overwrite):
        return DicomwebWriter(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(DicomwebDataSource)


__all__ = ["BearerTransport", "Client", "DicomwebDataSource", "DicomwebError", "HttpTransport", "Response", "RetryTransport", "backoff_column", "backoff_delay", "boundary_of", "register"]
