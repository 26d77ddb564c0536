"""Service operators: negotiation, query, move and the framing of messages."""

from __future__ import annotations

import base64
import functools
import json
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of one message at most.
MAX_MESSAGE = 64 << 20
ANY_AE = "ANY-SCP"


def negotiate(called_ae: Column, server_ae: str, requested: Column, supported: list[str]) -> Column:
    """struct(accepted array, error): the requested SOP classes that are supported, in the order of the request."""
    common = F.array_intersect(requested, F.array(*[F.lit(s) for s in supported]))
    error = F.when(~F.coalesce(called_ae.isin(server_ae, ANY_AE), F.lit(False)), F.lit("called AE title not recognized")).when(F.size(common) == 0, F.lit("no common SOP class"))
    return F.struct(F.when(error.isNull(), common).alias("accepted"), error.alias("error"))


def c_find(instances: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The instances that match all keys; an empty key matches anything."""
    from voxelake.operators.qido import Query

    query = Query()
    for name, value in keys.items():
        query = query.match(name, value) if value != "" else query
    return query.apply(instances, order=[])


def c_move(instances: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The instances whose key is wanted: what a move hands to its destination."""
    return instances.join(wanted.select(key).distinct(), key, "left_semi")


def status_class(code: Column) -> Column:
    """success, pending, cancel, warning or failure of a status code."""
    return (
        F.when(code == 0, "success").when(code.isin(0xFF00, 0xFF01), "pending").when(code == 0xFE00, "cancel").when((code == 1) | (F.floor(code / 4096) == 0xB), "warning").otherwise("failure")
    )


def _wrapped(x):
    if isinstance(x, (bytes, bytearray)):
        return {"__bytes__": base64.b64encode(x).decode()}
    raise TypeError(f"no part of a message: {type(x).__name__}")


def _unwrapped(x: dict):
    return base64.b64decode(x["__bytes__"]) if len(x) == 1 and "__bytes__" in x else x


@functools.cache
def _encoder() -> json.JSONEncoder:
    return json.JSONEncoder(default=_wrapped)


@functools.cache
def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(object_hook=_unwrapped)


def frame(message: dict) -> bytes:
    """Four bytes of length, then the JSON object; bytes and nested datasets keep their kind under wrapper keys."""
    body = _encoder().encode(message).encode()
    if len(body) > MAX_MESSAGE:
        raise ValueError("the message is too long")
    return struct.pack(">I", len(body)) + body


def unframe(data: bytes) -> Iterator[dict]:
    """The messages of a byte string of frames."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("a frame is cut short")
        n = struct.unpack_from(">I", data, at)[0]
        if not 0 < n <= MAX_MESSAGE:
            raise ValueError(f"a frame of {n} bytes")
        if at + 4 + n > len(data):
            raise ValueError("a frame is cut short")
        message = _decoder().decode(data[at + 4 : at + 4 + n].decode())
        if not isinstance(message, dict):
            raise ValueError("a message must be an object")
        yield message
        at += 4 + n


def frame_length(data: Column) -> Column:
    """The length that the first four bytes of a frame state."""
    return F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("long")


def route(command: Column) -> Column:
    """The service that handles a message type; anything unknown is an error."""
    known = ("associate", "c-echo", "c-find", "c-move", "c-store", "release")
    return F.when(command.isin(*known), command).otherwise(F.lit("error"))
