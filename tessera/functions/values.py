"""Content-addressed values: canonical JSON, Merkle identifiers, links.

A value's identifier is a CIDv1 over SHA-256: raw bytes use the raw codec, everything else
DAG-JSON (map keys sorted, no white space).  Nested arrays, objects and bytes count by
their own identifier, so a value and the same value with parts replaced by links agree.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes of the multiformats tables (fixed values): version 1, codec, sha2-256 of 32 bytes.
_RAW = bytes([0x01, 0x55, 0x12, 0x20])
_DAG_JSON = bytes([0x01, 0xA9, 0x02, 0x12, 0x20])


class Link(str):
    """The identifier of another value."""


def _cid(prefix: bytes, block: bytes) -> str:
    return "b" + base64.b32encode(prefix + hashlib.sha256(block).digest()).decode().rstrip("=").lower()


def _number(value: int | float) -> int | float:
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("numbers must be finite")
        if value.is_integer() and abs(value) < 1 << 53:
            return int(value)
    return value


def encode(value: Any) -> bytes:
    """DAG-JSON of a value; links and bytes in their reserved form."""

    def plain(x: Any) -> Any:
        if isinstance(x, Link):
            return {"/": str(x)}
        if isinstance(x, (bytes, bytearray)):
            return {"/": {"bytes": base64.b64encode(bytes(x)).decode().rstrip("=")}}
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return _number(x)
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def decode(block: bytes) -> Any:
    """The value of a DAG-JSON block."""

    def own(x: Any) -> Any:
        if isinstance(x, dict):
            if set(x) == {"/"}:
                inner = x["/"]
                if isinstance(inner, str):
                    return Link(inner)
                if isinstance(inner, dict) and set(inner) == {"bytes"}:
                    return base64.b64decode(inner["bytes"] + "=" * (-len(inner["bytes"]) % 4))
            return {k: own(v) for k, v in x.items()}
        return [own(v) for v in x] if isinstance(x, list) else x

    return own(json.loads(block))


def top_block(value: Any) -> tuple[str, bytes, Any]:
    """(identifier, block, the value with nested parts as links)."""
    if isinstance(value, (bytes, bytearray)):
        return _cid(_RAW, bytes(value)), bytes(value), value
    flat = value
    if isinstance(value, dict):
        flat = {k: _flat(v) for k, v in value.items()}
    elif isinstance(value, (list, tuple)):
        flat = [_flat(v) for v in value]
    block = encode(flat)
    return _cid(_DAG_JSON, block), block, flat


def _flat(value: Any) -> Any:
    if isinstance(value, Link):
        return value
    return Link(top_block(value)[0]) if isinstance(value, (dict, list, tuple, bytes, bytearray)) else value


def value_id(value: Any) -> str:
    return str(value) if isinstance(value, Link) else top_block(value)[0]


def links_of(value: Any) -> list[str]:
    """Identifiers of all links inside a value, each once, in order."""
    if isinstance(value, Link):
        return [str(value)]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else ()
    return list(dict.fromkeys(x for v in inner for x in links_of(v)))


def resolve(value: Any, load) -> Any:
    """``value`` with every link replaced by what ``load`` finds for it, all the way down."""
    if isinstance(value, Link):
        return resolve(load(str(value)), load)
    if isinstance(value, dict):
        return {k: resolve(v, load) for k, v in value.items()}
    return [resolve(v, load) for v in value] if isinstance(value, (list, tuple)) else value


@F.pandas_udf(T.StringType())
def json_value_id(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The identifier of each JSON text's value; null where it isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else value_id(decode(text.encode()))
        except ValueError:
            return None

    for batch in texts:
        yield batch.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_links(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The links inside each JSON text."""

    def one(text: str | None) -> list[str]:
        try:
            return [] if text is None else links_of(decode(text.encode()))
        except ValueError:
            return []

    for batch in texts:
        yield batch.map(one)


@F.pandas_udf(T.BinaryType())
def decompressed(data: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bodies by their content encoding: gzip, deflate, or as they are."""
    import gzip
    import zlib

    def one(body: bytes | None, encoding: str | None) -> bytes | None:
        kind = (encoding or "identity").lower()
        if body is None or kind == "identity":
            return body
        if kind in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if kind == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -15)
        raise ValueError(f"unknown content encoding {kind}")

    for bodies, encodings in data:
        yield pd.Series([one(b, e) for b, e in zip(bodies, encodings)], dtype=object)


def task_id(action: Column, inputs: Column) -> Column:
    """The content-hashed id of an action applied to (already hashed) inputs."""
    return F.sha2(F.concat_ws("\n", action, inputs), 256)
