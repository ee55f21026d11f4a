"""Identifiers: stable hashed ids, 128-bit trace ids, page cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version nibble 8, then a nibble of variant and reserved bits that is 8 as well.
TRACE_ID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}\z"
#: CIDv1 in base32 of a SHA-256: the codecs for DAG-JSON and for raw bytes.
ASSET_ID = r"\A(baguqeera[a-z2-7]{52}|bafkrei[a-z2-7]{52})\z"
MAX_SEQUENCE = (1 << 24) - 1


def stable_id(prefix: str, salt: str, value: Column) -> Column:
    """``prefix`` and 32 hexadecimal digits of the SHA-256 of salt and value."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), F.lit(32)))


def trace_id(millis: Column, operation: Column, sequence: Column) -> Column:
    """The id of (48-bit time, 48-bit operation, 24-bit sequence); null beyond those ranges."""
    time = F.lpad(F.lower(F.hex(millis.cast("long"))), 12, "0")
    op = F.lpad(F.lower(F.hex(operation.cast("long"))), 12, "0")
    seq = F.lpad(F.lower(F.hex(sequence.cast("long"))), 6, "0")
    whole = F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-8"), F.substring(op, 1, 3), F.lit("-8"), F.substring(op, 4, 3), F.lit("-"), F.substring(op, 7, 6), seq)
    fits = millis.between(0, (1 << 48) - 1) & operation.between(0, (1 << 48) - 1) & sequence.between(0, MAX_SEQUENCE)
    return F.when(fits, whole)


def trace_millis(value: Column) -> Column:
    return F.conv(F.substring(F.regexp_replace(value, "-", ""), 1, 12), 16, 10).cast("long")


def trace_operation(value: Column) -> Column:
    digits = F.regexp_replace(value, "-", "")
    return F.conv(F.concat(F.substring(digits, 14, 3), F.substring(digits, 18, 9)), 16, 10).cast("long")


def trace_sequence(value: Column) -> Column:
    return F.conv(F.substring(F.regexp_replace(value, "-", ""), 27, 6), 16, 10).cast("long")


def is_trace_id(value: Column) -> Column:
    return F.coalesce(value.rlike(TRACE_ID), F.lit(False))


def is_asset_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ASSET_ID), F.lit(False))


def encode_cursor(value: Column) -> Column:
    return F.base64(value.cast("string").cast("binary"))


def decode_cursor(value: Column) -> Column:
    return F.unbase64(value).cast("string")
