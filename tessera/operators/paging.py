"""Keyset and offset pages over sorted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import encode_cursor


def page_size(wanted: int | None, default: int = 10, most: int = 100) -> int:
    """The default for none or nothing, never more than ``most``."""
    return min(wanted, most) if wanted else default


def page(rows: DataFrame, key: str, first: int | None = None, after=None, last: int | None = None, before=None, size: int = 10) -> DataFrame:
    """One page in ascending key order, with ``cursor`` and ``has_more`` (in the direction of travel)."""
    if first is not None and last is not None:
        raise ValueError("first and last exclude each other")
    some = rows
    if after is not None:
        some = some.where(F.col(key) > F.lit(after))
    if before is not None:
        some = some.where(F.col(key) < F.lit(before))
    back = last is not None
    n = page_size(last if back else first, size)
    order = F.col(key).desc() if back else F.col(key).asc()
    probe = some.orderBy(order).limit(n + 1)
    more = F.count("*").over(_all()) > n
    ranked = probe.withColumn("has_more", more).withColumn("_n", F.row_number().over(_all().orderBy(order))).where(F.col("_n") <= n).drop("_n")
    return ranked.withColumn("cursor", encode_cursor(F.col(key))).orderBy(key)


def _all():
    """A window over one page (bounded rows)."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def composite(*columns: str) -> Column:
    """A cursor over several columns."""
    return F.concat_ws("|", *(F.col(c).cast("string") for c in columns))


def offset_page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None, default: int = 20, most: int = 200) -> DataFrame:
    n = max(1, min(default if limit is None else limit, most))
    return rows.orderBy(*order).offset(max(0, offset)).limit(n)
