import gzip

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.functions import ids, values

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4).filter(lambda k: k != "/"), x, max_size=4), max_leaves=12)


@given(JSON)
def test_inline_and_linked_values_agree(value):
    assert values.value_id(value) == values.value_id(values.top_block(value)[2])
    assert values.decode(values.encode(value)) == value


@given(st.dictionaries(st.text(max_size=4).filter(lambda k: k != "/"), JSON, min_size=2, max_size=5))
def test_key_order_does_not_matter(value):
    assert values.value_id(value) == values.value_id(dict(reversed(list(value.items()))))


def test_forms():
    assert values.value_id({}) != values.value_id([])
    assert values.value_id(1.0) == values.value_id(1) and values.value_id(b"x").startswith("bafkrei")
    assert values.value_id({"a": 1}).startswith("baguqeera") and len(values.value_id(None)) == 61
    with pytest.raises(ValueError):
        values.value_id(float("nan"))


def test_resolve_is_idempotent():
    inner = {"x": [1, 2]}
    store = {values.value_id(v): values.top_block(v)[2] for v in (inner, [1, 2])}
    assert values.resolve(values.Link(values.value_id(inner)), store.__getitem__) == inner
    assert values.resolve(inner, store.__getitem__) == inner
    assert values.links_of(values.top_block({"a": [1], "b": [1]})[2]) == [values.value_id([1])]


def test_udfs(spark):
    rows = spark.createDataFrame([(1, '{"a":1}', gzip.compress(b"hi"), "gzip"), (2, "broken", b"plain", None), (3, None, None, "x-gzip")], "k int, t string, b binary, e string")
    got = rows.select("k", values.json_value_id("t").alias("id"), values.json_links("t").alias("l"), values.decompressed("b", "e").alias("d"), ids.is_asset_id(values.json_value_id("t")).alias("ok")).orderBy("k").collect()
    assert got[0].id == values.value_id({"a": 1}) and got[0].ok and bytes(got[0].d) == b"hi"
    assert got[1].id is None and bytes(got[1].d) == b"plain" and not got[1].ok and got[2].d is None


def test_trace_id_bounds(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 0, 0), ((1 << 48) - 1, (1 << 48) - 1, ids.MAX_SEQUENCE), (1, 1, ids.MAX_SEQUENCE + 1)], "m long, o long, s long")
    made = rows.select("m", "o", "s", ids.trace_id(F.col("m"), F.col("o"), F.col("s")).alias("t"))
    got = made.select("*", ids.is_trace_id(F.col("t")).alias("ok"), ids.trace_millis(F.col("t")).alias("m2"), ids.trace_operation(F.col("t")).alias("o2"), ids.trace_sequence(F.col("t")).alias("s2")).collect()
    for r in got[:2]:
        assert r.ok and (r.m, r.o, r.s) == (r.m2, r.o2, r.s2)
    assert got[2].t is None and not got[2].ok
