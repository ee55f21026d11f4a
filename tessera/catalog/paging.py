"""Pages: forward, reverse, bounded, composite, offset, merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query, table
from tessera.operators import paging


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey")


@query("SELECT o_orderkey, base64(o_orderkey::VARCHAR::BLOB) AS cursor, true AS has_more FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25)")
def page_forward(spark, sf_dir):
    return paging.page(_orders(spark, sf_dir), "o_orderkey", first=25, after=100).select("o_orderkey", "cursor", "has_more")


@query("SELECT o_orderkey, base64(o_orderkey::VARCHAR::BLOB) AS cursor, true AS has_more FROM (SELECT o_orderkey FROM orders WHERE o_orderkey < 900 ORDER BY o_orderkey DESC LIMIT 15)")
def page_reverse(spark, sf_dir):
    return paging.page(_orders(spark, sf_dir), "o_orderkey", last=15, before=900).select("o_orderkey", "cursor", "has_more")


@query("SELECT o_orderkey, base64(o_orderkey::VARCHAR::BLOB) AS cursor, false AS has_more FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderkey < 120 ORDER BY o_orderkey LIMIT 50)")
def page_bounded(spark, sf_dir):
    return paging.page(_orders(spark, sf_dir), "o_orderkey", first=50, after=100, before=120).select("o_orderkey", "cursor", "has_more")


@query("SELECT l_orderkey, l_linenumber, l_orderkey || '|' || l_linenumber AS cursor FROM lineitem WHERE (l_orderkey, l_linenumber) > (200, 3) ORDER BY l_orderkey, l_linenumber LIMIT 30")
def page_composite(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    after = F.struct("l_orderkey", "l_linenumber") > F.struct(F.lit(200).cast("long").alias("l_orderkey"), F.lit(3).alias("l_linenumber"))
    return rows.where(after).orderBy("l_orderkey", "l_linenumber").limit(30).withColumn("cursor", paging.composite("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def page_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return paging.offset_page(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 40).select("o_orderkey")


@query("SELECT name, kind FROM (SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region) ORDER BY name, kind LIMIT 12")
def merged_listing(spark, sf_dir):
    """Built-in and user rows in one sorted list, then a slice."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(region.select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))
    return both.orderBy("name", "kind").limit(12)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def difference(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _orders(spark, sf_dir).join(gone, "o_orderkey", "left_anti")


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def distinct_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 6)) AS only_left, 0::BIGINT AS only_right")
def parity(spark, sf_dir):
    """Rows before and after a migration, compared both ways."""
    before = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    after = before.where("l_linenumber < 6")
    left = before.exceptAll(after).agg(F.count("*").alias("only_left"))
    return left.join(after.exceptAll(before).agg(F.count("*").alias("only_right")))
