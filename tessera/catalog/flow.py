"""Dataflow queries: split, gather, joins of sources, constants, memoised actions, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.registry import query, table
from tessera.operators import dataflow as flow
from tessera.plans.graph import Edge, Node, Pipeline


def _split_merge(action: str) -> Pipeline:
    """items -> split -> action(A, B) -> merge -> result, in the order of the items."""
    return Pipeline(
        {"split": Node("split"), "add": Node(action), "merge": Node("merge")},
        (
            Edge(None, "items", "split", "items"),
            Edge("split", "keys", "add", "%keys"),
            Edge("split", "key", "add", "%key"),
            Edge("split", "item.A", "add", "A"),
            Edge("split", "item.B", "add", "B"),
            Edge("add", "%keys", "merge", "keys"),
            Edge("add", "%key", "merge", "key"),
            Edge("add", "output", "merge", "item"),
            Edge("merge", "output", None, "result"),
        ),
    )


ADD = flow.Action(("A", "B"), column=lambda c: {"output": (c["A"] + c["B"]).cast("decimal(18,2)")})


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: its line items in line order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("A"), F.col("l_quantity").cast("decimal(18,2)").alias("B"))
    lines = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "A", "B"))).alias("x"))
    return lines.select("l_orderkey", F.transform("x", lambda i: F.struct(i.A.alias("A"), i.B.alias("B"))).alias("items"))


def _rendered(out: DataFrame) -> DataFrame:
    total = F.aggregate("result", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x).cast("decimal(28,2)"))
    return out.select("l_orderkey", F.size("result").cast("long").alias("n_items"), F.array_join(F.transform("result", lambda x: x.cast("string")), ",").alias("result"), total.cast("string").alias("total"))


_MERGED = """
SELECT l_orderkey, count(*)::BIGINT AS n_items,
       string_agg((l_extendedprice::DECIMAL(18,2) + l_quantity::DECIMAL(18,2))::DECIMAL(18,2)::VARCHAR, ',' ORDER BY l_linenumber, l_extendedprice, l_quantity) AS result,
       sum((l_extendedprice::DECIMAL(18,2) + l_quantity::DECIMAL(18,2))::DECIMAL(18,2))::DECIMAL(28,2)::VARCHAR AS total
FROM lineitem {where} GROUP BY l_orderkey
"""


@query(_MERGED.format(where=""))
def split_merge_array(spark, sf_dir):
    return _rendered(flow.run(_split_merge("math:add"), _items(spark, sf_dir), {"math:add": ADD}, ("l_orderkey",)))


@query(
    """SELECT l_orderkey, n_items, result, total FROM ("""
    + _MERGED.format(where="")
    + """) WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def split_merge_incomplete(spark, sf_dir):
    """Returned items never complete, so their orders have no result."""
    graph = _split_merge("math:add")
    plain = table(spark, sf_dir, "lineitem")
    items = plain.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("A"), F.col("l_quantity").cast("decimal(18,2)").alias("B"), F.col("l_returnflag").alias("flag")))).alias("x"))
    inputs = items.select("l_orderkey", F.transform("x", lambda i: F.struct(i.A.alias("A"), i.B.alias("B"), i.flag.alias("flag"))).alias("items"))
    split = flow.split(inputs)
    done = split.where("item.flag <> 'R'").select("l_orderkey", "keys", "key", (F.col("item.A") + F.col("item.B")).cast("decimal(18,2)").alias("item"))
    assert graph.nodes["merge"].action == "merge"
    return _rendered(flow.gather(done, ("l_orderkey",)).withColumnRenamed("output", "result"))


@query("""
SELECT o_custkey, string_agg(k || '=' || v::VARCHAR, ',' ORDER BY k) AS result
FROM (SELECT o_custkey, o_orderpriority AS k, (count(*) * 2)::BIGINT AS v FROM orders GROUP BY o_custkey, o_orderpriority)
GROUP BY o_custkey
""")
def split_object_merge(spark, sf_dir):
    """An object of counts is split by name, doubled, and gathered under the same names."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    inputs = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("items"))
    graph = Pipeline(
        {"split": Node("split"), "twice": Node("math:twice"), "merge": Node("merge")},
        (
            Edge(None, "items", "split", "items"),
            Edge("split", "keys", "twice", "%keys"),
            Edge("split", "key", "twice", "%key"),
            Edge("split", "item", "twice", "x"),
            Edge("twice", "%keys", "merge", "keys"),
            Edge("twice", "%key", "merge", "key"),
            Edge("twice", "output", "merge", "item"),
            Edge("merge", "output", None, "result"),
        ),
    )
    out = flow.run(graph, inputs, {"math:twice": flow.Action(("x",), column=lambda c: {"output": c["x"] * 2})}, ("o_custkey",))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("result")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return out.select("o_custkey", text.alias("result"))


@query("""
SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) + c_acctbal::DECIMAL(18,2) + 7)::DECIMAL(20,2)::VARCHAR AS result
FROM orders JOIN customer ON c_custkey = o_custkey
""")
def merge_node_join(spark, sf_dir):
    """Two regular nodes and a constant meet in a third: a join on the run (and an equal context)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    inputs = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), F.col("o_custkey").alias("customer"))
    same = flow.Action(("x",), column=lambda c: {"output": c["x"]})
    add = flow.Action(("A", "B", "C"), column=lambda c: {"output": (c["A"] + c["B"] + c["C"]).cast("decimal(20,2)")})
    graph = Pipeline(
        {"price": Node("same"), "balance": Node("same"), "sum": Node("add"), "seven": Node("const", 7)},
        (
            Edge(None, "price", "price", "x"),
            Edge(None, "balance", "balance", "x"),
            Edge("price", "output", "sum", "A"),
            Edge("balance", "output", "sum", "B"),
            Edge("seven", "output", "sum", "C"),
            Edge("sum", "output", None, "result"),
        ),
    )
    return flow.run(graph, inputs, {"same": same, "add": add}, ("o_orderkey",)).withColumn("result", F.col("result").cast("string"))


@query("SELECT c_custkey, round(c_acctbal * 0.1, 4) AS fee, '10%' AS rate FROM customer")
def const_node(spark, sf_dir):
    graph = Pipeline(
        {"rate": Node("const", {"value": 0.1, "text": "10%"}), "fee": Node("fee")},
        (Edge(None, "balance", "fee", "balance"), Edge("rate", "output.value", "fee", "rate"), Edge("fee", "output", None, "fee"), Edge("rate", "output.text", None, "rate")),
    )
    inputs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    fee = flow.Action(("balance", "rate"), column=lambda c: {"output": F.round(c["balance"] * c["rate"], 4)})
    return flow.run(graph, inputs, {"fee": fee}, ("c_custkey",))


@query("SELECT o_orderkey, o_orderstatus AS status, length(o_orderpriority)::BIGINT AS result FROM orders")
def meta_passthrough(spark, sf_dir):
    """Metadata goes round the action and back in as data; it isn't part of the action's input."""
    graph = Pipeline(
        {"measure": Node("measure"), "wrap": Node("wrap")},
        (Edge(None, "priority", "measure", "x"), Edge(None, "status", "measure", "^status"), Edge("measure", "output", "wrap", "x"), Edge("measure", "^status", "wrap", "status"), Edge("wrap", "status", None, "status"), Edge("wrap", "output", None, "result")),
    )
    inputs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    measure = flow.Action(("x",), column=lambda c: {"output": F.length(c["x"]).cast("long")})
    wrap = flow.Action(("x", "status"), column=lambda c: {"output": c["x"], "status": c["status"]}, outputs=("output", "status"))
    return flow.run(graph, inputs, {"measure": measure, "wrap": wrap}, ("o_orderkey",))


def _reverse(rows: DataFrame) -> DataFrame:
    """A row function in Python, called once for each distinct input."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(output=pdf["x"].map(lambda v: None if v is None else v[::-1]))

    return rows.mapInPandas(run, "x string, output string")


@query("SELECT l_orderkey, l_linenumber, reverse(l_returnflag || l_linestatus) AS result FROM lineitem")
def memoised_action(spark, sf_dir):
    """Few distinct inputs: the row function runs on those and is joined back."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("x"))
    return flow.memoised(rows, flow.Action(("x",), rows=_reverse)).select("l_orderkey", "l_linenumber", F.col("output").alias("result"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN 'error: too many lines' ELSE NULL END AS error, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber * 10 END::BIGINT AS output FROM lineitem")
def failing_action(spark, sf_dir):
    """Errors of an action are rows of their own kind."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(n > 5, F.lit("error: too many lines")).alias("error"), F.when(n <= 5, (n * 10).cast("long")).alias("output"))


@query("SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS b FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_linenumber = 1 THEN 1 END) > 0 AND count(CASE WHEN l_linenumber = 2 THEN 1 END) > 0")
def combine_latest(spark, sf_dir):
    """The latest value of each slot; a row once all slots are there."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_orderkey", F.col("l_linenumber").alias("slot"), F.col("l_quantity").alias("value"), F.col("l_linenumber").alias("position"))
    last = rows.groupBy("l_orderkey", "slot").agg(F.max(F.struct("position", "value")).getField("value").alias("value"))
    out = last.groupBy("l_orderkey").pivot("slot", [1, 2]).agg(F.first("value"))
    return out.where("`1` is not null and `2` is not null").select("l_orderkey", F.col("1").alias("a"), F.col("2").alias("b"))


@query("""
SELECT doc_id, CASE WHEN lang = 'en' AND length(text) % 2 = 0 THEN 'STALE' ELSE 'FRESH' END AS dependency_status
FROM documents
""")
def stale_nodes(spark, sf_dir):
    """Inputs are hashed before and after an edit; only changed ones are stale."""
    docs = table(spark, sf_dir, "documents")
    edited = F.when((F.col("lang") == "en") & (F.length("text") % 2 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = docs.select("doc_id", flow.input_hash({"text": F.col("text"), "lang": F.col("lang")}).alias("input_hash"))
    after = docs.select("doc_id", flow.input_hash({"text": edited, "lang": F.col("lang")}).alias("input_hash"))
    return flow.stale(before, after, ["doc_id"]).select("doc_id", "dependency_status")


_CHAIN = """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_orderkey + l_linenumber AS b FROM lineitem WHERE l_linenumber <= 2),
s AS (SELECT DISTINCT l_orderkey AS v FROM lineitem WHERE l_orderkey % 97 = 0),
"""


def _edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("b")).distinct()
    return edges, lines.where("l_orderkey % 97 = 0").select(F.col("l_orderkey").alias("v")).distinct()


@query(_CHAIN + "r AS (SELECT DISTINCT b AS v FROM e JOIN s ON s.v = e.a) SELECT v FROM r WHERE v NOT IN (SELECT v FROM s)")
def stale_one_hop(spark, sf_dir):
    return flow.downstream(*_edges(spark, sf_dir), hops=1)


@query(_CHAIN + "r(v, d) AS (SELECT v, 0 FROM s UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.v WHERE r.d < 3) SELECT DISTINCT v FROM r WHERE v NOT IN (SELECT v FROM s)")
def stale_three_hops(spark, sf_dir):
    return flow.downstream(*_edges(spark, sf_dir), hops=3)


@query("SELECT DISTINCT l_orderkey, md5(l_returnflag) AS changed FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> l_linestatus")
def changed_outputs(spark, sf_dir):
    """Redelivered results whose hash differs from the one in use start a new fork."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    used = rows.select("l_orderkey", F.md5("l_linestatus").alias("used"))
    new = rows.select("l_orderkey", F.md5("l_returnflag").alias("changed"))
    return new.join(used, "l_orderkey").where("changed <> used").select("l_orderkey", "changed").distinct()


@query("SELECT l_orderkey, string_agg((2 * (l_linenumber + l_quantity::INT))::VARCHAR, ',' ORDER BY l_linenumber, l_quantity::INT) AS result FROM lineitem GROUP BY l_orderkey")
def nested_workflow(spark, sf_dir):
    """The action inside split and gather is a workflow of two actions."""
    inner = Pipeline({"sum": Node("sum"), "twice": Node("twice")}, (Edge(None, "A", "sum", "A"), Edge(None, "B", "sum", "B"), Edge("sum", "output", "twice", "x"), Edge("twice", "output", None, "output")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("B"))
    items = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "B"))), lambda x: F.struct(x.l_linenumber.alias("A"), x.B.alias("B"))).alias("items"))
    actions = {
        "inner": inner,
        "sum": flow.Action(("A", "B"), column=lambda c: {"output": c["A"] + c["B"]}),
        "twice": flow.Action(("x",), column=lambda c: {"output": c["x"] * 2}),
    }
    out = flow.run(_split_merge("inner"), items, actions, ("l_orderkey",))
    return out.select("l_orderkey", F.array_join(F.transform("result", lambda x: x.cast("string")), ",").alias("result"))
