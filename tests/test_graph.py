import pytest
from pyspark.sql import functions as F

from tessera.operators import dataflow as flow
from tessera.plans.graph import Edge, GraphError, Node, Pipeline, plan, slot_kind, topological


def test_slot_kinds():
    assert [slot_kind(x) for x in ("%a", "^b", "c", "")] == ["context", "meta", "data", "data"]


def test_types_and_slots():
    p = plan(Pipeline({"a": Node("x"), "b": Node("x"), "c": Node("y"), "s": Node("split")}, (Edge(None, "i", "a", "i"), Edge(None, "i", "b", "i"), Edge("a", "o", "c", "p"), Edge("b", "o", "c", "q"), Edge("b", "%k", "c", "%k"), Edge("a", "^m", "c", "^m"), Edge("c", "o", "s", "items"), Edge("s", "item", None, "r"))))
    assert p.types == {"a": "regular", "b": "regular", "c": "join", "s": "split", None: "regular"}
    assert p.slots("c", "data") == ("p", "q") and p.slots("c", "context") == ("%k",) and p.slots("c", "meta") == ("^m",)
    assert p.order.index("c") > max(p.order.index("a"), p.order.index("b"))


def test_builtin_with_two_sources():
    with pytest.raises(GraphError):
        plan(Pipeline({"a": Node("x"), "b": Node("x"), "s": Node("split")}, (Edge("a", "o", "s", "items"), Edge("b", "o", "s", "items"))))


def test_topological_is_stable_and_checks():
    assert topological("dcba", {"d": "a"}) == ["a", "d", "c", "b"]
    with pytest.raises(GraphError, match="cycle"):
        topological("ab", {"a": "b", "b": "a"})
    with pytest.raises(GraphError, match="not there"):
        topological("a", {"a": "z"})


ADD = {"add": flow.Action(("A", "B"), column=lambda c: {"output": c["A"] + c["B"]})}


def test_sum_of_three(spark):
    graph = Pipeline({"n1": Node("add"), "n2": Node("add")}, (Edge(None, "A", "n1", "A"), Edge(None, "B", "n1", "B"), Edge("n1", "output", "n2", "A"), Edge(None, "C", "n2", "B"), Edge("n2", "output", None, "result")))
    inputs = spark.createDataFrame([(1, 1, 2, 3)], "run int, A int, B int, C int")
    assert [r.result for r in flow.run(graph, inputs, ADD, ("run",)).collect()] == [6]


def test_empty_split_gives_no_output_and_order_holds(spark):
    from tessera.catalog.flow import _split_merge

    inputs = spark.createDataFrame([(1, [(1, 2), (3, 4)]), (2, []), (3, [(5, 6)])], "run int, items array<struct<A:int,B:int>>")
    out = flow.run(_split_merge("add"), inputs, ADD, ("run",)).collect()
    assert {r.run: r.result for r in out} == {1: [3, 7], 3: [11]}


def test_gather_waits_for_all_and_takes_the_last(spark):
    rows = spark.createDataFrame([(1, 2, 0, "a", 1), (1, 2, 0, "b", 2), (1, 2, 1, "c", 1), (2, 2, 0, "d", 1)], "run int, keys int, key int, item string, _order int")
    assert [(r.run, r.output) for r in flow.gather(rows, ("run",)).collect()] == [(1, ["b", "c"])]


def test_object_gather(spark):
    rows = spark.createDataFrame([(1, ["x", "y"], "x", 1), (1, ["x", "y"], "y", 2), (2, ["x", "y"], "y", 3)], "run int, keys array<string>, key string, item int")
    assert [(r.run, r.output) for r in flow.gather(rows, ("run",)).collect()] == [(1, {"x": 1, "y": 2})]


def test_split_of_a_primitive_is_an_error(spark):
    with pytest.raises(TypeError):
        flow.split(spark.createDataFrame([(1, 2)], "run int, items int"))


def test_context_is_rebuilt_and_missing_leaves_are_skipped(spark):
    frame = spark.createDataFrame([(1, 7, 8, (5,))], "run int, `%a` int, `%b` int, x struct<y:int>")
    group = plan(Pipeline({"n": Node("f")}, (Edge("n", "%b", None, "%b"), Edge("n", "x.y", None, "y"), Edge("n", "x.z", None, "z"), Edge("n", "gone", None, "g")))).groups[None][0]
    assert flow.project(frame, group, ("run",)).columns == ["run", "%b", "y"]
    bad = plan(Pipeline({"n": Node("f")}, (Edge("n", "gone.y", None, "y"),))).groups[None][0]
    with pytest.raises(KeyError):
        flow.project(frame, bad, ("run",))


def test_null_counts_as_present(spark):
    frame = spark.createDataFrame([(1, None)], "run int, A int")
    out = flow.applied(frame, flow.Action(("A",), column=lambda c: {"output": F.coalesce(c["A"], F.lit(9))}), ("run",))
    assert out.first().output == 9


def test_memoised_runs_once_for_each_input(spark):
    seen = spark.sparkContext.accumulator(0)

    def rows(df):
        def run(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf.assign(output=pdf["x"] * 2)

        return df.mapInPandas(run, "x double, output double")

    frame = spark.createDataFrame([(k, float(k % 3)) for k in range(30)] + [(30, None)], "run int, x double")
    out = flow.memoised(frame, flow.Action(("x",), rows=rows)).collect()
    assert len(out) == 31 and seen.value == 4


def test_split_then_gather_is_identity(spark):
    inputs = spark.createDataFrame([(k, list(range(k))) for k in range(1, 8)], "run int, items array<int>")
    back = flow.gather(flow.split(inputs), ("run",))
    assert sorted((r.run, r.output) for r in back.collect()) == sorted((r.run, r["items"]) for r in inputs.collect())


def test_downstream_any_number_of_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a int, b int")
    start = spark.createDataFrame([(1,)], "v int")
    assert sorted(r.v for r in flow.downstream(edges, start, None).collect()) == [2, 3, 4]
    assert [r.v for r in flow.downstream(edges, start).collect()] == [2]
