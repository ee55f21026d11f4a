import pytest

from tessera.operators import dataflow as flow
from tessera.plans import dsl
from tessera.plans.graph import plan

TEXT = """# Sum of three
## 1. First (math:add)
> add two
- A: 1
- B: 2
## 2. Second (math:add)
- A: [[1. First.output]]
- B: 3
"""


def test_parse_and_compile():
    workflow = dsl.parse(TEXT)
    assert workflow.description == "Sum of three" and [x.section for x in workflow.sections] == ["1", "2"]
    assert workflow.sections[0].thoughts == ("add two",)
    assert workflow.sections[1].parameters["A"] == dsl.Link("1", "First", "output")
    pipeline = dsl.to_pipeline(workflow)
    assert {(e.source, e.target, e.target_handle) for e in pipeline.edges} == {("1/A", "1", "A"), ("1/B", "1", "B"), ("1", "2", "A"), ("2/B", "2", "B")}


def test_compiled_text_runs(spark):
    from dataclasses import replace

    from tessera.plans.graph import Edge

    pipeline = dsl.compile_text(TEXT)
    pipeline = replace(pipeline, edges=(*pipeline.edges, Edge("2", "output", None, "result")))
    add = {"math:add": flow.Action(("A", "B"), column=lambda c: {"output": c["A"] + c["B"]})}
    assert flow.run(plan(pipeline), spark.createDataFrame([(1,)], "run int"), add, ("run",)).first().result == 6


def test_values():
    assert dsl.parse_value("null") is None and dsl.parse_value("true") is True and dsl.parse_value("2.5") == 2.5
    assert dsl.parse_value('"a b"') == "a b" and dsl.parse_value("bare text") == "bare text"
    assert dsl.parse_value('[1, "x", {"k": null}]') == [1, "x", {"k": None}]


def test_round_trip():
    text = '## 1. A (x:y)\n- q: "say \\"hi\\""\n- o: {"k": ["v", 1]}\n## 1.2. B (merge)\n- keys: [[1. A.output]]\n'
    assert dsl.parse(dsl.stringify(dsl.parse(text))) == dsl.parse(text)


def test_read_only_and_order():
    with pytest.raises(dsl.ParseError):
        dsl.parse(dsl.stringify(dsl.parse(TEXT), read_only=True))
    with pytest.raises(dsl.ParseError):
        dsl.parse("## 2. A (x:y)\n## 1. B (x:y)")
    assert sorted(["10", "2", "1.a", "1", "1.10", "1.9"], key=dsl.section_key) == ["1", "1.9", "1.10", "1.a", "2", "10"]


def test_validate():
    w = dsl.Workflow((dsl.Section("1", "A", "bad action", {"x": dsl.Link("2", "B", "o")}), dsl.Section("2", "B", "const", {"x": dsl.Link("1", "A", "o")}), dsl.Section("3", "C", "core:x", {"x": dsl.Link("9", "Z", "o")})))
    errors, warnings = dsl.validate(w)
    assert {x.kind for x in errors} == {"invalid_action_id", "cycle_detected", "undefined_reference"}
    assert [x.kind for x in warnings] == ["non_topological_order"]
    assert dsl.validate(dsl.parse(TEXT)) == ([], [])
