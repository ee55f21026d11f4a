"""A Markdown workflow language: sections are nodes, list items parameters, wiki links edges.

    # Description
    ## 1. Name (scope:action)
    > a thought
    - parameter: value
    - other: [[1. Name.output]]

Parameters keep their names as target slots, and plain values become const nodes, so a
compiled workflow can be run; ``stringify`` writes JSON literals, so it can be read again.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from tessera.plans.graph import BUILTINS, Edge, GraphError, Node, Pipeline, topological

_HEADER = re.compile(r"^##\s+([0-9a-z.]+)\.\s+(.+?)\s+\((.+?)\)\s*$", re.I)
_PARAMETER = re.compile(r"^-\s+([^:]+):\s*(.*)$")
_LINK = re.compile(r"^\[\[([0-9a-z.]+)\.\s+(.+?)\.([^.]+?)\]\]$", re.I)
_ACTION = re.compile(r"^[\w-]+:[\w-]+$", re.A)
_READ_ONLY = "## ?"


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Link:
    section: str
    name: str
    output: str


@dataclass(frozen=True)
class Section:
    section: str
    name: str
    action: str
    parameters: dict[str, Any] = field(default_factory=dict)
    thoughts: tuple[str, ...] = ()

    def links(self) -> list[tuple[str, Link]]:
        return [(key, link) for key, value in self.parameters.items() for link in _links(value)]


@dataclass(frozen=True)
class Workflow:
    sections: tuple[Section, ...]
    description: str | None = None


@dataclass(frozen=True)
class Issue:
    kind: str
    message: str
    section: str | None = None


def _links(value: Any) -> list[Link]:
    if isinstance(value, Link):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [x for v in inner for x in _links(v)]


def parse_value(text: str) -> Any:
    """A link, a JSON value (links may stand in its strings), or the bare text."""
    if m := _LINK.match(text):
        return Link(*(x.strip() for x in m.groups()))
    try:
        found = json.loads(text)
    except ValueError:
        return text
    return _linked(found)


def _linked(value: Any) -> Any:
    if isinstance(value, str):
        m = _LINK.match(value)
        return Link(*(x.strip() for x in m.groups())) if m else value
    if isinstance(value, list):
        return [_linked(x) for x in value]
    if isinstance(value, dict):
        return {k: _linked(v) for k, v in value.items()}
    return value


def section_key(section: str) -> tuple:
    """Numbers in number order, before letters; a section comes before its subsections."""
    parts = []
    for part in section.split("."):
        m = re.match(r"\d+", part)
        parts.append((0, int(m.group()), "") if m else (1, 0, part))
    return tuple(parts)


def order_issues(sections: list[str]) -> list[Issue]:
    out, seen = [], set()
    for x in sections:
        if x in seen:
            out.append(Issue("duplicate_section", f"section {x} occurs twice", x))
        seen.add(x)
    for a, b in zip(sections, sections[1:]):
        if section_key(a) >= section_key(b):
            out.append(Issue("invalid_section_order", f"section {b} must come after {a}", b))
    return out


def parse(text: str) -> Workflow:
    if _READ_ONLY in text:
        raise ParseError("sections marked with ? are for reading only")
    sections: list[Section] = []
    head: tuple[str, str, str] | None = None
    parameters: dict[str, Any] = {}
    thoughts: list[str] = []
    description = None

    def close() -> None:
        if head:
            sections.append(Section(*head, dict(parameters), tuple(thoughts)))

    for line in map(str.strip, text.split("\n")):
        if m := _HEADER.match(line):
            close()
            head, parameters, thoughts = tuple(x.strip() for x in m.groups()), {}, []
        elif line.startswith(">"):
            thoughts.append(line[1:].strip())
        elif head and (m := _PARAMETER.match(line)):
            parameters[m.group(1).strip()] = parse_value(m.group(2).strip())
        elif line.startswith("# ") and description is None:
            description = line[2:].strip()
    close()
    if issues := order_issues([x.section for x in sections]):
        raise ParseError("; ".join(x.message for x in issues))
    return Workflow(tuple(sections), description)


def validate(workflow: Workflow) -> tuple[list[Issue], list[Issue]]:
    """(errors, warnings)."""
    names = [x.section for x in workflow.sections]
    errors = order_issues(names)
    needs = {x.section: [link.section for _, link in x.links()] for x in workflow.sections}
    known = set(names)
    for x in workflow.sections:
        errors += [Issue("undefined_reference", f"section {x.section} refers to {n}, which is not there", x.section) for n in needs[x.section] if n not in known]
        if x.action not in BUILTINS and not _ACTION.match(x.action):
            errors.append(Issue("invalid_action_id", f"{x.action!r} is neither scope:action nor built in", x.section))
    try:
        topological(names, {k: [n for n in v if n in known] for k, v in needs.items()})
    except GraphError as e:
        errors.append(Issue("cycle_detected", str(e)))
    place = {x: k for k, x in enumerate(names)}
    late = any(place[n] >= place[x] for x in names for n in needs[x] if n in place)
    return errors, [Issue("non_topological_order", "a section stands before one it needs")] if late else []


def to_pipeline(workflow: Workflow) -> Pipeline:
    nodes: dict[str, Node] = {}
    edges: list[Edge] = []
    for x in workflow.sections:
        if x.action == "const":
            if "value" not in x.parameters:
                raise ParseError(f"const section {x.section} has no value")
            nodes[x.section] = Node("const", x.parameters["value"])
            continue
        nodes[x.section] = Node(x.action)
        for key, value in x.parameters.items():
            if isinstance(value, Link):
                edges.append(Edge(value.section, value.output, x.section, key))
            elif _links(value):
                raise ParseError(f"section {x.section}: links inside {key} can't be edges")
            else:
                nodes[f"{x.section}/{key}"] = Node("const", value)
                edges.append(Edge(f"{x.section}/{key}", "output", x.section, key))
    known = set(nodes)
    for e in edges:
        if e.source not in known:
            raise ParseError(f"section {e.target} refers to {e.source}, which is not there")
    return Pipeline(nodes, tuple(edges), workflow.description or "Compiled Workflow")


def compile_text(text: str) -> Pipeline:
    return to_pipeline(parse(text))


def _plain(value: Any) -> Any:
    if isinstance(value, Link):
        return f"[[{value.section}. {value.name}.{value.output}]]"
    if isinstance(value, list):
        return [_plain(x) for x in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def stringify(workflow: Workflow, read_only: bool = False) -> str:
    """The text of a workflow; ``parse`` reads it back unless it is read-only."""
    out = [f"# {workflow.description}", ""] if workflow.description else []
    for x in workflow.sections:
        out.append(f"## {'? ' if read_only else ''}{x.section}. {x.name} ({x.action})")
        out += [f"> {t}" for t in x.thoughts]
        out += [f"- {k}: {_plain(v) if isinstance(v, Link) else json.dumps(_plain(v), ensure_ascii=False)}" for k, v in x.parameters.items()]
        out.append("")
    return "\n".join(out)
