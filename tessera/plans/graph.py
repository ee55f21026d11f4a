"""Dataflow graphs and the planner: node types, grouped edges, slots."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field
from typing import Any

CONTEXT, META = "%", "^"
BUILTINS = ("split", "merge", "const")


def slot_kind(name: str) -> str:
    """context, meta or data, by the first character."""
    return {CONTEXT: "context", META: "meta"}.get(name[:1], "data")


@dataclass(frozen=True)
class Node:
    action: str
    value: Any = None  # of const nodes


@dataclass(frozen=True)
class Edge:
    """source or target None: the graph's input or output."""

    source: str | None
    source_handle: str
    target: str | None
    target_handle: str


@dataclass(frozen=True)
class Pipeline:
    nodes: dict[str, Node]
    edges: tuple[Edge, ...]
    description: str = ""
    input_schema: dict = field(default_factory=dict)
    output_schema: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EdgeGroup:
    """All edges from one source to one target, by kind of the target slot."""

    source: str | None
    target: str | None
    context: tuple[Edge, ...]
    data: tuple[Edge, ...]
    meta: tuple[Edge, ...]


@dataclass(frozen=True)
class Plan:
    pipeline: Pipeline
    types: dict[str | None, str]  # regular, join, split, merge, const; None is the output
    groups: dict[str | None, tuple[EdgeGroup, ...]]  # by target
    order: tuple[str, ...]

    def slots(self, node: str | None, kind: str) -> tuple[str, ...]:
        return tuple(sorted({e.target_handle for g in self.groups.get(node, ()) for e in getattr(g, kind)}))


class GraphError(ValueError):
    pass


def topological(items: Iterable[Hashable], needs: dict[Hashable, Iterable[Hashable]]) -> list:
    """Items after all they need, otherwise in the order given; raises on cycles and unknown references."""
    items = list(items)
    known, done, active, out = set(items), set(), set(), []
    for root in items:
        stack = [(root, iter(needs.get(root, ())))]
        if root in done:
            continue
        active.add(root)
        while stack:
            item, rest = stack[-1]
            for need in rest:
                if need not in known:
                    raise GraphError(f"{item!r} needs {need!r}, which is not there")
                if need in active:
                    raise GraphError(f"cycle through {need!r}")
                if need not in done:
                    active.add(need)
                    stack.append((need, iter(needs.get(need, ()))))
                    break
            else:
                stack.pop()
                active.discard(item)
                done.add(item)
                out.append(item)
    return out


def plan(pipeline: Pipeline) -> Plan:
    """Type every node and group its edges; several sources make a regular node a join."""
    grouped: dict[str | None, dict[str | None, list[Edge]]] = {}
    for e in pipeline.edges:
        for end in (e.source, e.target):
            if end is not None and end not in pipeline.nodes:
                raise GraphError(f"edge to unknown node {end!r}")
        grouped.setdefault(e.target, {}).setdefault(e.source, []).append(e)
    types: dict[str | None, str] = {}
    for name, node in pipeline.nodes.items():
        sources = len(grouped.get(name, {}))
        if node.action in BUILTINS:
            if sources > 1:
                raise GraphError(f"{node.action} node {name!r} has {sources} sources")
            types[name] = node.action
        else:
            types[name] = "join" if sources > 1 else "regular"
    types[None] = "join" if len(grouped.get(None, {})) > 1 else "regular"
    groups = {}
    for target, sources in grouped.items():
        groups[target] = tuple(EdgeGroup(s, target, *(tuple(e for e in edges if slot_kind(e.target_handle) == k) for k in ("context", "data", "meta"))) for s, edges in sources.items())
    needs = {n: [g.source for g in groups.get(n, ()) if g.source is not None] for n in pipeline.nodes}
    return Plan(pipeline, types, groups, tuple(topological(pipeline.nodes, needs)))
