"""Runs planned graphs as DataFrames.

Every row carries the columns of its run (``scope``), context slots (``%...``), metadata
slots (``^...``) and data slots.  An edge projects a source's columns into target slots;
context is made anew on every edge, so a key that no edge names is dropped.

* split explodes an array or a map; empty collections emit nothing;
* merge gathers by context: an array once all ``keys`` positions are there, a map once
  all names are; incomplete gathers emit nothing; the last value (by ``_order``) of a key wins;
* const is one value for every run;
* several sources join on scope and context;
* a regular node applies a registered action to its data slots; row functions are applied
  once to each distinct input and joined back (metadata is not part of the input).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.graph import EdgeGroup, Pipeline, Plan, plan


@dataclass(frozen=True)
class Action:
    """``column``: slots -> outputs as columns; ``rows``: a DataFrame of distinct slots -> one with outputs beside them."""

    inputs: tuple[str, ...]
    column: Callable[[dict[str, Column]], dict[str, Column]] | None = None
    rows: Callable[[DataFrame], DataFrame] | None = None
    outputs: tuple[str, ...] = ("output",)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _path(frame: DataFrame, handle: str) -> Column | None:
    """The column of a dotted handle; None where its leaf isn't there; a parent that isn't an object is an error."""
    if handle in frame.columns:
        return _q(handle)
    head, *rest = handle.split(".")
    if head not in frame.columns:
        if rest:
            raise KeyError(f"{handle}: {head} is not there")
        return None
    out, kind = _q(head), frame.schema[head].dataType
    for k, name in enumerate(rest):
        if isinstance(kind, T.StructType):
            if name not in kind.names:
                if k + 1 < len(rest):
                    raise KeyError(f"{handle}: {name} is not there")
                return None
            out, kind = out.getField(name), kind[name].dataType
        elif isinstance(kind, T.MapType):
            out, kind = F.element_at(out, F.lit(name)), kind.valueType
        else:
            raise TypeError(f"{handle}: {head} is not an object")
    return out


def project(frame: DataFrame, group: EdgeGroup, scope: tuple[str, ...]) -> DataFrame:
    """One group of edges: scope, context, metadata and data slots of the target."""
    out = [_q(c) for c in scope] + ([F.col("_order")] if "_order" in frame.columns else [])
    for edge in (*group.context, *group.meta, *group.data):
        column = _path(frame, edge.source_handle)
        if column is not None:
            out.append(column.alias(edge.target_handle))
    return frame.select(*out)


def _context(frame: DataFrame, scope: tuple[str, ...]) -> list[str]:
    return [*scope, *sorted(c for c in frame.columns if c.startswith("%"))]


def joined(arrivals: list[DataFrame], scope: tuple[str, ...]) -> DataFrame:
    """Sources of one node meet where scope and context agree; null keys are equal."""
    out = arrivals[0]
    for other in arrivals[1:]:
        keys = _context(out, scope)
        if keys != _context(other, scope):
            raise ValueError(f"sources with contexts {keys} and {_context(other, scope)} never meet")
        right = other.select(*(_q(c).alias(f"_r{k}") for k, c in enumerate(keys)), *(_q(c) for c in other.columns if c not in keys and c not in out.columns and c != "_order"))
        condition = [_q(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(keys)]
        out = out.join(right, condition).drop(*(f"_r{k}" for k in range(len(keys))))
    return out


def split(frame: DataFrame, slot: str = "items") -> DataFrame:
    """keys, key and item of each element."""
    kind = frame.schema[slot].dataType
    own = [_q(c) for c in frame.columns if c != slot]
    if isinstance(kind, T.ArrayType):
        return frame.select(*own, F.size(_q(slot)).alias("keys"), F.posexplode(_q(slot)).alias("key", "item"))
    if isinstance(kind, T.MapType):
        return frame.select(*own, F.map_keys(_q(slot)).alias("keys"), F.explode(_q(slot)).alias("key", "item"))
    raise TypeError(f"split needs an array or an object, not {kind.simpleString()}")


def gather(frame: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """``output`` of every context whose keys are complete."""
    keys = _context(frame, scope)
    meta = [c for c in frame.columns if c.startswith("^")]
    order = F.col("_order") if "_order" in frame.columns else F.lit(0)
    # The last value of each key; equal orders are resolved by the value itself.
    last = frame.groupBy(*(_q(c) for c in keys), "key").agg(F.max(F.struct(order, _q("item"))).getField("item").alias("item"), F.max("keys").alias("keys"), *(F.max(_q(c)).alias(c) for c in meta))
    some = last.groupBy(*(_q(c) for c in keys)).agg(F.collect_list(F.struct("key", "item")).alias("_all"), F.max("keys").alias("_keys"), *(F.max(_q(c)).alias(c) for c in meta))
    own = [*(_q(c) for c in keys), *(_q(c) for c in meta)]
    if isinstance(frame.schema["keys"].dataType, T.ArrayType):
        done = some.where(F.size("_all") >= F.size("_keys")).where(F.forall("_keys", lambda k: F.exists("_all", lambda x: x.key == k)))
        return done.select(*own, F.map_from_entries("_all").alias("output"))
    inside = some.withColumn("_all", F.filter("_all", lambda x: (x.key >= 0) & (x.key < F.col("_keys"))))
    return inside.where(F.size("_all") == F.col("_keys")).select(*own, F.transform(F.array_sort("_all"), lambda x: x.item).alias("output"))


def applied(frame: DataFrame, action: Action, scope: tuple[str, ...]) -> DataFrame:
    """The outputs of an action, with scope, context and metadata."""
    kept = [c for c in frame.columns if c in scope or c.startswith(("%", "^")) or c == "_order"]
    missing = set(action.inputs) - set(frame.columns)
    if missing:
        raise KeyError(f"slots {sorted(missing)} are never filled")
    if action.column is not None:
        made = action.column({c: _q(c) for c in action.inputs})
        return frame.select(*(_q(c) for c in kept), *(v.alias(k) for k, v in made.items()))
    return memoised(frame, action).select(*(_q(c) for c in kept), *(_q(c) for c in action.outputs))


def memoised(frame: DataFrame, action: Action) -> DataFrame:
    """Apply a row function once to each distinct input and join its outputs back."""
    distinct = frame.select(*(_q(c) for c in action.inputs)).distinct()
    made = action.rows(distinct)
    right = made.select(*(_q(c).alias(f"_r{k}") for k, c in enumerate(action.inputs)), *(_q(c) for c in action.outputs))
    condition = [_q(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(action.inputs)]
    return frame.join(right, condition).drop(*(f"_r{k}" for k in range(len(action.inputs))))


def nested(inner: Pipeline | Plan, frame: DataFrame, actions: dict[str, Action | Pipeline], scope: tuple[str, ...]) -> DataFrame:
    """A workflow as an action: each (scope, context) is a run of its own; metadata is put back."""
    keys = _context(frame, scope)
    inside = {c: f"run:{k}" for k, c in enumerate(keys)}
    meta = [c for c in frame.columns if c.startswith("^")]
    slots = [c for c in frame.columns if c not in keys and c not in meta and c != "_order"]
    runs = frame.select(*(_q(c).alias(inside[c]) for c in keys), *(_q(c) for c in slots))
    out = run(inner, runs, actions, tuple(inside.values()))
    back = out.select(*(_q(inside[c]).alias(c) for c in keys), *(_q(c) for c in out.columns if c not in inside.values()))
    if not meta:
        return back
    right = frame.select(*(_q(c).alias(inside[c]) for c in keys), *(_q(c) for c in meta))
    condition = [_q(c).eqNullSafe(_q(inside[c])) for c in keys]
    return back.join(right, condition).drop(*inside.values())


def _literal(value) -> Column:
    if isinstance(value, (dict, list)):
        kind = F.schema_of_json(F.lit(json.dumps(value)))
        return F.from_json(F.lit(json.dumps(value)), kind)
    return F.lit(value)


def run(pipeline: Pipeline | Plan, inputs: DataFrame, actions: dict[str, Action | Pipeline], scope: tuple[str, ...]) -> DataFrame:
    """The graph's outputs: scope and the output slots, metadata stripped; an action may be a graph itself."""
    known = pipeline if isinstance(pipeline, Plan) else plan(pipeline)
    results: dict[str | None, DataFrame] = {None: inputs}
    runs = inputs.select(*(_q(c) for c in scope)).distinct()

    def arrive(target: str | None) -> DataFrame:
        arrivals = [project(results[g.source], g, scope) for g in known.groups[target]]
        return joined(arrivals, scope) if len(arrivals) > 1 else arrivals[0]

    for name in known.order:
        node, kind = known.pipeline.nodes[name], known.types[name]
        if kind == "const":
            results[name] = runs.select(*(_q(c) for c in scope), _literal(node.value).alias("output"))
            continue
        arrived = arrive(name)
        if kind == "split":
            slot = next(c for c in arrived.columns if c not in scope and not c.startswith(("%", "^", "_")))
            results[name] = split(arrived, slot)
        elif kind == "merge":
            results[name] = gather(arrived, scope)
        elif isinstance(actions[node.action], (Pipeline, Plan)):
            results[name] = nested(actions[node.action], arrived, actions, scope)
        else:
            results[name] = applied(arrived, actions[node.action], scope)
    out = arrive(None)
    return out.select(*(_q(c) for c in out.columns if not c.startswith(("^", "_"))))


# -- incremental recomputation --------------------------------------------------------------


def input_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of named inputs; null and missing differ, names are in order."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(F.to_json(F.struct(columns[name].alias("v"))), F.lit("null"))) for name in sorted(columns)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def stale(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``after`` (keys, input_hash) with ``dependency_status``: FRESH where the hash is as before, STALE where it isn't, NEW."""
    old = before.select(*keys, F.col("input_hash").alias("_old"), F.lit(True).alias("_was"))
    status = F.when(F.col("_was").isNull(), "NEW").when(F.col("_old").eqNullSafe(F.col("input_hash")), "FRESH").otherwise("STALE")
    return after.join(old, keys, "left").select(*keys, "input_hash", status.alias("dependency_status"))


def downstream(edges: DataFrame, start: DataFrame, hops: int | None = 1) -> DataFrame:
    """Nodes (v) that ``start`` (v) reaches over ``edges`` (a, b): in one hop, in ``hops``, or in any number (None)."""
    seen = front = start.select("v").distinct()
    done = 0
    while hops is None or done < hops:
        reached = front.withColumnRenamed("v", "a").join(edges, "a").select(F.col("b").alias("v")).distinct()
        front = reached.join(seen, "v", "left_anti")
        if hops is None and front.isEmpty():
            break
        seen = seen.union(front)
        done += 1
    return seen.join(start.select("v").distinct(), "v", "left_anti")
