"""Views over the event log: batch folds in closed form, and the same in Structured Streaming.

Topics (fixed values): mcp.session_initialized, mcp.session_closed, proxy.request_received,
proxy.response_completed, proxy.response_aborted, proxy.upstream_error, fork.*.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import stable_id
from tessera.functions.messages import classify
from tessera.plans.graph import topological

INIT, CLOSE, REQUEST = "mcp.session_initialized", "mcp.session_closed", "proxy.request_received"
COMPLETED, ABORTED, FAILED = "proxy.response_completed", "proxy.response_aborted", "proxy.upstream_error"
TERMINAL = (COMPLETED, ABORTED, FAILED)
CREATED, FORKED, LABELLED, DELETED = "fork.bookmark_created", "fork.forked", "fork.label_updated", "fork.bookmark_deleted"


def _payload(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def sessions(events: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """One row a session: created by its first init or request, the first real harness, the last
    pid, the first close after creation; ``actors`` (session_id, actor) names known ones."""
    rows = events.where(F.col("topic").isin(INIT, CLOSE, REQUEST) & F.col("session_id").isNotNull())
    opens = F.col("topic").isin(INIT, REQUEST)
    harness = F.coalesce(_payload("harness"), F.lit("unknown"))
    real = (F.col("topic") == INIT) & (harness != "orphan")
    opened = rows.groupBy("session_id").agg(
        F.min(F.when(opens, F.col("event_id"))).alias("first_id"),
        F.min_by(F.when(opens, F.col("created_at")), F.when(opens, F.col("event_id"))).alias("created_at"),
        F.min_by(F.when(real, harness), F.when(real, F.col("event_id"))).alias("harness"),
        F.max_by(_payload("pid").cast("long"), F.when((F.col("topic") == INIT) & _payload("pid").isNotNull(), F.col("event_id"))).alias("pid"),
        # Closes and their order: those before the creation don't count.
        F.array_sort(F.collect_list(F.when(F.col("topic") == CLOSE, F.struct("event_id", "created_at")))).alias("closes"),
    )
    closed = F.get(F.filter("closes", lambda c: c.event_id > F.col("first_id")), F.lit(0)).getField("created_at")
    out = opened.where("first_id is not null").select("session_id", stable_id("t_", "task:", F.col("session_id")).alias("task_id"), "created_at", closed.alias("ended_at"), "pid", F.coalesce("harness", F.lit("orphan")).alias("harness"))
    if actors is None:
        return out.withColumn("actor", F.lit("default"))
    return out.join(actors, "session_id", "left").withColumn("actor", F.coalesce("actor", F.lit("default")))


def revisions(events: DataFrame) -> DataFrame:
    """One row a request: open until its last terminal event seals and classifies it; its parent
    is the latest revision of the session sealed by the time of the request, earlier in the log."""
    requests = events.where(F.col("topic") == REQUEST).select("event_id", "session_id", "created_at")
    ends = events.where(F.col("topic").isin(*TERMINAL)).select(_payload("request_event_id").cast("long").alias("event_id"), F.struct(F.col("event_id").alias("end_id"), F.col("topic"), F.col("created_at").alias("sealed_at"), _payload("stop_reason").alias("stop_reason")).alias("end"))
    last = ends.groupBy("event_id").agg(F.max("end").alias("end"))
    rows = requests.join(last, "event_id", "left").select("event_id", "session_id", "created_at", "end.*")
    kind = F.when(F.col("topic").isNull(), "in_flight").when(F.col("topic") == COMPLETED, classify(F.col("stop_reason"))).otherwise("dangling_unforkable")
    rows = rows.withColumn("classification", kind)
    # Candidates come in log order of their end; time must not run ahead of the request.
    point = rows.select("session_id", F.col("event_id").alias("pos"), F.col("created_at").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<sealed_at:bigint,id:bigint>").alias("cand"))
    sealed = rows.where("sealed_at is not null").select("session_id", F.col("end_id").alias("pos"), F.col("sealed_at").alias("at"), F.lit(0).alias("side"), F.struct("sealed_at", F.col("event_id").alias("id")).alias("cand"))
    w = Window.partitionBy("session_id").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = point.unionByName(sealed).withColumn("best", F.max("cand").over(w)).where("side = 1").select("session_id", F.col("pos").alias("event_id"), "best")
    out = rows.join(found, ["session_id", "event_id"])
    fits = F.col("best.sealed_at") <= F.col("created_at")
    # Where clocks ran back, the best by time lies in the future: only those rows look at all candidates.
    late = out.where(~fits).select("session_id", "event_id", "created_at")
    others = sealed.select("session_id", F.col("pos").alias("end_pos"), "cand")
    again = late.join(others, "session_id").where((F.col("end_pos") < F.col("event_id")) & (F.col("cand.sealed_at") <= F.col("created_at"))).groupBy("session_id", "event_id").agg(F.max("cand").alias("other"))
    out = out.join(again, ["session_id", "event_id"], "left")
    parent = F.when(fits, F.col("best.id")).otherwise(F.col("other.id"))
    return out.select(F.col("event_id").alias("id"), "session_id", "created_at", "sealed_at", "stop_reason", "classification", parent.alias("parent_id"))


def _fold_branches(pdf: pd.DataFrame) -> pd.DataFrame:
    """Branch views of one task, event by event."""
    views: dict[str, dict] = {}
    for r in pdf.sort_values("position").itertuples(index=False):
        if r.topic in (CREATED, FORKED):
            views.setdefault(r.view_id, {"head": r.head, "label": r.label, "auto_label": r.auto_label, "created_at": r.created_at, "updated_at": r.created_at})
        elif r.topic == LABELLED and r.view_id in views:
            views[r.view_id].update(label=r.label, updated_at=r.created_at)
        elif r.topic == DELETED:
            views.pop(r.view_id, None)
        elif r.topic == COMPLETED:
            for v in views.values():
                if v["head"] == r.parent:
                    v.update(head=r.head, updated_at=r.created_at)
    task = pdf["task_id"].iloc[0]
    return pd.DataFrame([{"task_id": task, "view_id": k, **v} for k, v in views.items()], columns=["task_id", "view_id", "head", "label", "auto_label", "created_at", "updated_at"])


def branch_views(changes: DataFrame) -> DataFrame:
    """Fold (task_id, position, topic, view_id, head, parent, label, auto_label, created_at): views
    are created, relabelled and deleted; when a child completes, all views at its parent advance."""
    return changes.groupBy("task_id").applyInPandas(_fold_branches, "task_id string, view_id string, head string, label string, auto_label string, created_at long, updated_at long")


def synthetic_revisions(events: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that fork events make up: first wins, and only where the parent is known (id)."""
    rows = events.where(F.col("topic") == FORKED).select(_payload("synthetic_revision_id").alias("id"), _payload("parent_revision_id").alias("parent_id"), _payload("sealed_at").cast("long").alias("sealed_at"), F.concat(_payload("kind"), F.lit("_synthetic")).alias("stop_reason"), "event_id")
    first = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("event_id", "parent_id", "sealed_at", "stop_reason")).alias("x"))
    return first.select("id", "x.parent_id", "x.sealed_at", "x.stop_reason").join(known.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def landings(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(landing, synthetic) pairs, the later event winning, and requests that were to land but never forked."""
    forks = events.where(F.col("topic") == FORKED).select(_payload("to_revision_id").alias("landing"), F.struct("event_id", _payload("synthetic_revision_id").alias("synthetic")).alias("x"))
    pairs = forks.groupBy("landing").agg(F.max("x").alias("x")).select("landing", "x.synthetic")
    meant = events.where((F.col("topic") == REQUEST) & _payload("tobe_applied_from").isNotNull()).select(F.col("event_id").cast("string").alias("landing"))
    return pairs, meant.join(pairs, "landing", "left_anti")


# -- registered views, in dependency order -----------------------------------------------------


@dataclass(frozen=True)
class View:
    """``apply`` gets the batch of events and the views it needs, and returns rows to write."""

    name: str
    topics: tuple[str, ...]
    apply: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Engine:
    """Runs views over micro-batches; a view that fails is reported and the others go on."""

    views: list[View] = field(default_factory=list)
    failures: list[tuple[int, str, str]] = field(default_factory=list)

    def order(self) -> list[View]:
        by_name = {v.name: v for v in self.views}
        return [by_name[n] for n in topological(by_name, {v.name: v.needs for v in self.views})]

    def topic_index(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for v in self.order():
            for t in v.topics:
                out.setdefault(t, []).append(v.name)
        return out

    def process(self, events: DataFrame, epoch: int, write: Callable[[str, DataFrame], None]) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for v in self.order():
            try:
                rows = v.apply(events.where(F.col("topic").isin(*v.topics)), done)
                write(v.name, rows)
                done[v.name] = rows
            except Exception as e:  # one view's failure is data, not the batch's end
                self.failures.append((epoch, v.name, str(e).split("\n")[0]))
        return done

    def start(self, stream: DataFrame, checkpoint: str, write: Callable[[str, DataFrame, int], None], once: bool = True):
        def batch(events: DataFrame, epoch: int) -> None:
            events = events.persist()
            try:
                self.process(events, epoch, lambda name, rows: write(name, rows, epoch))
            finally:
                events.unpersist()

        out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out).start()


# -- a stateful twin of sessions ------------------------------------------------------------

SESSION_OUT = "session_id string, created_at long, ended_at long, pid long, harness string"
SESSION_STATE = "first_id long, created_at long, ended_at long, pid long, harness string"


def _session_state(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    import json

    first, created, ended, pid, harness = state.get if state.exists else (None, None, None, None, None)
    for pdf in batches:
        for r in pdf.sort_values("event_id").itertuples(index=False):
            payload = json.loads(r.payload or "{}")
            if r.topic in (INIT, REQUEST):
                if first is None:
                    first, created, harness = int(r.event_id), int(r.created_at), "orphan"
                if r.topic == INIT:
                    if harness == "orphan":
                        harness = payload.get("harness") or "unknown"
                    if payload.get("pid") is not None:
                        pid = int(payload["pid"])
            elif r.topic == CLOSE and first is not None and ended is None:
                ended = int(r.created_at)
    state.update((first, created, ended, pid, harness))
    if first is not None:
        yield pd.DataFrame([(key[0], created, ended, pid, harness)], columns=["session_id", "created_at", "ended_at", "pid", "harness"]).astype({"created_at": "Int64", "ended_at": "Int64", "pid": "Int64"})


def stream_sessions(events: DataFrame) -> DataFrame:
    """The sessions view as arbitrary state by session: each batch emits the sessions it changed."""
    rows = events.where(F.col("session_id").isNotNull() & F.col("topic").isin(INIT, CLOSE, REQUEST))
    return rows.groupBy("session_id").applyInPandasWithState(_session_state, SESSION_OUT, SESSION_STATE, "update", "NoTimeout")
