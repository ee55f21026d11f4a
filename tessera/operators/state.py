"""Versioned run state as relational queries: leases, roll-ups, forks, upserts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("OUTPUT", "ERROR")


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The row of the largest order for each key (a partial maximum, no sort)."""
    others = columns or [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("x")).select(*keys, "x.*")


def lease_expiry(claimed: Column, ttl_seconds: Column) -> Column:
    return claimed + ttl_seconds.cast("long") * 1000


def expired(expiration: Column, now: Column) -> Column:
    return expiration < now


def claimable(status: Column, worker: Column, expiration: Column, me: Column, now: Column) -> Column:
    """PENDING, an expired RUNNING, or one's own."""
    running = status == "RUNNING"
    return F.coalesce((status == "PENDING") | (running & expired(expiration, now)) | (running & (worker == me) & (expiration >= now)), F.lit(False))


def holds_lease(worker: Column, expiration: Column, me: Column, now: Column) -> Column:
    return F.coalesce((worker == me) & (expiration > now), F.lit(False))


def renew_due(claimed: Column, ttl_seconds: Column, now: Column, share: float = 0.75) -> Column:
    """Whether ``share`` of a lease has passed."""
    return now - claimed >= ttl_seconds.cast("long") * 1000 * share


def runnable(states: DataFrame, tasks: DataFrame, versions: DataFrame, now: Column, action: str | None = None) -> DataFrame:
    """States that may run: pending or expired, and whose task's current version isn't terminal.

    A pointer to a version that isn't there drops the row (its type is unknown).
    """
    ready = (F.col("runtime_status") == "PENDING") | ((F.col("runtime_status") == "RUNNING") & expired(F.col("expiration_time"), now))
    rows = states.where(ready)
    if action is not None:
        rows = rows.where(F.col("action_id") == action)
    known = rows.join(tasks.select("task_id", "current_version_id"), "task_id", "left").join(versions.select(F.col("version_id").alias("current_version_id"), "version_type_tag"), "current_version_id", "left")
    return known.where(F.col("current_version_id").isNull() | ~F.col("version_type_tag").isin(*TERMINAL))


def rolled_up(revisions: DataFrame, states: DataFrame) -> DataFrame:
    """(revision, status): all idle (or none) COMPLETED, else any FAILED, any RUNNING, else UNKNOWN."""
    some = states.groupBy("revision").agg(F.min((F.col("status") == "IDLE").cast("int")).alias("idle"), F.max((F.col("status") == "FAILED").cast("int")).alias("failed"), F.max((F.col("status") == "RUNNING").cast("int")).alias("running"))
    status = F.when(F.coalesce("idle", F.lit(1)) == 1, "COMPLETED").when(F.col("failed") == 1, "FAILED").when(F.col("running") == 1, "RUNNING").otherwise("UNKNOWN")
    return revisions.select("revision").distinct().join(some, "revision", "left").select("revision", status.alias("status"))


def forked(states: DataFrame, parents: DataFrame) -> DataFrame:
    """``states`` and, for each (parent, child), the parent's rows under the child's name."""
    copies = states.join(parents, states.revision == parents.parent).select(*(F.col("child").alias("revision") if c == "revision" else F.col(c) for c in states.columns))
    return states.unionByName(copies)


def upserted(changes: DataFrame, keys: list[str], fields: list[str], order: str = "position") -> DataFrame:
    """Fold changes whose fields are struct(given, value): not given keeps, a given null clears."""
    folded = [F.max_by(F.col(f).getField("value"), F.when(F.col(f).getField("given"), F.col(order))).alias(f) for f in fields]
    return changes.groupBy(*keys).agg(*folded)


def created_tasks(requests: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """One new task for each key that doesn't exist, from its first request."""
    others = [c for c in requests.columns if c not in key and c != order]
    first = requests.groupBy(*key).agg(F.min(F.struct(order, *others)).alias("x")).select(*key, "x.*")
    return first.join(existing.select(*key), key, "left_anti")


def after_claim(state: Column, ok: Column) -> Column:
    return F.when(ok, "RUNNING").otherwise(state)


def after_report(state: Column, holds: Column, success: Column) -> Column:
    """A holder's report ends a run; anyone else's changes nothing."""
    return F.when(holds & success, "IDLE").when(holds & ~success, "FAILED").otherwise(state)


def after_refresh(state: Column) -> Column:
    """Terminal states become pending again."""
    return F.when(state.isin("IDLE", "FAILED"), "PENDING").otherwise(state)


def superseded(anchors: DataFrame, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """The state of each anchor: the newest of a session is active, earlier ones are released as superseded."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc(), F.col("anchor_token").desc())
    n = F.row_number().over(w)
    return anchors.withColumn("state", F.when(n == 1, "active").otherwise("released")).withColumn("state_reason", F.when(n > 1, "superseded"))


def rebound(rows: DataFrame, moves: DataFrame, column: str = "session_id") -> DataFrame:
    """``rows`` with sessions renamed or merged by ``moves`` (old, new)."""
    return rows.join(moves, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def cleaned(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables without the keys in ``gone``, the number of rows that go from each)."""
    names = gone.select(key).distinct()
    kept = {k: t.join(names, key, "left_anti") for k, t in tables.items()}
    counts = {k: t.join(names, key, "left_semi").agg(F.count("*").alias("n")) for k, t in tables.items()}
    return kept, counts
