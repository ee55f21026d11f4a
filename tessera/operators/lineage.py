"""Navigation of a revision history: heads, ancestors, surroundings, reconstruction.

What a walk finds first (:func:`nearest`, :func:`nth`, :func:`counted`) comes by pointer doubling:
every revision's pointer jumps twice as far each round, so a history of any depth takes a
logarithmic number of joins over the revisions, however many walks start in it.  Only walks whose
every row is wanted (:func:`ancestors`) follow parents by recursive SQL.  Histories may fork.
Parents that aren't there end a walk; cycles without a hit end it without a result.
Where a history is one chain of known order, the window forms below give the same without joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.store import kept

MAX_DEPTH = 1000


def ancestors(revisions: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, until: DataFrame | None = None) -> DataFrame:
    """(start, id, depth) of every start (start) and its ancestors over (id, parent_id), up to the first
    proper ancestor in ``until`` (id), that one included, where it is given."""
    spark = revisions.sparkSession
    if until is not None:  # the walk ends there
        ends = until.select(F.col("id").alias("_end")).distinct()
        below = revisions.join(ends, revisions.id == ends._end, "left").select("id", "parent_id", F.col("_end").isNotNull().alias("hit"))
        first = starts.join(revisions.select("id", "parent_id"), starts.start == revisions.id).select("start", "id", "parent_id")
        revisions, starts = below.where("not hit"), first
        walked = ancestors(revisions, starts.where("parent_id is not null").select(F.col("parent_id").alias("start")).distinct(), depth - 1)
        above = starts.join(walked.select(F.col("start").alias("parent_id"), F.col("id").alias("_id"), "depth"), "parent_id").select("start", F.col("_id").alias("id"), (F.col("depth") + 1).alias("depth"))
        return starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).unionByName(above)
    revisions.select("id", "parent_id").createOrReplaceTempView("_lineage_revisions")
    starts.createOrReplaceTempView("_lineage_starts")
    # The depth bounds the walk; Spark's own limit of a million rows would end it with an error.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(f"""
        WITH RECURSIVE walk(start, id, depth) MAX RECURSION LEVEL {int(depth) + 1} AS (
          SELECT start, start, 0 FROM _lineage_starts
          UNION ALL
          SELECT w.start, r.parent_id, w.depth + 1 FROM walk w JOIN _lineage_revisions r ON r.id = w.id
          WHERE r.parent_id IS NOT NULL AND w.depth < {int(depth)}
        )
        SELECT start, id, depth FROM walk
    """)


def _jumped(state: DataFrame) -> DataFrame:
    """(id, at, steps, done) once all pointers ``at`` stand on their goal (or nowhere: null).

    A round moves each pointer that isn't done to where its target's points; equal targets are
    one row on that side of the join."""
    state = kept(state.select("id", "at", F.col("steps").cast("long").alias("steps"), "done"))
    for _ in range(state.count().bit_length() + 1):  # a pointer that is still under way then goes round a cycle
        if state.where("not done").isEmpty():
            break
        to = state.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = state.where("not done").join(to, F.col("at") == F.col("_id"), "left")
        moved = moved.select("id", F.col("_at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_done", F.lit(True)).alias("done"))
        state = kept(state.where("done").unionByName(moved))
    return state


def nearest(revisions: DataFrame, fits: DataFrame) -> DataFrame:
    """(start, id, depth): the first revision in ``fits`` (id) at or above every revision (id, parent_id)."""
    marked = revisions.select("id", "parent_id").join(fits.select(F.col("id").alias("_fit")).distinct(), F.col("id") == F.col("_fit"), "left")
    hit = F.col("_fit").isNotNull()
    state = marked.select("id", F.when(hit, F.col("id")).otherwise(F.col("parent_id")).alias("at"), F.when(hit, 0).otherwise(1).alias("steps"), (hit | F.col("parent_id").isNull()).alias("done"))
    return _jumped(state).where("done and at is not null").select(F.col("id").alias("start"), F.col("at").alias("id"), "steps").withColumnRenamed("steps", "depth")


def above(revisions: DataFrame, fits: DataFrame) -> DataFrame:
    """(id, up, depth): the first revision in ``fits`` that is a proper ancestor of each revision; null if none is."""
    found = nearest(revisions, fits).select(F.col("start").alias("parent_id"), F.col("id").alias("up"), "depth")
    return revisions.select("id", "parent_id").join(found, "parent_id", "left").select("id", "up", (F.col("depth") + 1).alias("depth"))


def nth(revisions: DataFrame, starts: DataFrame, fits: DataFrame, n: int) -> DataFrame:
    """(start, id): the n-th fitting ancestor of each start, the start itself excluded (n from 1)."""
    up = kept(above(revisions, fits).where("up is not null").select("id", "up"))
    out = starts.select("start").join(up.withColumnRenamed("id", "start"), "start")
    left = n - 1
    while left:
        if left & 1:
            out = out.join(up.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("start", F.col("_up").alias("up"))
        left >>= 1
        if left:  # pointers twice as far
            up = kept(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up")))
    return out.select("start", F.col("up").alias("id"))


def counted(revisions: DataFrame, fits: DataFrame) -> DataFrame:
    """(start, n): the number of fitting proper ancestors of every revision that has any."""
    up = kept(above(revisions, fits).select("id", "up"))
    # Among fitting revisions pointers lead to the topmost, one fitting revision a step.
    among = up.join(fits.select("id").distinct(), "id", "left_semi")
    state = among.select("id", "up", F.col("up").isNull().alias("top")).select("id", F.when(F.col("top"), F.col("id")).otherwise(F.col("up")).alias("at"), F.when(F.col("top"), 0).otherwise(1).alias("steps"), F.col("top").alias("done"))
    ranks = _jumped(state).where("done").select(F.col("id").alias("up"), "steps")
    return up.where("up is not null").join(ranks, "up").select(F.col("id").alias("start"), (F.col("steps") + 1).alias("n"))


def first_children(revisions: DataFrame, fits: DataFrame, order: str) -> DataFrame:
    """(id, child): the earliest fitting descendant by ``order``, where descents go on through revisions that don't fit only."""
    # Every fitting revision is a candidate of all revisions between it and the next fitting one above, that one included.
    chains = ancestors(revisions, fits.select(F.col("id").alias("start")), until=fits).where("depth > 0")
    when = revisions.select(F.col("id").alias("start"), F.col(order).alias("_order"))
    return chains.join(when, "start").groupBy("id").agg(F.min(F.struct("_order", "start")).getField("start").alias("child"))


def numbered(rows: DataFrame, task: str, order: list[str]) -> DataFrame:
    """``rows`` with ``n_back``: 0 for the newest of its task."""
    w = Window.partitionBy(task).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("n_back", (F.row_number().over(w) - 1).cast("long"))


def surrounding(rows: DataFrame, targets: DataFrame, task: str, order: list[str], key: str, reach: int = 3) -> DataFrame:
    """(target, key, relative): up to ``reach`` rows on either side of each target in its task."""
    reach = max(0, min(10, reach))
    w = Window.partitionBy(task).orderBy(*order)
    placed = rows.select(task, key, F.row_number().over(w).alias("place"))
    own = placed.join(targets.select(F.col("target").alias(key)), key, "left_semi").select(F.col(task).alias("_task"), F.col(key).alias("target"), F.col("place").alias("at"))
    near = own.select("_task", "target", "at", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("_place"))
    hit = near.join(placed, (F.col("_task") == F.col(task)) & (F.col("_place") == F.col("place")))
    return hit.select("target", key, (F.col("place") - F.col("at")).cast("long").alias("relative"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the latest ``right`` row of the same key not after it (ties: the larger value).

    One sort for both sides: right rows come first at equal times, and the last non-null
    value is carried forward.
    """
    lefts = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    rights = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lefts.unionByName(rights).withColumn("_found", F.last("_v", ignorenulls=True).over(w))
    return out.where("_side = 1").select("_row.*", F.col("_found").alias(value))
