"""Run-state queries on orders (tasks), line items (versions, node states) and customers (revisions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query, table
from tessera.operators import state as st

#: "Now" and the lease of the recast: claims are order dates.
NOW = 883612800000  # 1998-01-01
TTL = 86400 * 365


def _ms(column: str):
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def _tasks(spark, sf_dir):
    """Orders as execution states: O pending, P running, F failed."""
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("FAILED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("action_id"), status.alias("runtime_status"), F.concat(F.lit("w"), F.col("o_custkey") % 5).alias("worker"), st.lease_expiry(_ms("o_orderdate"), F.lit(TTL)).alias("expiration_time"), F.col("o_custkey").alias("revision")
    )


_TASKS = f"""
WITH t AS (
  SELECT o_orderkey AS task_id, o_orderpriority AS action_id,
         CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'FAILED' END AS runtime_status,
         'w' || (o_custkey % 5) AS worker, (epoch_us(o_orderdate) // 1000) + {TTL * 1000} AS expiration_time, o_custkey AS revision
  FROM orders)
"""


@query(
    _TASKS
    + f""", v AS (SELECT l_orderkey AS task_id, l_orderkey * 10 + 1 AS version_id, CASE l_linestatus WHEN 'F' THEN 'OUTPUT' ELSE 'REVISION' END AS tag FROM lineitem WHERE l_linenumber = 1),
p AS (SELECT l_orderkey AS task_id, CASE WHEN l_orderkey % 7 = 0 THEN -1 WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey * 10 + 1 END AS current_version_id FROM lineitem WHERE l_linenumber = 1)
SELECT t.task_id, action_id, runtime_status FROM t LEFT JOIN p ON p.task_id = t.task_id LEFT JOIN v ON v.version_id = p.current_version_id
WHERE (runtime_status = 'PENDING' OR (runtime_status = 'RUNNING' AND expiration_time < {NOW}))
  AND (p.current_version_id IS NULL OR v.tag NOT IN ('OUTPUT', 'ERROR'))
"""
)
def runnable_tasks(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    versions = first.select((F.col("l_orderkey") * 10 + 1).alias("version_id"), F.when(F.col("l_linestatus") == "F", "OUTPUT").otherwise("REVISION").alias("version_type_tag"))
    pointer = F.when(F.col("l_orderkey") % 7 == 0, F.lit(-1)).when(F.col("l_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("l_orderkey") * 10 + 1)
    tasks = first.select(F.col("l_orderkey").alias("task_id"), pointer.cast("long").alias("current_version_id"))
    return st.runnable(_tasks(spark, sf_dir), tasks, versions, F.lit(NOW)).select("task_id", "action_id", "runtime_status")


@query(_TASKS + "SELECT task_id, action_id FROM t WHERE runtime_status = 'PENDING' AND action_id = '1-URGENT' ORDER BY task_id LIMIT 25")
def pending_list(spark, sf_dir):
    """The first 25 pending tasks of an action (a page)."""
    return _tasks(spark, sf_dir).where("runtime_status = 'PENDING' and action_id = '1-URGENT'").orderBy("task_id").limit(25).select("task_id", "action_id")


@query(_TASKS + f"SELECT task_id, runtime_status = 'PENDING' OR (runtime_status = 'RUNNING' AND expiration_time < {NOW}) OR (runtime_status = 'RUNNING' AND worker = 'w1' AND expiration_time >= {NOW}) AS claimable FROM t")
def claimable_tasks(spark, sf_dir):
    ok = st.claimable(F.col("runtime_status"), F.col("worker"), F.col("expiration_time"), F.lit("w1"), F.lit(NOW))
    return _tasks(spark, sf_dir).select("task_id", ok.alias("claimable"))


@query(_TASKS + f"SELECT task_id, worker = 'w1' AND expiration_time > {NOW} AS holds, CASE WHEN worker = 'w1' AND expiration_time > {NOW} THEN CASE WHEN task_id % 2 = 0 THEN 'IDLE' ELSE 'FAILED' END ELSE runtime_status END AS after FROM t")
def lease_reports(spark, sf_dir):
    """Only the holder of a lease can end a run."""
    holds = st.holds_lease(F.col("worker"), F.col("expiration_time"), F.lit("w1"), F.lit(NOW))
    return _tasks(spark, sf_dir).select("task_id", holds.alias("holds"), st.after_report(F.col("runtime_status"), holds, F.col("task_id") % 2 == 0).alias("after"))


@query(_TASKS + f"SELECT task_id, {NOW} - (expiration_time - {TTL * 1000}) >= {TTL * 1000} * 0.75 AS due FROM t")
def lease_renewals(spark, sf_dir):
    claimed = F.col("expiration_time") - TTL * 1000
    return _tasks(spark, sf_dir).select("task_id", st.renew_due(claimed, F.lit(TTL), F.lit(NOW)).alias("due"))


@query(_TASKS + "SELECT task_id, runtime_status FROM t WHERE runtime_status IN ('RUNNING', 'FAILED')")
def status_set(spark, sf_dir):
    return _tasks(spark, sf_dir).where(F.col("runtime_status").isin("RUNNING", "FAILED")).select("task_id", "runtime_status")


@query(_TASKS + "SELECT task_id, worker FROM t WHERE task_id = 7")
def point_lookup(spark, sf_dir):
    return _tasks(spark, sf_dir).where("task_id = 7").select("task_id", "worker")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND (l_shipdate < TIMESTAMP '1995-01-01' OR l_linenumber IN (1, 3))")
def stale_filter(spark, sf_dir):
    """A state and a set of targets that may be missing."""
    return table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & ((F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")) | F.col("l_linenumber").isin(1, 3))).select("l_orderkey", "l_linenumber")


@query("""
SELECT c_custkey AS revision, CASE WHEN coalesce(min((o_orderstatus = 'F')::INT), 1) = 1 THEN 'COMPLETED'
  WHEN max((o_orderstatus = 'O')::INT) = 1 THEN 'FAILED' WHEN max((o_orderstatus = 'P')::INT) = 1 THEN 'RUNNING' ELSE 'UNKNOWN' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def status_rollup(spark, sf_dir):
    """Customers without orders have nothing to do: COMPLETED."""
    states = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("revision"), F.when(F.col("o_orderstatus") == "F", "IDLE").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING").alias("status"))
    return st.rolled_up(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("revision")), states)


@query("""
SELECT o_orderkey, o_custkey, l_linenumber, upper(l_returnflag) AS tag
FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber = 7) ON l_orderkey = o_orderkey
""")
def current_version(spark, sf_dir):
    """Tasks and their current version, if there is one."""
    last = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select("l_orderkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(last, orders.o_orderkey == last.l_orderkey, "left").select("o_orderkey", "o_custkey", "l_linenumber", F.upper("l_returnflag").alias("tag"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'")
def revisions_of_tasks(spark, sf_dir):
    """An inner join whose second condition is pushed below it."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, (orders.o_orderkey == lines.l_orderkey) & (lines.l_returnflag == "R")).select("o_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1")
def active_states(spark, sf_dir):
    """States of each task's active (latest) revision."""
    return st.latest(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], ["l_linenumber"])


@query("""
SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey
""")
def latest_by_key(spark, sf_dir):
    """A correlated top-1 lookup, decorrelated."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(last, customer.c_custkey == last.o_custkey, "left").select("c_custkey", F.col("x.o_orderkey").alias("last_order"))


@query("""
SELECT l_orderkey AS revision, l_linenumber AS node, l_quantity AS value FROM lineitem
UNION ALL SELECT -l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 = 0
""")
def fork_revision(spark, sf_dir):
    """Every fifth order's states are copied under a new revision."""
    states = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("revision"), F.col("l_linenumber").alias("node"), F.col("l_quantity").alias("value"))
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("parent"), (-F.col("o_orderkey")).alias("child"))
    return st.forked(states, parents)


@query("""
WITH c AS (SELECT user_id, event_id, event_type = 'purchase' AS g1, value AS v1, event_type IN ('view', 'error') AS g2, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v2 FROM events)
SELECT k.user_id, a.v1 AS amount, b.v2 AS note FROM (SELECT DISTINCT user_id FROM c) k
LEFT JOIN (SELECT user_id, v1 FROM c WHERE g1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) a ON a.user_id = k.user_id
LEFT JOIN (SELECT user_id, v2 FROM c WHERE g2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) b ON b.user_id = k.user_id
""")
def upsert_keep(spark, sf_dir):
    """Purchases set the amount; views set the note and errors clear it; the rest keeps both."""
    amount = F.struct((F.col("event_type") == "purchase").alias("given"), F.col("value").alias("value")).alias("amount")
    note = F.struct(F.col("event_type").isin("view", "error").alias("given"), F.when(F.col("event_type") != "error", F.col("props")).alias("value")).alias("note")
    changes = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), amount, note)
    return st.upserted(changes, ["user_id"], ["amount", "note"])


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS task_id FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey, o_orderpriority")
def create_tasks(spark, sf_dir):
    """One task for each action and input; those of every third customer exist."""
    requests = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("task_id"))
    existing = requests.where("o_custkey % 3 = 0").select("o_custkey", "o_orderpriority").distinct()
    return st.created_tasks(requests, existing, ["o_custkey", "o_orderpriority"], "task_id")


@query("""
SELECT o_orderkey AS handle_id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS task_id FROM orders
""")
def request_execution(spark, sf_dir):
    """A new handle for every request; tasks of equal action and input are shared."""
    orders = table(spark, sf_dir, "orders")
    tasks = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("task_id"))
    return orders.join(tasks, ["o_custkey", "o_orderpriority"]).select(F.col("o_orderkey").alias("handle_id"), "task_id")


@query("""
SELECT event_id AS anchor_token, user_id AS session_id, CASE WHEN n = 1 THEN 'active' ELSE 'released' END AS state, CASE WHEN n > 1 THEN 'superseded' END AS state_reason
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS n FROM events WHERE event_type = 'click')
""")
def anchor_lifecycle(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("anchor_token"), F.col("user_id").alias("session_id"), _ms("ts").alias("created_at"))
    return st.superseded(clicks).select("anchor_token", "session_id", "state", "state_reason")


@query("SELECT CASE WHEN user_id % 4 = 1 THEN user_id + 1 ELSE user_id END AS session_id, count(*) AS n FROM events GROUP BY 1")
def rebind_sessions(spark, sf_dir):
    """Sessions are renamed, or merged into one that exists."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"))
    moves = rows.distinct().where("session_id % 4 = 1").select(F.col("session_id").alias("old"), (F.col("session_id") + 1).alias("new"))
    return st.rebound(rows, moves).groupBy("session_id").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'customer' AS name, (SELECT count(*) FROM g) AS gone, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT * FROM g)) AS kept
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT * FROM g)), (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM g))
""")
def clean_by_actor(spark, sf_dir):
    """A cascading delete and its dry run."""
    customer = table(spark, sf_dir, "customer")
    tables = {"customer": customer.select("c_custkey"), "orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))}
    kept, gone = st.cleaned(tables, customer.where("c_mktsegment = 'BUILDING'"), "c_custkey")
    out = None
    for name in tables:
        one = gone[name].select(F.lit(name).alias("name"), F.col("n").alias("gone")).join(kept[name].agg(F.count("*").alias("kept")))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'PENDING' ELSE o_orderstatus END AS status FROM orders")
def refresh_tasks(spark, sf_dir):
    """Ended tasks are pending again."""
    state = F.when(F.col("o_orderstatus") == "F", "IDLE").when(F.col("o_orderstatus") == "P", "FAILED").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", st.after_refresh(state).alias("status"))


@query("""
SELECT l_orderkey AS revision, l_linenumber AS node, l_returnflag AS status FROM lineitem
UNION ALL SELECT -l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'IDLE' ELSE l_returnflag END FROM lineitem WHERE l_orderkey % 11 = 5
""")
def player_submit(spark, sf_dir):
    """A submission forks the revision and sets the answered node."""
    states = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("revision"), F.col("l_linenumber").alias("node"), F.col("l_returnflag").alias("status"))
    parents = states.where("revision % 11 = 5").select(F.col("revision").alias("parent"), (-F.col("revision")).alias("child")).distinct()
    answered = (F.col("revision") < 0) & (F.col("node") == 1)
    return st.forked(states, parents).withColumn("status", F.when(answered, "IDLE").otherwise(F.col("status")))


@query("""
SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'RUNNING' WHEN o_orderkey % 10 = 0 THEN 'PENDING' ELSE o_orderstatus END AS status FROM orders
""")
def schedule_and_rerun(spark, sf_dir):
    """Scheduling replaces a state by PENDING; a rerun of an ended one claims it again."""
    state = F.col("o_orderstatus")
    scheduled = F.when(F.col("o_orderkey") % 10 == 0, "PENDING").otherwise(state)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), st.after_claim(scheduled, state == "F").alias("status"))


@query("SELECT o_orderkey AS action_id, upper(o_orderpriority) AS tag, o_custkey AS scope_id FROM orders UNION ALL SELECT 0, 'CORE:DEFINE_ACTION', 0")
def list_actions(spark, sf_dir):
    """User actions are projected tasks; system actions come with fixed values."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("action_id"), F.upper("o_orderpriority").alias("tag"), F.col("o_custkey").alias("scope_id"))
    system = spark.createDataFrame([(0, "CORE:DEFINE_ACTION", 0)], "action_id long, tag string, scope_id long")
    return own.unionByName(system)


# -- inspection ---------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM orders")
def count_tasks(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def count_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def count_by_two(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT o_custkey) AS runs, count(*) FILTER ((epoch_us(o_orderdate) // 1000) + {TTL * 1000} < {NOW} AND o_orderstatus = 'P') AS expired FROM orders")
def count_distinct_runs(spark, sf_dir):
    lease = st.expired(st.lease_expiry(_ms("o_orderdate"), F.lit(TTL)), F.lit(NOW)) & (F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("runs"), F.count_if(lease).alias("expired"))


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_actions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct()


@query("SELECT l_orderkey, min((epoch_us(l_shipdate) // 1000)) AS first_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey ORDER BY first_at, l_orderkey LIMIT 20")
def min_created_page(spark, sf_dir):
    """The twenty earliest groups (a page)."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.groupBy("l_orderkey").agg(F.min(_ms("l_shipdate")).alias("first_at")).orderBy("first_at", "l_orderkey").limit(20)


@query("SELECT max(event_id) AS version FROM events")
def max_version(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("event_id").alias("version"))


@query("SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS states FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY c_custkey")
def states_by_revision(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    some = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    return some.select("c_custkey", F.array_join(F.transform("x", lambda k: k.cast("string")), ",").alias("states"))
