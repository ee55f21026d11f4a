"""Event-log queries: polls, offsets, the sessions and revisions views, forks.

The recast: users are sessions, signups inits, views requests, errors also closes;
purchases, clicks and errors end the latest earlier request of their user.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog.registry import query, table
from tessera.sources import event_log
from tessera.streaming import views

MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def session_log(spark, sf_dir):
    """signup, view and error as init, request and close."""
    topic = F.when(F.col("event_type") == "signup", views.INIT).when(F.col("event_type") == "view", views.REQUEST).when(F.col("event_type") == "error", views.CLOSE).otherwise("other")
    k = F.get_json_object("props", "$.k").cast("long")
    harness = F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("h"), k % 3))
    payload = F.to_json(F.struct(harness.alias("harness"), F.when(k % 2 == 0, k).alias("pid")))
    return table(spark, sf_dir, "events").select("event_id", topic.alias("topic"), payload.alias("payload"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr(MS).alias("created_at"))


def request_log(spark, sf_dir):
    """Views as requests; purchase, click and error end the user's latest earlier view."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    request = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    topic = F.when(F.col("event_type") == "view", views.REQUEST).when(F.col("event_type").isin("purchase", "click"), views.COMPLETED).when(F.col("event_type") == "error", views.FAILED).otherwise("other")
    stop = F.when(F.col("event_type") == "purchase", "end_turn").when(F.col("event_type") == "click", "tool_use")
    rows = table(spark, sf_dir, "events").withColumn("request", request)
    payload = F.to_json(F.struct(F.when(F.col("event_type") != "view", F.col("request")).alias("request_event_id"), stop.alias("stop_reason")))
    return rows.select("event_id", topic.alias("topic"), payload.alias("payload"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr(MS).alias("created_at"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click') AND event_id > 500 ORDER BY event_id LIMIT 10")
def event_poll(spark, sf_dir):
    """The next ten events after an offset (a poll's batch)."""
    log = table(spark, sf_dir, "events").withColumn("topic", F.col("event_type"))
    return event_log.poll(log, ["view", "click"], 500).select("event_id", "event_type")


@query("""
SELECT v AS "view", max(event_id) AS last_event_id FROM (VALUES ('sessions', 'signup'), ('sessions', 'view'), ('revisions', 'view'), ('revisions', 'purchase'), ('audit', 'none')) s(v, t)
LEFT JOIN events ON event_type = t GROUP BY v
""")
def projection_offsets(spark, sf_dir):
    subscriptions = spark.createDataFrame([("sessions", "signup"), ("sessions", "view"), ("revisions", "view"), ("revisions", "purchase"), ("audit", "none")], "view string, topic string")
    return event_log.offsets(table(spark, sf_dir, "events").withColumn("topic", F.col("event_type")), subscriptions)


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def topic_index(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
WITH e AS (SELECT *, 's' || user_id AS sid, (props->>'$.k')::BIGINT AS k, (epoch_us(ts) // 1000) AS tm FROM events),
f AS (SELECT sid, min(event_id) AS first_id FROM e WHERE event_type IN ('signup', 'view') GROUP BY sid)
SELECT f.sid AS session_id, 't_' || substr(sha256('task:' || f.sid), 1, 32) AS task_id,
  (SELECT tm FROM e WHERE e.event_id = f.first_id) AS created_at,
  (SELECT tm FROM e WHERE e.sid = f.sid AND event_type = 'error' AND event_id > f.first_id ORDER BY event_id LIMIT 1) AS ended_at,
  (SELECT k FROM e WHERE e.sid = f.sid AND event_type = 'signup' AND k % 2 = 0 ORDER BY event_id DESC LIMIT 1) AS pid,
  coalesce((SELECT CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'h' || (k % 3) END FROM e WHERE e.sid = f.sid AND event_type = 'signup' ORDER BY event_id LIMIT 1), 'orphan') AS harness,
  'default' AS actor
FROM f
""")
def sessions_view(spark, sf_dir):
    return views.sessions(session_log(spark, sf_dir))


_REVISIONS = """
WITH e AS (SELECT event_id, 's' || user_id AS sid, event_type AS t, (epoch_us(ts) // 1000) AS tm,
  last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS req FROM events),
x AS (SELECT req, max(event_id) AS end_id FROM e WHERE t IN ('purchase', 'click', 'error') AND req IS NOT NULL GROUP BY req),
r AS (SELECT q.event_id AS id, q.sid AS session_id, q.tm AS created_at, d.tm AS sealed_at, d.event_id AS end_id,
  CASE d.t WHEN 'purchase' THEN 'end_turn' WHEN 'click' THEN 'tool_use' END AS stop_reason,
  CASE WHEN d.t IS NULL THEN 'in_flight' WHEN d.t = 'purchase' THEN 'closed_forkable' WHEN d.t = 'click' THEN 'open' ELSE 'dangling_unforkable' END AS classification
  FROM e q LEFT JOIN x ON x.req = q.event_id LEFT JOIN e d ON d.event_id = x.end_id WHERE q.t = 'view')
"""


@query(
    _REVISIONS
    + """SELECT r.id, session_id, created_at, sealed_at, stop_reason, classification, pp.parent_id
FROM r LEFT JOIN (SELECT a.id, arg_max(b.id, row(b.sealed_at, b.id)) AS parent_id FROM r a JOIN r b ON b.session_id = a.session_id AND b.end_id < a.id AND b.sealed_at <= a.created_at GROUP BY a.id) pp ON pp.id = r.id
"""
)
def revisions_view(spark, sf_dir):
    return views.revisions(request_log(spark, sf_dir))


@query(_REVISIONS + "SELECT classification, count(*) AS n FROM r GROUP BY classification")
def classify_reason(spark, sf_dir):
    return views.revisions(request_log(spark, sf_dir)).groupBy("classification").agg(F.count("*").alias("n"))


@query(_REVISIONS + "SELECT id, session_id, sealed_at FROM r WHERE classification = 'closed_forkable' AND sealed_at IS NOT NULL")
def forkable_revisions(spark, sf_dir):
    return views.revisions(request_log(spark, sf_dir)).where("classification = 'closed_forkable' and sealed_at is not null").select("id", "session_id", "sealed_at")


def _fork_log(spark, sf_dir):
    """Clicks fork: the synthetic revision is named after the event, its landing after k."""
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.to_json(F.struct(F.concat(F.lit("r"), k).alias("synthetic_revision_id"), F.col("user_id").cast("string").alias("parent_revision_id"), F.expr(MS).alias("sealed_at"), F.lit("rewind").alias("kind"), F.concat(F.lit("v"), k % 40).alias("to_revision_id")))
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.lit(views.FORKED).alias("topic"), payload.alias("payload"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr(MS).alias("created_at"))


@query("""
SELECT id, arg_min(user_id, event_id)::VARCHAR AS parent_id, arg_min((epoch_us(ts) // 1000), event_id) AS sealed_at, 'rewind_synthetic' AS stop_reason
FROM (SELECT *, 'r' || (props->>'$.k') AS id FROM events WHERE event_type = 'click') GROUP BY id HAVING arg_min(user_id, event_id) % 2 = 0
""")
def synthetic_revisions(spark, sf_dir):
    """First fork wins; only parents that are known (even ones)."""
    known = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("id")).distinct()
    return views.synthetic_revisions(_fork_log(spark, sf_dir), known).select("id", "parent_id", "sealed_at", "stop_reason")


@query("SELECT 'v' || ((props->>'$.k')::BIGINT % 40) AS landing, arg_max('r' || (props->>'$.k'), event_id) AS synthetic FROM events WHERE event_type = 'click' GROUP BY 1")
def landing_pairs(spark, sf_dir):
    return views.landings(_fork_log(spark, sf_dir))[0]


@query("""
SELECT event_id::VARCHAR AS landing FROM events e WHERE event_type = 'view' AND (props->>'$.k')::BIGINT % 2 = 0
AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND (c.props->>'$.k')::BIGINT % 40 = e.event_id % 97 )
""")
def orphan_landings(spark, sf_dir):
    """Requests that were to be applied to a fork that never came."""
    k = F.get_json_object("props", "$.k").cast("long")
    requests = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", F.lit(views.REQUEST).alias("topic"), F.to_json(F.struct(F.when(k % 2 == 0, F.lit("x")).alias("tobe_applied_from"))).alias("payload"), F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("long").alias("created_at"))
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select((k % 40).alias("n")).distinct()
    targets = requests.select("event_id", (F.col("event_id") % 97).alias("n")).join(clicks, "n", "left_semi")
    forks = targets.select(F.col("event_id"), F.lit(views.FORKED).alias("topic"), F.to_json(F.struct(F.col("event_id").cast("string").alias("to_revision_id"), F.lit("r").alias("synthetic_revision_id"))).alias("payload"), F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("long").alias("created_at"))
    return views.landings(requests.unionByName(forks))[1]


@query("""
SELECT e.event_id, arg_max(d.event_id, d.event_id) AS outcome_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS req FROM events) d
JOIN events e ON e.event_id = d.req WHERE d.event_type IN ('purchase', 'click', 'error') GROUP BY e.event_id
""")
def last_outcome(spark, sf_dir):
    """The last terminal event of each request that has one."""
    log = request_log(spark, sf_dir)
    ends = log.where(F.col("topic").isin(*views.TERMINAL)).select(F.get_json_object("payload", "$.request_event_id").cast("long").alias("request"), F.col("event_id").alias("outcome_id"))
    requests = log.where(F.col("topic") == views.REQUEST).select("event_id")
    return requests.join(ends, requests.event_id == ends.request).groupBy("event_id").agg(F.max("outcome_id").alias("outcome_id"))


@query("""
SELECT user_id, CASE WHEN n > 20 THEN 'over' ELSE 'under' END AS kind, count(*) AS windows FROM (
  SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY ALL
""")
def rate_limited(spark, sf_dir):
    """Events that come on top of twenty others in the window before them."""
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-59999999, 0)
    rows = table(spark, sf_dir, "events").select("user_id", F.expr(MS).alias("at")).withColumn("n", F.count("*").over(w))
    return rows.groupBy("user_id", F.when(F.col("n") > 20, "over").otherwise("under").alias("kind")).agg(F.count("*").alias("windows"))


@query("SELECT event_id, event_type FROM events WHERE try_cast(props->>'$.k' AS BIGINT) > 50")
def json_path_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("long") > 50).select("event_id", "event_type")


@query("""SELECT count(*) AS n FROM events WHERE props LIKE '%"k": 5%'""")
def json_like_probe(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("props").like('%"k": 5%')).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE (props->>'$.k') IS NOT NULL")
def json_presence(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isNotNull()).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY user_id")
def semi_join_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bad = events.where("event_type = 'error'").select("user_id").distinct()
    return events.where(F.col("event_type").isin("view", "click")).join(bad, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def key_value_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("""
SELECT e.event_id, max(s.event_id) AS signup_id FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND (epoch_us(s.ts) // 1000) <= (epoch_us(e.ts) // 1000) AND s.event_id = (
  SELECT max(z.event_id) FROM events z WHERE z.user_id = e.user_id AND z.event_type = 'signup' AND (epoch_us(z.ts) // 1000) = (SELECT max((epoch_us(y.ts) // 1000)) FROM events y WHERE y.user_id = e.user_id AND y.event_type = 'signup' AND (epoch_us(y.ts) // 1000) <= (epoch_us(e.ts) // 1000)))
WHERE e.event_type = 'purchase' GROUP BY e.event_id
""")
def asof_parent(spark, sf_dir):
    """The latest signup of the user not after each purchase."""
    from tessera.operators.lineage import as_of

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(MS).alias("at"))
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = rows.where("event_type = 'signup'").select("user_id", F.col("at").alias("sealed_at"), F.col("event_id").alias("signup_id"))
    return as_of(left, right, "user_id", "at", "sealed_at", "signup_id").select("event_id", "signup_id")


@query(_REVISIONS + "SELECT r.id, f.sid AS session_id FROM r JOIN (SELECT DISTINCT 's' || user_id AS sid FROM events WHERE event_type = 'signup') f ON f.sid = r.session_id WHERE classification = 'closed_forkable'")
def revisions_with_sessions(spark, sf_dir):
    """Forkable revisions of sessions that were opened."""
    opened = session_log(spark, sf_dir).where(F.col("topic") == views.INIT).select("session_id").distinct()
    return views.revisions(request_log(spark, sf_dir)).where("classification = 'closed_forkable'").join(opened, "session_id").select("id", "session_id")


@query("SELECT event_id, 's' || user_id AS session_id FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('signup', 'view'))")
def session_releases(spark, sf_dir):
    """Closing events joined with the sessions view."""
    log = session_log(spark, sf_dir)
    known = views.sessions(log).select("session_id")
    return log.where(F.col("topic") == views.CLOSE).join(known, "session_id").select("event_id", "session_id")


@query("""
SELECT s.session_id, CASE WHEN s.user_id % 2 = 0 THEN 'actor' || s.user_id ELSE 'default' END AS actor
FROM (SELECT DISTINCT user_id, 's' || user_id AS session_id FROM events WHERE event_type IN ('signup', 'view')) s
""")
def pending_actors(spark, sf_dir):
    """An actor registered before is handed to the session's first event."""
    log = session_log(spark, sf_dir)
    actors = log.select("session_id").distinct().where(F.substring("session_id", 2, 10).cast("long") % 2 == 0).select("session_id", F.concat(F.lit("actor"), F.substring("session_id", 2, 10)).alias("actor"))
    return views.sessions(log, actors).select("session_id", "actor")


@query("""
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS held FROM events e
WHERE event_type = 'click' AND event_id > coalesce((SELECT max(event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase'), -1) GROUP BY user_id
""")
def held_emissions(spark, sf_dir):
    """What waits for a closing event: clicks after the user's last purchase."""
    rows = table(spark, sf_dir, "events")
    last = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    held = rows.where("event_type = 'click'").join(last, "user_id", "left").where("event_id > coalesce(last, -1)")
    some = held.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("x"))
    return some.select("user_id", F.array_join(F.transform("x", lambda k: k.cast("string")), ",").alias("held"))


def _branch_changes(spark, sf_dir):
    """Each user's log as branch changes: signups create views at the latest revision, views are
    revisions that complete at once, clicks relabel, errors delete."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").withColumn("k", k % 8)
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("event_type") == "view", F.col("event_id").cast("string")), ignorenulls=True).over(w)
    topic = F.when(F.col("event_type") == "signup", views.CREATED).when(F.col("event_type") == "view", views.COMPLETED).when(F.col("event_type") == "click", views.LABELLED).when(F.col("event_type") == "error", views.DELETED).otherwise("other")
    head = F.when(F.col("event_type") == "view", F.col("event_id").cast("string")).otherwise(previous)
    return rows.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("position"), topic.alias("topic"), F.concat(F.lit("b"), "k").alias("view_id"), head.alias("head"), previous.alias("parent"), F.concat(F.lit("l"), "event_id").alias("label"), F.lit("bookmark").alias("auto_label"), F.expr(MS).alias("created_at"))


@query()
def branch_views(spark, sf_dir):
    """A sequential fold; compared with a brute-force fold in the tests."""
    return views.branch_views(_branch_changes(spark, sf_dir))
