"""Content-store queries: hashing, deduplicated appends, bodies and leaves, links, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query, table
from tessera.functions import ids, values
from tessera.operators import store


@query("SELECT sha256(text) AS cid, min(doc_id) AS created_at, any_value(length(text))::BIGINT AS size FROM documents GROUP BY sha256(text)")
def content_dedup(spark, sf_dir):
    """Equal contents are stored once; the first stays."""
    docs = table(spark, sf_dir, "documents").select(store.content_id(F.col("text")).alias("cid"), F.col("doc_id").alias("created_at"), F.length("text").cast("long").alias("size"))
    none = docs.limit(0)
    return store.new_blobs(docs, none)


@query("SELECT sha256(text) AS cid, min(doc_id) AS created_at FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def anti_join_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(store.content_id(F.col("text")).alias("cid"), F.col("doc_id").alias("created_at"))
    return store.new_blobs(docs, docs.where("created_at % 2 = 0"))


def _bodies(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("m"))
    some = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("x"))
    return some.select(F.col("conv_id").alias("body_id"), F.transform("x", lambda e: e.m).alias("messages"))


@query("SELECT sha256(m) AS cid, m AS content FROM (SELECT DISTINCT concat_ws(': ', role, text) AS m FROM conversations)")
def split_body_blobs(spark, sf_dir):
    return store.split_bodies(_bodies(spark, sf_dir))[0]


@query("SELECT conv_id AS body_id, sha256(string_agg(sha256(concat_ws(': ', role, text)), ',' ORDER BY turn, concat_ws(': ', role, text))) AS cid FROM conversations GROUP BY conv_id")
def split_body_tops(spark, sf_dir):
    return store.split_bodies(_bodies(spark, sf_dir))[1].select("body_id", "cid")


@query("SELECT conv_id AS body_id, coalesce(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, concat_ws(': ', role, text)) FILTER (role <> 'system'), '') AS messages FROM conversations GROUP BY conv_id")
def hydrate_bodies(spark, sf_dir):
    """Bodies put together from their leaves; the system's are missing and left out."""
    blobs, tops = store.split_bodies(_bodies(spark, sf_dir))
    return store.hydrate(tops, blobs.where("content not like 'system: %'")).select("body_id", F.array_join("messages", "\n").alias("messages"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(text, 20) ELSE left(lang, 20) END AS body FROM documents")
def hydrate_fallback(spark, sf_dir):
    """The leaf where it is there, else the body itself."""
    docs = table(spark, sf_dir, "documents")
    leaves = docs.where("doc_id % 3 = 0").select("doc_id", F.left("text", F.lit(20)).alias("leaf"))
    return docs.select("doc_id", "lang").join(leaves, "doc_id", "left").select("doc_id", F.coalesce("leaf", F.left("lang", F.lit(20))).alias("body"))


@query("SELECT doc_id, 't_' || substr(sha256('task:' || doc_id), 1, 32) AS task_id FROM documents")
def stable_task_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.stable_id("t_", "task:", F.col("doc_id")).alias("task_id"))


@query("""
SELECT event_id, lower(printf('%012x', (epoch_us(ts) // 1000))) AS time_hex, (epoch_us(ts) // 1000) AS millis, user_id * 1000003 AS operation, event_id AS sequence, true AS valid FROM events
""")
def trace_ids(spark, sf_dir):
    """Ids made of time, operation and sequence, taken apart again."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    made = table(spark, sf_dir, "events").select("event_id", ids.trace_id(ms, F.col("user_id") * 1000003, F.col("event_id")).alias("t"))
    return made.select("event_id", F.regexp_replace(F.substring("t", 1, 13), "-", "").alias("time_hex"), ids.trace_millis(F.col("t")).alias("millis"), ids.trace_operation(F.col("t")).alias("operation"), ids.trace_sequence(F.col("t")).alias("sequence"), ids.is_trace_id(F.col("t")).alias("valid"))


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS cid, o_custkey // 2 AS target FROM orders WHERE o_custkey > 1),
r(root, cid, depth) AS (SELECT DISTINCT cid, cid, 0 FROM l WHERE cid % 10 = 0 UNION ALL SELECT r.root, l.target, depth + 1 FROM r JOIN l ON l.cid = r.cid WHERE depth < 32)
SELECT root, cid, min(depth)::INT AS depth FROM r GROUP BY root, cid
""")
def resolve_links(spark, sf_dir):
    """Everything a value reaches over its links."""
    links = table(spark, sf_dir, "orders").where("o_custkey > 1").select(F.col("o_custkey").alias("cid"), F.expr("o_custkey div 2").alias("target")).distinct()
    return store.closure(links.where("cid % 10 = 0").select(F.col("cid").alias("root")).distinct(), links)


@query("SELECT event_id FROM events WHERE event_id BETWEEN 10 AND 20")
def load_by_id(spark, sf_dir):
    """Blobs by their ids: a semi join."""
    wanted = spark.range(10, 21).select(F.col("id").alias("event_id"))
    return table(spark, sf_dir, "events").select("event_id").join(wanted, "event_id", "left_semi")


@query("SELECT page_id, k::INT AS number, k * 1000 AS \"offset\", least(1000, strlen(html) - k * 1000)::BIGINT AS length FROM (SELECT page_id, html, unnest(range(0, greatest(1, ceil(strlen(html) / 1000.0))::BIGINT)) AS k FROM pages)")
def upload_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(store.chunks(F.octet_length("html").cast("long"), 1000)).alias("c"))
    return rows.select("page_id", "c.number", "c.offset", "c.length")


@query("""
SELECT event_id, sha256('add' || chr(10) || sha256(props)) AS task_id FROM events
""")
def apply_task_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.task_id(F.lit("add"), F.sha2("props", 256)).alias("task_id"))


@query("SELECT l_linestatus || l_returnflag AS prefix, count(*) AS n FROM lineitem GROUP BY 1")
def prefix_partitions(spark, sf_dir):
    """How blobs fan out by the first characters of their id."""
    return table(spark, sf_dir, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("prefix")).agg(F.count("*").alias("n"))


@query()
def value_ids(spark, sf_dir):
    """Merkle identifiers of JSON values; their algebra is tested."""
    return table(spark, sf_dir, "events").select("event_id", values.json_value_id("props").alias("cid"))


@query("""
WITH l AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id AS file_id, count(*) AS n_messages, CASE WHEN arg_max(role, turn * 10 + CASE role WHEN 'assistant' THEN 1 ELSE 2 END) <> 'assistant' THEN 'last is not an assistant''s' END AS problem FROM l GROUP BY conv_id
""")
def valid_submissions(spark, sf_dir):
    """Each conversation as JSON lines, checked."""
    rank = F.col("turn") * 10 + F.when(F.col("role") == "assistant", 1).otherwise(2)
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), rank.alias("line_no"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("line"))
    return store.valid_submission(lines)
