"""Queries of the scalar functions: messages, labels, headers, streams, cursors, maps, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query, table
from tessera.functions import ids, messages as msg


def _conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("""
SELECT conv_id, turn, role, CASE WHEN length(s) > 100 THEN left(s, 99) || '…' ELSE s END AS preview
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)
""")
def message_previews(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", "turn", "role", msg.truncated(msg.squeezed(F.col("text"))).alias("preview"))


@query("""
WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations),
u AS (SELECT conv_id, arg_max(i, i) AS ui, arg_max(s, i) AS s FROM m WHERE role = 'user' AND s <> '' GROUP BY conv_id),
p AS (SELECT u.conv_id, arg_max(m.s, m.i) AS s FROM u JOIN m ON m.conv_id = u.conv_id AND m.i < u.ui WHERE m.role = 'assistant' AND m.s <> '' GROUP BY u.conv_id)
SELECT c.conv_id, CASE WHEN length(u.s) > 100 THEN left(u.s, 99) || '…' ELSE u.s END AS "user", CASE WHEN length(p.s) > 100 THEN left(p.s, 99) || '…' ELSE p.s END AS prior_assistant
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON u.conv_id = c.conv_id LEFT JOIN p ON p.conv_id = c.conv_id
""")
def turn_previews(spark, sf_dir):
    some = _conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return some.select("conv_id", msg.turn_preview(F.col("m")).alias("p")).select("conv_id", "p.user", "p.prior_assistant")


@query("""
SELECT conv_id, turn, kind, k = 1 OR k = 3 AS injected FROM (SELECT conv_id, turn, role AS kind, (conv_id + turn) % 5 AS k FROM conversations)
""")
def injection_filter(spark, sf_dir):
    """Texts with and without a harness's openings and reminders."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(k == 1, F.lit("[SUGGESTION MODE: x] y")).when(k == 2, F.lit("<system-reminder>a</system-reminder> real")).when(k == 3, F.lit("<system-reminder>a\nb</system-reminder>  <system-reminder>c</system-reminder>\n")).otherwise(F.lit("plain [SUGGESTION MODE:"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("kind"), msg.is_injection(text).alias("injected"))


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 1 WHEN 1 THEN NULL WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END::INT AS matched FROM conversations")
def meta_references(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 6
    text = F.when(k == 0, "please See above for it").when(k == 1, "we saw above 90% of it").when(k == 2, "continue from where we left off").when(k == 3, "Redo your last answer").when(k == 4, "the previous question I asked").otherwise("nothing")
    return _conversations(spark, sf_dir).select("conv_id", "turn", msg.meta_reference(text).alias("matched"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tok_' || lower(printf('%012x', event_id)) END AS token FROM events
""")
def anchor_tokens(spark, sf_dir):
    token = F.concat(F.lit("tok_"), F.lpad(F.lower(F.hex("event_id")), 12, "0"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x <my-anchor token=\\\""), token, F.lit("\\\" /> y"))).otherwise(F.concat(F.lit("<my-anchor token="), token, F.lit(" />")))
    return table(spark, sf_dir, "events").select("event_id", msg.anchor_token(text).alias("token"))


@query("SELECT event_id, 'Authorization=REDACTED,X-Trace=' || user_id || ',cookie=REDACTED,x-own=' || CASE WHEN event_id % 2 = 0 THEN 'REDACTED' ELSE 'v' END AS headers FROM events")
def redact_map(spark, sf_dir):
    headers = F.create_map(F.lit("Authorization"), F.lit("secret"), F.lit("X-Trace"), F.col("user_id").cast("string"), F.lit("cookie"), F.lit("c"), F.lit("x-own"), F.lit("v"))
    rows = table(spark, sf_dir, "events").withColumn("h", F.when(F.col("event_id") % 2 == 0, msg.redacted(headers, ("X-Own",))).otherwise(msg.redacted(headers)))
    names = F.array(*(F.lit(x) for x in ("Authorization", "X-Trace", "cookie", "x-own")))
    return rows.select("event_id", F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.element_at("h", k))), ",").alias("headers"))


@query("SELECT event_id, event_type AS stop_reason, CASE event_type WHEN 'click' THEN 'turn' WHEN 'purchase' THEN 'rewind_marker' ELSE 'turn' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'fork_point' ELSE 'bookmark' END AS branch FROM events")
def turn_and_branch_kinds(spark, sf_dir):
    stop = F.when(F.col("event_type") == "purchase", "rewind_synthetic").otherwise(F.col("event_type"))
    label = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("fork@"), "user_id")).otherwise(F.concat(F.lit("mark@"), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stop_reason"), msg.turn_kind(stop).alias("kind"), msg.branch_kind(label).alias("branch"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'lab' || event_id END AS label FROM events")
def clean_labels(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("\x01\x7f ")).otherwise(F.concat(F.lit("\x02lab"), "event_id", F.lit("\t")))
    return table(spark, sf_dir, "events").select("event_id", msg.clean_label(raw).alias("label"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'tool_use' ELSE 'end_turn' END AS stop_reason FROM events")
def sse_stop_reasons(spark, sf_dir):
    """Streams whose last delta before the stop names the reason."""
    stop = F.when(F.col("event_type") == "click", "tool_use").otherwise("end_turn")
    head = F.lit('event: message_start\ndata: {"type":"message_start"}\n\ndata: {"type":"message_delta",\ndata: "delta":{"stop_reason":"max_tokens"}}\n\n')
    delta = F.concat(F.lit('data: {"type":"message_delta","delta":{"stop_reason":"'), stop, F.lit('"}}\r\n\r\n'))
    tail = F.lit('data: {"type":"message_stop"}\n\ndata: {"type":"message_delta","delta":{"stop_reason":"late"}}\n\n')
    body = F.when(F.col("event_type") == "view", F.lit('data: {"type":"ping"}\n\n')).otherwise(F.concat(head, delta, tail))
    return table(spark, sf_dir, "events").select("event_id", msg.sse_stop_reason(body).alias("stop_reason"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'end_turn' END AS stop_reason FROM events")
def json_stop_reasons(spark, sf_dir):
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.lit('{"stop_reason":"end_turn"}')).when(k == 1, F.lit('{"stop_reason":5}')).otherwise(F.lit("not json"))
    return table(spark, sf_dir, "events").select("event_id", msg.json_stop_reason(body).alias("stop_reason"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) FILTER (turn <= last) AS roles FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE last IS NOT NULL GROUP BY conv_id")
def trailing_users_trimmed(spark, sf_dir):
    """Messages up to the last assistant's."""
    some = _conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    kept = some.select("conv_id", msg.trimmed_to_assistant(F.col("m")).alias("m")).where(F.size("m") > 0)
    return kept.select("conv_id", F.array_join(F.transform("m", lambda x: x.role), ",").alias("roles"))


@query("SELECT o_orderkey, (7 + greatest(n - 3, 0))::BIGINT AS n FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def spliced_messages(spark, sf_dir):
    """Seven target messages, then those after the anchor in third place."""
    some = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("m"))
    target = F.sequence(F.lit(101), F.lit(107))
    return some.select("o_orderkey", F.size(msg.spliced(F.col("m"), target, F.lit(2))).cast("long").alias("n"))


@query("SELECT l_orderkey, least(count(*), 3)::BIGINT AS kept FROM lineitem GROUP BY l_orderkey")
def capped_markers(spark, sf_dir):
    """With one protected marker, the last three of the others stay."""
    some = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("m"))
    return some.select("l_orderkey", F.size(F.filter(msg.capped_markers(F.col("m"), F.lit(1)), lambda x: x)).cast("long").alias("kept"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber < last)::BIGINT AS removed FROM (SELECT *, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey), -1) AS last FROM lineitem) GROUP BY l_orderkey")
def ttl_violations(spark, sf_dir):
    """Short-lived markers before the last long-lived one go."""
    some = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", "1h").otherwise("5m").alias("ttl")))).alias("m"))
    return some.select("l_orderkey", F.size(F.filter(msg.ttl_violations(F.transform("m", lambda x: x.ttl)), lambda x: x)).cast("long").alias("removed"))


@query("SELECT n_nationkey, base64(n_name::BLOB) AS cursor, n_name AS decoded FROM nation")
def cursors(spark, sf_dir):
    made = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", ids.encode_cursor(F.col("n_name")).alias("cursor"))
    return made.select("n_nationkey", "cursor", ids.decode_cursor(F.col("cursor")).alias("decoded"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, (epoch_us(o_orderdate) // 1000) AS millis, (epoch_us(o_orderdate) // 1000) + 300000 AS expires FROM orders")
def date_functions(spark, sf_dir):
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.'000Z'").alias("iso"), ms.alias("millis"), (ms + 300 * 1000).alias("expires"))


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity)::BIGINT AS low, least(greatest(l_quantity, 10.0), 40.0) AS clamped, ceil(l_quantity / 7)::BIGINT AS pieces, l_quantity >= 50 * 0.75 AS due FROM lineitem")
def math_functions(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(q).alias("low"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clamped"), F.ceil(q / 7).alias("pieces"), (q >= 50 * 0.75).alias("due"))


@query("SELECT o_custkey, max(o_orderkey) AS last, count(*) FILTER (o_orderkey % 2 = 0) AS even, bool_and(o_orderkey > 5) AS all_large, bool_or(o_orderkey % 7 = 0) AS some_seventh FROM orders GROUP BY o_custkey")
def array_functions(spark, sf_dir):
    some = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return some.select("o_custkey", F.element_at("k", -1).alias("last"), F.size(F.filter("k", lambda x: x % 2 == 0)).cast("long").alias("even"), F.forall("k", lambda x: x > 5).alias("all_large"), F.exists("k", lambda x: x % 7 == 0).alias("some_seventh"))


@query("SELECT event_id, 'kind,user' AS keys, event_type || ':' || user_id AS merged, 1::BIGINT AS n_meta, true AS ready FROM events")
def map_functions(spark, sf_dir):
    """Slots as maps: metadata apart, later values over earlier ones, presence without regard to null."""
    base = F.create_map(F.lit("kind"), F.lit("none"), F.lit("^note"), F.lit("m"))
    over = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    data = F.map_filter(base, lambda k, _: ~k.startswith("^"))
    meta = F.map_filter(base, lambda k, _: k.startswith("^"))
    merged = F.map_concat(F.map_filter(data, lambda k, _: ~F.map_contains_key(over, k)), over)
    rows = table(spark, sf_dir, "events").select("event_id", merged.alias("m"), F.size(meta).cast("long").alias("n_meta"))
    return rows.select("event_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.concat_ws(":", F.element_at("m", "kind"), F.element_at("m", "user")).alias("merged"), "n_meta", F.forall(F.array(F.lit("kind"), F.lit("user")), lambda s: F.map_contains_key("m", s)).alias("ready"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' || chr(10) || 'b' ELSE 'plain' END AS text FROM events")
def message_texts(spark, sf_dir):
    """Content that is a string, or blocks of which the text ones count."""
    content = F.when(F.col("event_id") % 2 == 0, F.lit('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]')).otherwise(F.lit('"plain"'))
    return table(spark, sf_dir, "events").select("event_id", msg.json_message_text(content).alias("text"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS trace, false AS asset, n_nationkey % 3 = 0 AS system FROM nation")
def validators(spark, sf_dir):
    n = F.col("n_nationkey")
    made = F.when(n % 2 == 0, ids.trace_id(F.lit(1700000000000), n.cast("long"), n.cast("long"))).otherwise("not-an-id")
    action = F.when(n % 3 == 0, "core:define_action").otherwise("user:act")
    return table(spark, sf_dir, "nation").select("n_nationkey", ids.is_trace_id(made).alias("trace"), ids.is_asset_id(F.col("n_name")).alias("asset"), action.startswith("core:").alias("system"))


@query("""SELECT c_custkey, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'deleted' ELSE 'ambiguous: ' || ks END AS answer FROM (
SELECT c_custkey, count(o_orderkey) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def label_resolution(spark, sf_dir):
    """A label that names none, one or several rows."""
    some = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    customer = table(spark, sf_dir, "customer")
    n = F.coalesce(F.size("k"), F.lit(0))
    text = F.concat(F.lit("ambiguous: "), F.array_join(F.transform("k", lambda x: x.cast("string")), ","))
    return customer.join(some, customer.c_custkey == some.o_custkey, "left").select("c_custkey", F.when(F.col("k").isNull(), "none").when(n == 1, "deleted").otherwise(text).alias("answer"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'number' END AS kind FROM events")
def json_kinds(spark, sf_dir):
    """The kind of a JSON value; null where it isn't JSON."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.col("props")).when(k == 1, "[1, 2]").when(k == 2, '"x"').when(k == 3, "2.5").otherwise("{broken")
    kind = F.schema_of_variant(F.try_parse_json(text))
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind.isNotNull(), "number")
    return table(spark, sf_dir, "events").select("event_id", named.alias("kind"))


@query("""
WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last, turn FROM conversations)
SELECT conv_id, count(*) AS n, sum(length(text)) + CASE WHEN count(last) > 0 THEN 9 ELSE 0 END AS chars FROM m GROUP BY conv_id
""")
def reminded_messages(spark, sf_dir):
    """A reminder of eight characters and a line feed goes in front of the last user message."""
    some = _conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    out = some.select("conv_id", msg.reminded(F.col("m"), F.lit("remember")).alias("m"))
    return out.select("conv_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x.text)).alias("chars"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') > 1 AS parallel FROM lineitem GROUP BY l_orderkey")
def parallel_tools(spark, sf_dir):
    """Bodies whose last message has several tool results."""
    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") == "R", "tool_result").otherwise("text").alias("type"))).alias("b"))
    return blocks.select("l_orderkey", (F.size(F.filter("b", lambda x: x.type == "tool_result")) > 1).alias("parallel"))
