"""History queries on conversations: assistant turns can be forked, system turns are injected,
a turn's parent is the one before it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog.registry import query, table
from tessera.operators import lineage as lin


def _turns(spark, sf_dir):
    """(task, id, parent_id, turn, role, text), one row a turn (the smallest text where turns repeat)."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x"))
    key = F.concat_ws("-", "conv_id", "turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    named = rows.select(F.col("conv_id").alias("task"), "turn", key.alias("id"), "x.role", "x.text", F.lag(key).over(w).alias("parent_id"))
    return named


_TURNS = """
WITH RECURSIVE t AS (
  SELECT conv_id AS task, turn, conv_id || '-' || turn AS id, role, text, lag(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id
  FROM (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1)),
h AS (SELECT task, arg_max(id, turn) AS start FROM t GROUP BY task),
w(start, id, depth) AS (SELECT start, start, 0 FROM h UNION ALL SELECT w.start, t.parent_id, depth + 1 FROM w JOIN t ON t.id = w.id WHERE t.parent_id IS NOT NULL AND depth < 1000)
"""


def _heads(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return turns, turns.groupBy("task").agg(F.max_by("id", "turn").alias("start")).select("start")


@query(_TURNS + "SELECT start, arg_min(t.id, depth) AS id, min(depth)::BIGINT AS depth FROM w JOIN t ON t.id = w.id WHERE role = 'assistant' GROUP BY start")
def effective_head(spark, sf_dir):
    """From the newest turn back to the first that can be forked."""
    turns, heads = _heads(spark, sf_dir)
    return lin.nearest(turns, turns.where("role = 'assistant'")).join(heads, "start", "left_semi")


@query(_TURNS + "SELECT start, id FROM (SELECT w.start, t.id, row_number() OVER (PARTITION BY start ORDER BY depth) AS n FROM w JOIN t ON t.id = w.id WHERE role = 'assistant' AND depth > 0) WHERE n = 2")
def nth_back(spark, sf_dir):
    turns, heads = _heads(spark, sf_dir)
    return lin.nth(turns, heads, turns.where("role = 'assistant'"), 2)


@query(_TURNS + "SELECT start, count(*) AS n FROM w JOIN t ON t.id = w.id WHERE role = 'assistant' AND depth > 0 GROUP BY start")
def count_back(spark, sf_dir):
    turns, heads = _heads(spark, sf_dir)
    return lin.counted(turns, turns.where("role = 'assistant'")).join(heads, "start", "left_semi")


@query(_TURNS + """, s AS (SELECT start, min(depth) AS stop FROM w JOIN t ON t.id = w.id WHERE role = 'assistant' AND depth > 0 GROUP BY start)
SELECT w.start, w.id, w.depth::INT AS depth FROM w LEFT JOIN s ON s.start = w.start WHERE depth > 0 AND (stop IS NULL OR depth < stop)""")
def preceding_open_chain(spark, sf_dir):
    """Turns before the newest up to the first that can be forked."""
    turns, heads = _heads(spark, sf_dir)
    closed = turns.where("role = 'assistant'").select("id")
    return lin.ancestors(turns, heads, until=closed).where("depth > 0").join(closed, "id", "left_anti").select("start", "id", "depth")


@query(_TURNS + "SELECT id, row_number() OVER (PARTITION BY task ORDER BY turn DESC) - 1 AS n_back FROM t WHERE role = 'assistant'")
def n_back_of_head(spark, sf_dir):
    return lin.numbered(_turns(spark, sf_dir).where("role = 'assistant'"), "task", ["turn"]).select("id", "n_back")


@query(_TURNS + "SELECT id, row_number() OVER (PARTITION BY task ORDER BY turn DESC) + 5 AS n_back FROM t WHERE role = 'assistant' AND id NOT IN (SELECT start FROM h)")
def numbered_page(spark, sf_dir):
    """Numbers continue after an offset of five; the head has none."""
    turns = _turns(spark, sf_dir)
    heads = turns.groupBy("task").agg(F.max_by("id", "turn").alias("id")).select("id")
    rows = lin.numbered(turns.where("role = 'assistant'").join(heads, "id", "left_anti"), "task", ["turn"])
    return rows.select("id", (F.col("n_back") + 1 + 5).alias("n_back"))


@query(_TURNS + """, p AS (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY turn) AS n FROM t)
SELECT a.id AS target, b.id, b.n - a.n AS relative FROM p a JOIN p b ON b.task = a.task AND abs(b.n - a.n) <= 2 WHERE a.n % 4 = 0""")
def surrounding(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    w = Window.partitionBy("task").orderBy("turn")
    targets = turns.withColumn("n", F.row_number().over(w)).where("n % 4 = 0").select(F.col("id").alias("target"))
    return lin.surrounding(turns, targets, "task", ["turn"], "id", 2)


@query(_TURNS + "SELECT id, lag(id) OVER (PARTITION BY task ORDER BY turn) AS previous, lead(id) OVER (PARTITION BY task ORDER BY turn) AS next FROM t")
def previous_and_next(spark, sf_dir):
    w = Window.partitionBy("task").orderBy("turn")
    return _turns(spark, sf_dir).select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


@query(_TURNS + "SELECT task, arg_max(id, turn) AS id FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY task ORDER BY turn DESC) <= 64) WHERE role <> 'system' GROUP BY task")
def latest_forkable(spark, sf_dir):
    """The newest turn that isn't injected, among the newest 64."""
    w = Window.partitionBy("task").orderBy(F.col("turn").desc())
    rows = _turns(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 64 and role <> 'system'")
    return rows.groupBy("task").agg(F.max_by("id", "turn").alias("id"))


@query(_TURNS + "SELECT p.id, min_by(c.id, c.turn) AS child FROM t p JOIN t c ON c.task = p.task AND c.turn > p.turn AND c.role <> 'system' GROUP BY p.id".replace("min_by", "arg_min"))
def first_child(spark, sf_dir):
    """The next descendant that isn't injected (a chain: the next such turn)."""
    w = Window.partitionBy("task").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    child = F.first(F.when(F.col("role") != "system", F.col("id")), ignorenulls=True).over(w)
    return _turns(spark, sf_dir).select("id", child.alias("child")).where("child is not null")


@query(_TURNS + """, c AS (SELECT id, lead(turn) OVER (PARTITION BY task ORDER BY turn) AS nt, task, turn FROM t)
SELECT c.id, string_agg(t.role, ',' ORDER BY t.turn) AS roles, count(*) AS n FROM c JOIN t ON t.task = c.task AND t.turn <= coalesce(c.nt - 1, c.turn) AND (c.nt IS NULL OR t.turn < c.nt) GROUP BY c.id""")
def child_reconstruct(spark, sf_dir):
    """A turn's messages: its child's without the last, or its own."""
    rows = _turns(spark, sf_dir)
    # The conversation's turns once; a child's body without its last message is as long as the turn's own.
    whole = rows.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "id"))).alias("all"))
    each = whole.select(F.posexplode("all").alias("at", "x"), F.transform("all", lambda x: x.role).alias("roles"))
    body = F.slice("roles", F.lit(1), F.col("at") + 1)
    return each.select("x.id", F.array_join(body, ",").alias("roles"), (F.col("at") + 1).cast("long").alias("n"))


@query(_TURNS + """, b AS (SELECT task, arg_max(id, turn) AS head, arg_max(role, turn) AS role FROM t GROUP BY task),
a AS (SELECT start, arg_min(t.id, depth) AS id FROM w JOIN t ON t.id = w.id WHERE role = 'assistant' GROUP BY start)
SELECT b.task, CASE WHEN b.role = 'assistant' THEN b.head ELSE coalesce(a.id, b.head) END AS head FROM b LEFT JOIN a ON a.start = b.head""")
def reclassify_heads(spark, sf_dir):
    """Heads that can't be forked move to the nearest ancestor that can."""
    turns = _turns(spark, sf_dir)
    heads = turns.groupBy("task").agg(F.max_by("id", "turn").alias("head"), F.max_by("role", "turn").alias("role"))
    near = lin.nearest(turns, turns.where("role = 'assistant'")).select(F.col("start").alias("head"), F.col("id").alias("moved"))
    return heads.join(near, "head", "left").select("task", F.when(F.col("role") == "assistant", F.col("head")).otherwise(F.coalesce("moved", "head")).alias("head"))


@query(_TURNS + "SELECT start, max(depth)::BIGINT AS chain FROM w GROUP BY start")
def version_chain(spark, sf_dir):
    """The number of versions before each newest one."""
    turns, heads = _heads(spark, sf_dir)
    return heads.join(lin.counted(turns, turns), "start", "left").select("start", F.coalesce("n", F.lit(0).cast("long")).alias("chain"))


#: A history that forks: document n comes from document n // 3, those in English can be forked.
_TREE = """
WITH RECURSIVE t AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 3 END AS parent_id, lang = 'en' AS fits FROM (SELECT DISTINCT doc_id, max(lang) OVER (PARTITION BY doc_id) AS lang FROM documents)),
w(start, id, depth) AS (SELECT id, id, 0 FROM t UNION ALL SELECT w.start, t.parent_id, depth + 1 FROM w JOIN t ON t.id = w.id WHERE t.parent_id IS NOT NULL)
"""


def _tree(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("id")).agg(F.max("lang").alias("lang"))
    return rows.select("id", F.expr("if(id > 0, id div 3, null)").alias("parent_id"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("fits"))


@query(_TREE + "SELECT start, arg_min(t.id, depth) AS id, min(depth)::BIGINT AS depth FROM w JOIN t ON t.id = w.id WHERE fits GROUP BY start")
def tree_effective_heads(spark, sf_dir):
    """The nearest forkable revision at or above every revision of a history that forks."""
    tree = _tree(spark, sf_dir)
    return lin.nearest(tree, tree.where("fits"))


@query(_TREE + "SELECT start, id FROM (SELECT w.start, t.id, row_number() OVER (PARTITION BY start ORDER BY depth) AS n FROM w JOIN t ON t.id = w.id WHERE fits AND depth > 0) WHERE n = 3")
def tree_third_back(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return lin.nth(tree, tree.select(F.col("id").alias("start")), tree.where("fits"), 3)


@query(_TREE + "SELECT start, count(*) AS n FROM w JOIN t ON t.id = w.id WHERE fits AND depth > 0 GROUP BY start")
def tree_counts_back(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return lin.counted(tree, tree.where("fits"))


@query(_TREE + """, s AS (SELECT start, min(depth) AS stop FROM w JOIN t ON t.id = w.id WHERE fits AND depth > 0 GROUP BY start)
SELECT w.id, min(w.start) AS child FROM w JOIN t c ON c.id = w.start LEFT JOIN s ON s.start = w.start WHERE c.fits AND depth > 0 AND (stop IS NULL OR depth <= stop) GROUP BY w.id""")
def tree_first_children(spark, sf_dir):
    """The earliest forkable descendant that is reached through others only."""
    tree = _tree(spark, sf_dir)
    return lin.first_children(tree, tree.where("fits"), "id")


@query(_TURNS + """SELECT 'turn' AS kind, id, turn FROM t WHERE role = 'assistant' UNION ALL SELECT 'release', id, turn FROM t WHERE role = 'system'""")
def recall_feed(spark, sf_dir):
    """Two feeds merged, the newest first."""
    turns = _turns(spark, sf_dir)
    both = turns.where("role = 'assistant'").select(F.lit("turn").alias("kind"), "id", "turn").unionByName(turns.where("role = 'system'").select(F.lit("release").alias("kind"), "id", "turn"))
    return both.orderBy(F.col("turn").desc(), F.col("id").desc())
