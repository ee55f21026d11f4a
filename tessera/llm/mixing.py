"""Operator 4, mixing sources to target weights [native]: iterative proportional fitting.

Tokens (words: runs of characters other than space and ``\\x09``-``\\x0D``) are summed for each
cell source x language x topic.  Raking scales the cells in turn to the target marginals of
source, language and topic until all of them fit.  Probabilities in proportion to fitted / present
tokens would exceed 1 in thin cells, and cutting them off there misses the targets.  So samples
of SIZES sizes are raked once more at the same time, each pass bounded by the tokens present, to the
marginals of the fitted cells; the largest that meets them within CLOSE gives the calibrated
probabilities (the smallest size always does: there nothing is cut off).  A document is kept by
a hash of its id and text.

The number of cells is bounded by the targets: values without a target of their own fall
into ``OTHER``.  So the fitted table has at most |sources| x |languages| x |topics| rows,
raking runs on one partition without shuffles, and the factors are broadcast.

Defined results
---------------
* null source or language: ``OTHER``; null or empty text: no tokens, topic ``OTHER``, and the
  document is kept with its cell's probability (0 where the cell has no tokens);
* equal ids are told apart by their text; repeated rows share their fate;
* a target whose values hold no tokens can't be met: its weight goes to the others;
* targets that contradict each other where cells are empty: the marginals of the last pass are met,
  and :func:`marginals` shows how far they are from the targets;
* an empty table gives no rows; extra columns are carried along; clashing names (RESULTS) are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, written

OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")
RESULTS = ("n_words", "topic", "probability", "u", "kept")
#: Topics of the production mixture, by the share of capital letters, digits and long lines
#: (the corpus has no topic column): the first condition that holds names the topic.
TOPICS = {
    "loud": "char_length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) * 2 < char_length(t)",
    "records": "(char_length(t) - char_length(translate(t, '0123456789', ''))) * 50 > char_length(t)",
    "markup": "(char_length(t) - char_length(translate(t, '#*$%&|<>', ''))) * 50 > char_length(t)",
    "prose": "true",
}
#: Raking steps between two looks at the residual, most looks, residual that will do.
STEPS, LOOKS, FIT = 8, 6, 1e-9
#: Bounded raking: sizes tried at once, closer together at the upper end, passes over the marginals, difference from the marginals (as a share of the sample) that will do.
SIZES, ROUNDS, CLOSE = 24, 32, 1e-5


@dataclass(frozen=True)
class Targets:
    """Weights for each dimension (they needn't add up to 1); other values fall into OTHER."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    #: The sample's tokens at most, as a share of those present.
    share: float = 0.9
    seed: str = "mix-1"
    topics: dict[str, str] = field(default_factory=lambda: dict(TOPICS))


#: The production mixture: the hot source held to its peers' level, English to one half.
PRODUCTION = Targets(
    source={"src0": 0.2, **{f"src{k}": 0.04 for k in range(1, 20)}, OTHER: 0.04},
    lang={"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15, OTHER: 0.01},
    topic={"prose": 0.85, "markup": 0.05, "records": 0.05, "loud": 0.05, OTHER: 0.01},
)


def _named(column: str, known: dict[str, float]) -> Column:
    return F.when(F.col(column).isin(list(known)), F.col(column)).otherwise(F.lit(OTHER))


def with_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """``docs`` with ``n_words``, ``_source``, ``_lang`` and ``topic``."""
    t = F.coalesce("text", F.lit(""))
    # Words begin where a character other than white space follows white space or the start.
    words = F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    cases = " ".join(f"when {re.sub(r'\bt\b', '_mix_t', c)} then '{k}'" for k, c in targets.topics.items())
    topic = F.expr(f"case when _mix_t = '' then 'other' {cases} else 'other' end")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    placed = docs.select(*own, t.alias("_mix_t"), words.alias("n_words"))
    placed = placed.select(*own, "n_words", _named("source", targets.source).alias("_source"), _named("lang", targets.lang).alias("_lang"), topic.alias("topic"))
    return placed.withColumn("topic", _named("topic", targets.topic))


def _target(dimension: str, weights: dict[str, float]) -> Column:
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(dimension)), F.lit(0.0))


def _raked(cells: DataFrame, targets: Targets) -> DataFrame:
    """One pass over the three marginals: each cell times target / present of its value."""
    for column, weights in (("_source", targets.source), ("_lang", targets.lang), ("topic", targets.topic)):
        cells = cells.select("_source", "_lang", "topic", "tokens", F.expr(f"sum(w) over (partition by {column})").alias("m"), "w", _target(column, weights).alias("g"))
        # Targets of values that are present, rescaled to add up to 1.
        cells = cells.withColumn("live", F.expr("sum(if(m > 0, g * w / m, 0d)) over ()")).withColumn("w", F.expr("if(m > 0 and live > 0, w * (g / live) / m, 0d)"))
        cells = cells.select("_source", "_lang", "topic", "tokens", "w")
    return cells


def _residual(cells: DataFrame, targets: Targets) -> float:
    """The largest difference between a marginal and its (rescaled) target."""
    worst = None
    for column, weights in (("_source", targets.source), ("_lang", targets.lang), ("topic", targets.topic)):
        marginal = cells.groupBy(column).agg(F.sum("w").alias("m")).where("m > 0").withColumn("g", _target(column, weights))
        one = marginal.select(F.expr("abs(m / sum(m) over () - g / sum(g) over ())").alias("d"))
        worst = one if worst is None else worst.union(one)
    return worst.agg(F.max("d")).first()[0] or 0.0


def fitted_cells(documents: DataFrame, targets: Targets) -> DataFrame:
    """(_source, _lang, topic, tokens, w): a row a cell that has documents, w raked to the targets."""
    counts = documents.groupBy("_source", "_lang", "topic").agg(F.sum("n_words").alias("tokens"))
    cells = written(counts.coalesce(1).select("_source", "_lang", "topic", "tokens", F.col("tokens").cast("double").alias("w")), "mix-cells")
    for _ in range(LOOKS):
        step = cells.coalesce(1)
        for _ in range(STEPS):
            step = _raked(step, targets)
        after = written(step, "mix-cells")
        discard(cells)
        cells = after
        if _residual(cells, targets) <= FIT:
            break
    return cells


#: Goals of a cell's three values, as the bounded raking carries them.
_GOALS = (("_source", "g_source"), ("_lang", "g_lang"), ("topic", "g_topic"))


def _sized(cells: DataFrame, targets: Targets) -> DataFrame:
    """Each cell SIZES times: a sample size, the shares of the cell's values, and x, the tokens wanted to begin with."""
    live = cells.coalesce(1).where("tokens > 0 and w > 0").withColumn("w", F.expr("w / sum(w) over ()"))
    for column, goal in _GOALS:
        live = live.withColumn(goal, F.expr(f"sum(w) over (partition by {column})")).withColumn(f"n{goal}", F.expr(f"sum(tokens) over (partition by {column})"))
    wanted = f"{targets.share!r}D * sum(tokens) over ()"
    room = ", ".join(f"min(n{g} / {g}) over ()" for _, g in _GOALS)  # no value can give more than all of its tokens
    live = live.withColumn("high", F.expr(f"least({wanted}, {room})")).withColumn("low", F.expr(f"least({wanted}, min(tokens / w) over ())"))
    sized = live.withColumn("k", F.explode(F.expr(f"sequence(0, {SIZES - 1})"))).withColumn("size", F.expr(f"high * pow(low / high, pow(k / {float(SIZES - 1)!r}D, 2d))"))
    return sized.select("k", "size", *(c for c, _ in _GOALS), "tokens", *(g for _, g in _GOALS), F.expr("size * w").alias("x"))


def _bounded(sized: DataFrame) -> DataFrame:
    """One pass over the three marginals of each sample: x is scaled so that least(x, tokens) adds up to the goal.

    Within a value, by falling x / tokens, the first rows that a factor lifts above their tokens hold just
    those; the factor is what the others need, and it is found where it lifts no further row above."""
    own = ["k", "size", *(c for c, _ in _GOALS), "tokens", *(g for _, g in _GOALS)]
    for column, goal in _GOALS:
        part = f"partition by k, {column}"
        order = f"{part} order by x / tokens desc, _source, _lang, topic"
        full = f"coalesce(sum(tokens) over ({order} rows between unbounded preceding and 1 preceding), 0)"
        rest = f"sum(x) over ({order} rows between current row and unbounded following)"
        sized = sized.selectExpr(*own, "x", f"(size * {goal} - {full}) / {rest} as f", f"row_number() over ({order}) as r")
        # No such row: all of them are full.
        found = f"coalesce(min(if(f * x <= tokens, struct(r, f), null)) over ({part}).f, max(tokens / x) over ({part}))"
        sized = sized.selectExpr(*own, f"x * greatest({found}, 1e-300d) as x")
    return sized


def calibrated_cells(cells: DataFrame, targets: Targets) -> DataFrame:
    """(_source, _lang, topic, tokens, probability): the largest sample that meets the marginals of ``cells``."""
    sized = written(_sized(cells, targets), "mix-sizes")
    for _ in range(ROUNDS // 4):
        step = sized.coalesce(1)
        for _ in range(4):
            step = _bounded(step)
        after = written(step, "mix-sizes")
        discard(sized)
        sized = after
    sized = sized.withColumn("x", F.expr("least(cast(tokens as double), x)"))
    off = ", ".join(f"abs(sum(x) over (partition by k, {c}) - size * {g}) / size" for c, g in _GOALS)
    best = sized.coalesce(1).withColumn("off", F.expr(f"greatest({off})")).withColumn("worst", F.expr("max(off) over (partition by k)"))
    best = best.withColumn("first", F.expr(f"min(if(worst <= {CLOSE!r}D or k = {SIZES - 1}, k, null)) over ()")).where("k = first")
    out = cells.coalesce(1).select("_source", "_lang", "topic", "tokens", "w").join(best.select("_source", "_lang", "topic", "x"), ["_source", "_lang", "topic"], "left")
    return out.select("_source", "_lang", "topic", "tokens", F.expr("if(x is null, 0d, round(x / tokens, 9))").alias("probability"))


def chance(seed: str) -> Column:
    """A number from [0, 1) by the md5 of seed, id and text."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _with_chances(placed: DataFrame, factors: DataFrame) -> DataFrame:
    """``placed`` with the probability of its cell and ``kept`` (u is there already)."""
    factors = written(factors, "mix-factors")
    factors = factors.select(*(F.col(c).alias(f"_f{k}") for k, c in enumerate(("_source", "_lang", "topic"))), "probability")
    on = (F.col("_source") == F.col("_f0")) & (F.col("_lang") == F.col("_f1")) & (F.col("topic") == F.col("_f2"))
    out = placed.join(F.broadcast(factors), on, "left").drop("_f0", "_f1", "_f2", "_source", "_lang")
    return out.withColumn("kept", F.col("u") < F.col("probability"))


def mixed_documents(docs: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """``docs`` with n_words, topic, probability, u and ``kept``."""
    placed = with_cells(docs, targets)
    # Only the cells' columns are needed to count; texts are read again for the result.
    fitted = fitted_cells(placed.select("n_words", "_source", "_lang", "topic"), targets)
    return _with_chances(placed.withColumn("u", chance(targets.seed)), calibrated_cells(fitted, targets))


def sample_mixture(docs: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """The sampled documents, with the columns of ``docs``."""
    packed = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_own"))
    return mixed_documents(packed, targets).where("kept").select("_own.*")


def mixture_report(docs: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """One row a document: its cell's calibrated probability, and whether that keeps it.

    Texts are read once; a table of a few columns stands for them afterwards.
    """
    placed = with_cells(docs.select("doc_id", "text", "source", "lang"), targets).withColumn("u", chance(targets.seed))
    placed = written(placed.select("doc_id", "n_words", "_source", "_lang", "topic", "u"), "mix-documents")
    fitted = fitted_cells(placed.select("n_words", "_source", "_lang", "topic"), targets)
    out = _with_chances(placed, calibrated_cells(fitted, targets))
    return out.select("doc_id", "n_words", "topic", "probability", "kept")


def marginals(docs: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """(dimension, value, target, present, expected, sampled): shares of tokens wanted, there, by probability and kept."""
    rows = mixed_documents(docs.withColumn("_s", _named("source", targets.source)).withColumn("_l", _named("lang", targets.lang)), targets)
    out = None
    for name, column, weights in (("source", "_s", targets.source), ("lang", "_l", targets.lang), ("topic", "topic", targets.topic)):
        one = rows.groupBy(F.col(column).alias("value")).agg(
            F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("probability")).alias("e"), F.sum(F.when(F.col("kept"), F.col("n_words")).otherwise(0)).alias("k")
        )
        one = one.select(F.lit(name).alias("dimension"), "value", _target("value", weights).alias("t"), "n", "e", "k")
        out = one if out is None else out.unionByName(one)
    share = lambda c: F.expr(f"try_divide({c}, sum({c}) over (partition by dimension))")
    wanted = F.expr("try_divide(if(n > 0, t, 0d), sum(if(n > 0, t, 0d)) over (partition by dimension))")
    return out.select("dimension", "value", wanted.alias("target"), share("n").alias("present"), share("e").alias("expected"), share("k").alias("sampled"))


def _values(weights: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in weights.items())


def oracle(targets: Targets = PRODUCTION, steps: int = STEPS * LOOKS) -> str:
    """The same in SQL for another engine: recursive raking over the cells."""
    dims = (("s", targets.source), ("l", targets.lang), ("p", targets.topic))
    known = lambda c, w: f"CASE WHEN {c} IN ({', '.join(repr(k) for k in w)}) THEN {c} ELSE 'other' END"
    topic = "CASE WHEN t = '' THEN 'other' " + " ".join(f"WHEN {c.replace('char_length', 'length')} THEN '{k}'" for k, c in targets.topics.items()) + " ELSE 'other' END"
    chain, last = [], "ipf"
    for d, _ in dims:
        chain.append(f"(SELECT * EXCLUDE (m, g, live), CASE WHEN m > 0 AND live > 0 THEN w * (g / live) / m ELSE 0 END AS w2 FROM (SELECT *, sum(CASE WHEN m > 0 THEN g * w / m ELSE 0 END) OVER () AS live FROM (SELECT i.*, sum(w) OVER (PARTITION BY i.{d}) AS m, coalesce(x.v, 0) AS g FROM {{}} i LEFT JOIN t{d} x ON x.k = i.{d})))")
    inner = "(SELECT * FROM ipf WHERE n < %d)" % steps
    for part in chain:
        inner = f"(SELECT n, s, l, p, tokens, w2 AS w FROM {part.format(inner)})"
    passes = "(SELECT * FROM bounded WHERE n < %d)" % ROUNDS
    for d, _ in dims:
        order = f"(PARTITION BY k, {d} ORDER BY x / tokens DESC, s, l, p"
        passes = f"""(SELECT * EXCLUDE (f, r, h) REPLACE (x * greatest(coalesce(h, max(tokens / x) OVER (PARTITION BY k, {d})), 1e-300) AS x) FROM (
          SELECT *, arg_min(f, r) FILTER (WHERE f * x <= tokens) OVER (PARTITION BY k, {d}) AS h FROM (
            SELECT *, row_number() OVER {order}) AS r,
              (size * g{d} - coalesce(sum(tokens) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(x) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM {passes})))"""
    tables = ", ".join(f"t{d}(k, v) AS (VALUES {_values(w)})" for d, w in dims)
    return f"""
WITH RECURSIVE {tables},
d AS (SELECT doc_id, coalesce(text, '') AS t, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_words FROM documents),
e AS (SELECT doc_id, t, n_words, {known('source', targets.source)} AS s, {known('lang', targets.lang)} AS l, {topic} AS p FROM d),
cells AS (SELECT s, l, p, sum(n_words)::BIGINT AS tokens FROM e GROUP BY s, l, p),
ipf AS (
  SELECT 0 AS n, s, l, p, tokens, tokens::DOUBLE AS w FROM cells
  UNION ALL
  SELECT n + 1, s, l, p, tokens, w FROM {inner}
),
f AS (SELECT s, l, p, tokens, w / sum(w) OVER () AS w FROM ipf WHERE n = {steps} AND tokens > 0 AND w > 0),
g AS (SELECT *, sum(w) OVER (PARTITION BY s) AS gs, sum(w) OVER (PARTITION BY l) AS gl, sum(w) OVER (PARTITION BY p) AS gp,
        sum(tokens) OVER (PARTITION BY s) AS ns, sum(tokens) OVER (PARTITION BY l) AS nl, sum(tokens) OVER (PARTITION BY p) AS np, {targets.share!r} * sum(tokens) OVER () AS wanted FROM f),
h AS (SELECT *, least(wanted, min(ns / gs) OVER (), min(nl / gl) OVER (), min(np / gp) OVER ()) AS high, least(wanted, min(tokens / w) OVER ()) AS low FROM g),
z AS (SELECT *, high * pow(low / high, pow(k / {float(SIZES - 1)!r}, 2)) AS size FROM h, range({SIZES}) AS r(k)),
bounded AS (
  SELECT 0 AS n, k, size, s, l, p, tokens, gs, gl, gp, size * w AS x FROM z
  UNION ALL
  SELECT n + 1, k, size, s, l, p, tokens, gs, gl, gp, x FROM {passes}
),
capped AS (SELECT * REPLACE (least(tokens::DOUBLE, x) AS x) FROM bounded WHERE n = {ROUNDS}),
o AS (SELECT *, greatest(abs(sum(x) OVER (PARTITION BY k, s) - size * gs), abs(sum(x) OVER (PARTITION BY k, l) - size * gl), abs(sum(x) OVER (PARTITION BY k, p) - size * gp)) / size AS off FROM capped),
q AS (SELECT min(k) AS k FROM (SELECT k FROM o GROUP BY k HAVING max(off) <= {CLOSE!r} OR k = {SIZES - 1})),
c AS (SELECT cells.s, cells.l, cells.p, coalesce(round(o.x / o.tokens, 9), 0) AS probability FROM cells LEFT JOIN (SELECT o.* FROM o JOIN q USING (k)) o ON o.s = cells.s AND o.l = cells.l AND o.p = cells.p)
SELECT e.doc_id, n_words::BIGINT AS n_words, e.p AS topic, probability,
       ('0x' || substr(md5('{targets.seed}|' || coalesce(e.doc_id::VARCHAR, '') || '|' || md5(t)), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < probability AS kept
FROM e JOIN c ON c.s = e.s AND c.l = e.l AND c.p = e.p
"""
