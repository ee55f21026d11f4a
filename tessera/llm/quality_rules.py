"""Operator 10, quality rules [native]: learned decision lists over text statistics.

Sequential covering learns an ordered list of threshold conjunctions that predict
``quality = 0``; the list becomes one Spark conditional expression.  Every step is a
DataFrame or SQL expression; the driver only compares candidate thresholds, whose
number is (statistics x bins), never rows.

Defined results
---------------
* null or empty text: no words, all statistics 0, ``base_failed`` true, ``kept`` false;
* no labelled rows: an empty list, so the verdict is that of the base rule;
* repeated rows are judged one by one; of equal candidates the first in the order of FEATURES is
  taken, of one statistic that of the smaller threshold, "at most" before "above";
* extra columns of ``docs`` are carried along by :func:`apply_rules`.  The statistics'
  names are reserved: a clashing column of ``docs`` is replaced by the statistic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, written

#: At most so many labelled rows are learned from (those with the smallest md5 of the id).
MAX_LABELLED = 20_000
MIN_WORDS = 50
BINS = 24
MAX_RULES = 8
MAX_LITERALS = 3
MIN_COVERED = 8
MIN_PRECISION = 0.9

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that rules may test, as SQL over STATS; all are scale-free but the first two.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1L)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1L)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1L)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1L)",
    "n_lines": "cast(n_lines as double)",
    "upper_share": "n_upper / greatest(word_chars, 1L)",
    "marks_per_word": "n_marks / greatest(n_words, 1L)",
    "digit_share": "n_digits / greatest(word_chars, 1L)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1L)",
}
_SPACE = r"[ \t\n\x0B\f\r]+"


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics of ``text`` (STATS and the inputs of FEATURES).

    Repeated three-word windows are found inside one row: each window becomes one long,
    its hash above and its position below, the longs are sorted as primitives, and
    neighbours of equal hash are compared word by word.  No shuffle, O(n log n) a text.
    """
    own = [c for c in docs.columns if c not in {*STATS, "n_lines", "n_upper", "n_marks", "n_digits"}]
    keep = [F.col(f"`{c}`") for c in own]
    t = f"coalesce(`{text}`, '')"
    spaces = r"' \t\n\u000B\u000C\r'"
    one = docs.select(
        *keep,
        F.expr(f"filter(split({t}, '{_SPACE.replace(chr(92), chr(92) * 2)}'), w -> w <> '')").alias("_ws"),
        F.expr(rf"filter(split({t}, '\n'), l -> btrim(l, {spaces}) <> '')").alias("_ls"),
        F.expr(f"cast(char_length(translate({t}, {spaces}, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(char_length({t}) - char_length(translate({t}, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr(f"cast(char_length({t}) - char_length(translate({t}, '.,;:!?', '')) as bigint)").alias("n_marks"),
        F.expr(f"cast(char_length({t}) - char_length(translate({t}, '0123456789', '')) as bigint)").alias("n_digits"),
        F.expr(f"cast(char_length({t}) - char_length(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint)").alias("n_upper"),
    )
    early = [*keep, *(F.col(c) for c in ("word_chars", "n_symbols", "n_marks", "n_digits", "n_upper"))]
    two = one.select(
        *early,
        "_ws",
        F.expr("cast(size(_ws) as bigint)").alias("n_words"),
        F.expr("cast(size(_ls) as bigint)").alias("n_lines"),
        F.expr("cast(size(_ls) - size(array_distinct(_ls)) as bigint)").alias("n_dup_lines"),
        F.expr("length(bin(size(_ws)))").alias("_bits"),
    )
    counted = [*early, *(F.col(c) for c in ("n_words", "n_lines", "n_dup_lines"))]
    three = two.select(
        *counted,
        "_ws",
        "_bits",
        F.expr(
            "sort_array(transform(if(size(_ws) < 3, cast(array() as array<int>), sequence(0, size(_ws) - 3)),"
            " i -> shiftleft(xxhash64(_ws[i], _ws[i + 1], _ws[i + 2]), _bits) | cast(i as bigint)))"
        ).alias("_s"),
        F.expr("shiftleft(1L, _bits) - 1L").alias("_mask"),
    )

    def same(a: str, b: str) -> str:
        at = lambda x, k: f"get(_ws, cast({x} & _mask as int) + {k})"
        words = " and ".join(f"{at(a, k)} = {at(b, k)}" for k in range(3))
        return f"(shiftright({a}, _bits) = shiftright({b}, _bits) and {words})"

    four = three.select(
        *counted,
        F.expr(
            "sort_array(transform(filter(_s, (x, j) -> coalesce("
            f"{same('x', 'get(_s, j - 1)')}, false) or coalesce({same('x', 'get(_s, j + 1)')}, false)), x -> x & _mask))"
        ).alias("_p"),
    )
    # A generator: filters on the statistics stay above it, so none of the arrays is computed twice.
    found = "aggregate(transform(_p, (x, k) -> least(3L, coalesce(get(_p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)"
    names = ("word_chars", "n_symbols", "n_marks", "n_digits", "n_upper", "n_words", "n_lines", "n_dup_lines")
    fields = ", ".join(f"'{c}', {c}" for c in names)
    return four.select(*keep, F.expr(f"inline(array(named_struct({fields}, 'n_repeat_words', {found})))"))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " and ".join(f"({x.sql()})" for x in self.literals)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; what no rule covers is kept."""

    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """True where the text is kept, as one ordered conditional expression."""
        if not self.rules:
            return F.lit(True)
        out = F.when(F.expr(self.rules[0].sql()), F.lit(False))
        for rule in self.rules[1:]:
            out = out.when(F.expr(rule.sql()), F.lit(False))
        return out.otherwise(F.lit(True))

    def rule_number(self) -> Column:
        """1-based number of the first rule that covers a row; null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(F.expr(rule.sql()), F.lit(k)).otherwise(out)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` labelled documents (bound: the rows whose md5 of the id sorts first)."""
    some = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .distinct()
        .orderBy(F.md5(F.col("doc_id").cast("string")), "quality")
        .limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bounded: texts aren't shuffled


def _thresholds(sample: DataFrame) -> dict[str, list[float]]:
    marks = [k / BINS for k in range(1, BINS)]
    row = sample.agg(*(F.expr(f"percentile_approx({sql}, array({', '.join(map(str, marks))}), 10000)").alias(name) for name, sql in FEATURES.items())).first()
    return {name: sorted(set(row[name] or [])) for name in FEATURES}


def binned(sample: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(quality, _grow, b<k> for each statistic): b<k> is the number of cuts below the statistic."""
    out = [F.col("quality"), F.expr("pmod(xxhash64(doc_id, 7), 3) < 2").alias("_grow")]
    for k, (name, sql) in enumerate(FEATURES.items()):
        marks = [f"if({sql} > {x!r}D, 1, 0)" for x in cuts[name]]
        out.append(F.expr(" + ".join(marks) or "0").alias(f"b{k}"))
    return sample.select(*out)


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """For each statistic and bin, the rows of quality 0 and 1: one pass, one small result."""
    names = list(FEATURES)
    cells = F.posexplode(F.array(*(F.col(f"b{k}") for k in range(len(names)))))
    found = rows.select("quality", cells.alias("feature", "bin")).groupBy("feature", "bin")
    out = {name: [(0, 0)] * (len(cuts[name]) + 1) for name in names}
    for r in found.agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).collect():
        out[names[r["feature"]]][r["bin"]] = (int(r["bad"]), int(r["good"]))
    return out


def _candidates(counts: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]]):
    """(literal, the same on bins, rows of quality 0 and of quality 1 that it covers)."""
    for number, name in enumerate(FEATURES):
        below_bad = below_good = 0
        all_bad, all_good = (sum(x[k] for x in counts[name]) for k in (0, 1))
        for k, cut in enumerate(cuts[name]):
            below_bad += counts[name][k][0]
            below_good += counts[name][k][1]
            yield (Literal(name, False, cut), f"b{number} <= {k}"), below_bad, below_good
            yield (Literal(name, True, cut), f"b{number} > {k}"), all_bad - below_bad, all_good - below_good


def _score(bad: int, good: int) -> float:
    return (bad + 1.0) / (bad + good + 2.0)


def learn(sample: DataFrame) -> DecisionList:
    """Sequential covering over a bounded table with STATS and ``quality``.

    Two thirds of the rows grow a rule, one literal at a time by information gain; the
    rest prunes it from the end while its precision does not fall.  A rule is accepted
    when its pruned form covers enough rows at ``MIN_PRECISION``; the rows it covers
    leave the table and the next rule is grown on what remains.
    """
    cuts = _thresholds(sample)
    rules: list[Rule] = []
    rest = table = written(binned(sample, cuts), "quality-bins")
    while len(rules) < MAX_RULES:
        grow, chosen = rest.where("_grow"), []
        while len(chosen) < MAX_LITERALS:
            counts = _counts(grow, cuts)
            some = next(iter(counts.values()))
            bad, good = sum(x[0] for x in some), sum(x[1] for x in some)
            if not bad or not good:
                break
            base = math.log2(bad / (bad + good))
            best = max(
                ((b * (math.log2(b / (b + g)) - base), x) for x, b, g in _candidates(counts, cuts) if b >= MIN_COVERED),
                key=lambda x: x[0],
                default=(0.0, None),
            )
            if best[1] is None or best[0] <= 1e-9:
                break
            chosen.append(best[1])
            grow = grow.where(best[1][1])
        if not chosen:
            break
        checks = [" and ".join(x[1] for x in chosen[:k]) for k in range(1, len(chosen) + 1)]
        found = rest.agg(
            *(F.sum(F.expr(f"if({c} and not _grow and quality = {q}, 1, 0)")).alias(f"p{q}{k}") for k, c in enumerate(checks) for q in (0, 1)),
            *(F.sum(F.expr(f"if({c} and quality = {q}, 1, 0)")).alias(f"a{q}{k}") for k, c in enumerate(checks) for q in (0, 1)),
        ).first()
        at = len(chosen) - 1
        while at and _score(found[f"p0{at - 1}"] or 0, found[f"p1{at - 1}"] or 0) >= _score(found[f"p0{at}"] or 0, found[f"p1{at}"] or 0):
            at -= 1
        bad, good = found[f"a0{at}"] or 0, found[f"a1{at}"] or 0
        if bad < MIN_COVERED or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(Rule(tuple(x[0] for x in chosen[: at + 1]), bad / (bad + good), bad + good))
        rest = rest.where(f"not ({checks[at]})")
    discard(table)
    return DecisionList(tuple(rules))


def learned_rules(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DecisionList:
    """The decision list learned from the labelled rows that pass the base rule."""
    stats = written(text_statistics(labelled_sample(docs, labels, limit)).drop("text").where(~base_failed()), "quality-sample")
    try:
        return learn(stats)
    finally:
        discard(stats)


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with STATS, ``base_failed``, ``kept`` and the number of the rule that rejected."""
    out = text_statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.verdict()).withColumn("rule", rules.rule_number())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: statistics, base verdict, final verdict."""
    out = apply_rules(docs.select("doc_id", "text"), learned_rules(docs, labels))
    return out.select("doc_id", *STATS, "base_failed", "kept", "rule")
