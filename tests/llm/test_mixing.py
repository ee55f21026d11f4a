from collections import Counter, defaultdict

import pytest

from tessera.llm import mixing as M
from tools.compare import compare


def test_oracle(spark, sf_dir):
    from tessera.llm import queries

    assert compare(spark, "op4_mixing", queries.op4_mixing, M.oracle(), sf_dir) == ""


def test_marginals_fit(spark):
    """Every cell has documents, so all targets can be met."""
    text = {"loud": "WORDS IN CAPITALS ", "prose": "some plain words "}
    rows = [(n, text[t] * (1 + n % 7), lang, source) for n, (source, lang, t) in enumerate((s, x, t) for s in "abc" for x in ("en", "de") for t in text for _ in range(9))]
    targets = M.Targets(source={"a": 5.0, "b": 3.0, "c": 2.0}, lang={"en": 0.7, "de": 0.3}, topic={"loud": 0.25, "prose": 0.75})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = M.fitted_cells(M.with_cells(docs, targets), targets).collect()
    for column, target in (("_source", targets.source), ("_lang", targets.lang), ("topic", targets.topic)):
        got = defaultdict(float)
        for r in cells:
            got[r[column]] += r.w
        assert got == pytest.approx({k: v / sum(target.values()) for k, v in target.items()}, abs=1e-8)


def test_sampled_share_follows_probability(docs):
    rows = M.mixed_documents(docs).collect()
    assert all(r.kept == (r.u < r.probability) for r in rows)
    kept, want = sum(r.kept for r in rows), sum(r.probability for r in rows)
    assert abs(kept - want) < 5 * len(rows) ** 0.5


def test_odd(odd, none):
    kept = M.sample_mixture(odd)
    assert kept.columns == odd.columns
    assert not Counter(map(str, kept.collect())) - Counter(map(str, odd.collect()))
    report = M.mixture_report(odd).collect()
    assert len(report) == odd.count() and {r.topic for r in report if r.n_words == 0} <= {"other", "prose"}
    assert M.sample_mixture(none).collect() == []


def test_unmet_targets(spark):
    docs = spark.createDataFrame([(k, "a b c", "en", "s") for k in range(50)], "doc_id long, text string, lang string, source string")
    targets = M.Targets(source={"s": 0.5, "gone": 0.5}, lang={"en": 1.0}, topic={"prose": 1.0}, share=1.0)
    assert {r.probability for r in M.mixture_report(docs, targets).collect()} == {1.0}


def test_kept_tokens_meet_the_marginals(spark):
    """Thin cells whose share of the targets is many times their tokens: cut off at 1, they would miss them."""
    text = {"loud": "WORDS IN CAPITALS ", "prose": "some plain words "}
    cells = [(s, x, t) for s in "ab" for x in ("en", "de") for t in text]
    thin = lambda s, x, t: 1500 if (s, x, t) == ("a", "en", "prose") else 150
    rows = [(n * 10_000 + k, text[c[2]], c[1], c[0]) for n, c in enumerate(cells) for k in range(thin(*c))]
    targets = M.Targets(source={"a": 0.3, "b": 0.7}, lang={"en": 0.5, "de": 0.5}, topic={"loud": 0.4, "prose": 0.6})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = M.mixed_documents(docs, targets).collect()
    kept = [r for r in got if r.kept]
    for value, target in ((lambda r: r["source"], targets.source), (lambda r: r["lang"], targets.lang), (lambda r: r["topic"], targets.topic)):
        for rows, weight, within in ((got, lambda r: r.probability, 1e-5), (kept, lambda r: 1, 0.04)):
            held = defaultdict(float)
            for r in rows:
                held[value(r)] += r.n_words * weight(r)
            assert {k: v / sum(held.values()) for k, v in held.items()} == pytest.approx(target, abs=within)
    # All of source b can be kept: 600 documents are 0.7 of the sample.
    assert sum(r.probability for r in got) == pytest.approx(600 / 0.7, rel=0.01)
