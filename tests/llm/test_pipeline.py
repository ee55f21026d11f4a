"""The pipeline beside a plain-Python version of its deterministic stages."""

import inspect

import corpus_pipeline as P
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_ngram_join import brute as groups_of
from tests.llm.test_quality_rules import brute as statistics


def test_stages_and_contract():
    assert [name for name, _ in P.STAGES] == ["quality_rules", "ngram_join", "decontamination", "mixing", "token_output"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES) and P.ORACLE_SQL is None


def test_each_stage_against_brute_force(spark, sf_dir, benchmark_items, labels):
    from tessera.llm import mixing
    from tessera.llm.quality_rules import learned_rules
    from tessera.llm.shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda rows: sorted((r.doc_id, r.text) for r in rows)
    rows = docs.collect()

    kept = written(P.quality_stage(spark, docs, sf_dir), "t")
    assert kept.columns == docs.columns
    rules = learned_rules(docs, labels).rules
    stats = {r.doc_id: statistics(r.text) for r in rows}
    passing = [r for r in rows if stats[r.doc_id][0] >= 50 and 2 * stats[r.doc_id][4] <= stats[r.doc_id][0]]
    assert set(key(kept.collect())) <= set(key(passing)) and (rules or key(kept.collect()) == key(passing))

    rows = kept.collect()
    _, groups = groups_of(rows)
    unique = written(P.near_copy_stage(spark, kept, sf_dir), "t")
    assert unique.columns == docs.columns
    assert key(unique.collect()) == key(min((rows[n] for n in g), key=lambda r: r.doc_id) for g in groups.values())

    rows = unique.collect()
    bad = {r[0] for r in contaminated(rows, benchmark_items.collect()) if r[5]}
    clean = written(P.decontamination_stage(spark, unique, sf_dir), "t")
    assert key(clean.collect()) == key(r for r in rows if r.doc_id not in bad)

    sampled = written(P.mixing_stage(spark, clean, sf_dir), "t")
    fate = {r.doc_id: r.kept for r in mixing.mixture_report(clean).collect()}
    assert key(sampled.collect()) == key(r for r in clean.collect() if fate[r.doc_id])

    out = P.token_stage(spark, sampled, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in sampled.collect())
    assert sorted(r.start for r in out)[0] == 0


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_every_stage_takes_odd_rows(spark, sf_dir, odd):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        assert {str(r) for r in out.collect()} <= {str(r) for r in odd.collect()}, name
    assert P.STAGES[-1][1](spark, odd, sf_dir).count() == odd.count()
