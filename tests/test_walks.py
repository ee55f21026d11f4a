"""Walks over links and parents: no end before the last link or row."""

from tessera.operators import lineage, store


def test_closure_follows_links_to_their_end(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(40, 38), (3, 7)], "cid long, target long")
    got = {(r.root, r.cid): r.depth for r in store.closure(spark.createDataFrame([(0,), (39,)], "root long"), links).collect()}
    want = {(0, k): k if k < 7 else k - 3 for k in range(41)} | {(39, 39): 0, (39, 40): 1, (39, 38): 2}
    # 4 to 6 are reached one by one, 7 by the short cut.
    assert got == want
    few = store.closure(spark.createDataFrame([(0,)], "root long"), links, 2).collect()
    assert sorted((r.cid, r.depth) for r in few) == [(0, 0), (1, 1), (2, 2)]


def brute(rows, fits):
    up = dict(rows)
    out = {}
    for start in up:
        chain, at, seen = [], start, set()
        while at is not None and at not in seen:
            seen.add(at)
            chain.append(at)
            at = up.get(at)
        out[start] = (chain, [x for x in chain if x in fits])
    return out


def test_doubling_against_plain_walks(spark):
    """Forks, a long chain, parents that aren't there, a cycle without a fit."""
    rows = [(k, k // 3 if k else None) for k in range(200)] + [(1000 + k, 1000 + k - 1 if k else 199) for k in range(300)]
    rows += [(5000, 4999), (5001, 5000), (6000, 6001), (6001, 6000)]
    fits = {k for k, _ in rows if k % 4 == 1 and k < 5000}
    want = brute(rows, fits)
    revisions = spark.createDataFrame(rows, "id long, parent_id long")
    fit = revisions.where("id % 4 = 1 and id < 5000").select("id")
    got = {r.start: (r.id, r.depth) for r in lineage.nearest(revisions, fit).collect()}
    assert got == {s: (f[0], chain.index(f[0])) for s, (chain, f) in want.items() if f}
    proper = {s: [x for x in f if x != s] for s, (_, f) in want.items()}
    assert {r.start: r.n for r in lineage.counted(revisions, fit).collect()} == {s: len(f) for s, f in proper.items() if f}
    starts = revisions.select(revisions.id.alias("start"))
    for n in (1, 2, 7):
        assert {r.start: r.id for r in lineage.nth(revisions, starts, fit, n).collect()} == {s: f[n - 1] for s, f in proper.items() if len(f) >= n}
    some = revisions.where("id < 200").select(revisions.id.alias("start"))
    walked = lineage.ancestors(revisions, some, until=fit).collect()
    cut = lambda s: next((k + 1 for k, x in enumerate(want[s][0]) if k and x in fits), None)
    assert sorted((r.start, r.id, r.depth) for r in walked) == sorted((s, x, d) for s in range(200) for d, x in enumerate(want[s][0][: cut(s)]))


def test_five_million_walks(spark):
    """No limit of rows: every one of many chains is walked from every place."""
    revisions = spark.range(5_000_000).selectExpr("id", "if(id < 500000, null, id - 500000) as parent_id")
    found = lineage.nearest(revisions, revisions.where("id < 250000"))
    assert found.count() == 2_500_000 and found.where("depth = 9").count() == 250_000


def test_ancestors_of_more_than_a_million_rows(spark):
    revisions = spark.range(60_000 * 20).selectExpr("id", "if(id < 60000, null, id - 60000) as parent_id")
    starts = spark.range(60_000 * 19, 60_000 * 20).selectExpr("id as start")
    assert lineage.ancestors(revisions, starts).count() == 60_000 * 20
