import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join as J
from tessera.llm import shared


def brute(rows):
    """(links, group) of each row by all pairs that share a shingle."""
    sets = []
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        k = min(5, len(ws))
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set())
    at = defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            at[g].append(n)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, s in enumerate(sets):
        for m, c in Counter(m for g in s for m in at[g] if m > n).items():
            if 5 * c >= 4 * (len(s) + len(sets[m]) - c):
                links[n] += 1
                links[m] += 1
                parent[max(find(n), find(m))] = min(find(n), find(m))
    groups = defaultdict(list)
    for n in range(len(rows)):
        groups[find(n)].append(n)
    first = {n: min((rows[m].doc_id for m in g if rows[m].doc_id is not None), default=None) for g in groups.values() for n in g}
    return [(rows[n].doc_id, first[n], links[n]) for n in range(len(rows))], groups


def check(frame):
    rows = frame.collect()
    want, groups = brute(rows)
    got = [(r.doc_id, r.class_id, r.n_links) for r in J.ngram_join(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = J.drop_near_copies(frame).collect()
    wordless = sum(1 for r in rows if not (r.text or "").strip(" \t\n\x0b\f\r"))
    assert len(kept) == len(groups)
    assert {r.text for r in kept if r.text} <= {r.text for r in rows}
    assert wordless == sum(1 for r in kept if not (r.text or "").strip(" \t\n\x0b\f\r"))


def test_against_all_pairs(docs):
    check(docs)


def test_odd(odd):
    check(odd)
    assert J.drop_near_copies(odd).columns == odd.columns


def test_empty(none):
    assert J.ngram_join(none).collect() == [] and J.drop_near_copies(none).collect() == []


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 4)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for n in range(30):
        own = list(base)
        own[(n * 37) % 120] = f"changed{n}"
        rows.append((n, " ".join(own)))
    check(spark.createDataFrame([*rows, (99, "quite another text of some words")], "doc_id long, text string"))


def test_prefix_is_shortened_until_the_recall_is_met():
    found = lambda s, d: 1 - (1 - s**d) ** J.TREES
    close = [(0.99, 1e6)]
    assert J.shortened(close)[0] == J.DEPTH
    # Links at the threshold need a prefix that a link there shares often enough, and no shorter one.
    depth, recall = J.shortened([(0.8, 1e6)])
    assert J.TOP < depth < J.DEPTH and recall >= J.RECALL > found(0.8, depth + 1)
    depths = [J.shortened([(0.99, 1e6), (0.8, n)])[0] for n in (1, 1e3, 1e5, 1e7)]
    assert depths == sorted(depths, reverse=True) and len(set(depths)) > 1
    assert J.shortened([], recall=1.0)[0] == J.TOP


def test_descent_follows_the_data(spark, monkeypatch):
    """Nearly equal texts need only long prefixes; those at the threshold shorter ones; all links are found."""
    def near(changed):
        rows = []
        for g in range(60):
            words = [f"g{g}w{k}" for k in range(400)]
            other = list(words)
            for k in range(changed):
                other[20 + 36 * k] = f"new{g}x{k}"
            rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        return spark.createDataFrame(rows, "doc_id long, text string")

    depths = []
    told = J.descent
    monkeypatch.setattr(J, "descent", lambda *a, **k: depths.append(told(*a, **k)) or depths[-1])
    for changed in (1, 8):
        check(near(changed))
    # check() runs the forest twice each.
    assert depths[0][0] > depths[2][0] and all(r >= J.RECALL for _, r in depths)


def test_no_link_is_left_for_the_average(spark):
    """Among many links of nearly equal texts, one at the threshold that shares no long prefix is found too."""
    def texts(t):
        words = [f"t{t}w{k}" for k in range(64)]
        return " ".join(words), " ".join(words[:52])  # 48 of 60 shingles: 0.8

    def longest(a, b):
        x, y = (J.signature(x, J.TREES * J.DEPTH).reshape(J.TREES, J.DEPTH) for x in J.shingle_sets(pa.array([a, b])))
        return int((x == y).cumprod(axis=1).sum(axis=1).max())

    rare = next(x for x in map(texts, range(20_000)) if J.TOP < longest(*x) < J.DEPTH - 1)
    rows = [(0, rare[0]), (1, rare[1])]
    for g in range(1000):
        words = [f"g{g}w{k}" for k in range(60)]
        rows += [(2 * g + 2, " ".join(words)), (2 * g + 3, " ".join([*words, "more"]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: (n - n % 2, 1) for n in range(2002)}


def test_links_of_both_lengths_are_counted_once(spark, monkeypatch):
    """Groups whose pairs meet in nodes of both lengths, and one of several blocks, put off to the shorter one."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    told, seen = J.descent, []

    def descent(found, *a, **k):
        seen.append(sum(r.n for r in found.where("s is not null").collect()))
        return told(found, *a, **k)

    monkeypatch.setattr(J, "descent", descent)
    rng, rows = np.random.default_rng(4), []
    for n in range(50):
        own = [f"v{k} {max(0, n - 25) // 5}" for k in range(150)]
        for at in rng.integers(0, 150, size=n % 4):
            own[at] = f"changed{n}x{at}"
        rows.append((n, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame)
    assert 0 < seen[0] == seen[1] <= sum(r.n_links for r in J.ngram_join(frame).collect()) // 2


def test_texts_of_no_group_are_not_shuffled(spark):
    """Where nothing is small enough for Spark to broadcast, only texts with near copies go through a shuffle."""
    rng = np.random.default_rng(6)
    rows = [(n, " ".join(f"{x:08x}" for x in rng.integers(0, 1 << 32, size=4000))) for n in range(150)]
    rows += [(1000 + n, text + " more") for n, text in rows[:5]] + [rows[7]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(executors().apply(k).totalShuffleWrite() for k in range(executors().size()))

    most, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = J.drop_near_copies(frame).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sorted((r.doc_id, r.text) for r in kept) == rows[:150]
    assert 0 < shuffled() - before < 0.5 * sum(len(text) for _, text in rows)


def test_sieve_only_spares_work(spark, odd, monkeypatch):
    """A sieve lets all of its keys pass and few others; one that lets everything pass changes no result."""
    keyed = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("text")).withColumns(shared.row_key())
    keys = keyed.where("doc_id % 4 = 1").select(*shared.ROW_KEY)
    passed = [r.doc_id for r in shared.sifted(keyed, keys).where("_may").collect()]
    assert len(passed) == len(set(passed)) < 7_000 and {n for n in range(20_000) if n % 4 == 1} <= set(passed)
    assert shared.sifted(keyed, keys.limit(0)).where("not _may").count() == 20_000
    monkeypatch.setattr(shared, "SIEVE_MOST", 1)
    assert shared.sifted(keyed, keys).where("_may").count() == 20_000
    check(odd)


def test_whole_table_loses_no_link():
    lost = lambda n, d: n * (1 - 0.8**d) ** J.TREES
    depth, _ = J.shortened([], together=True)
    assert lost(1, depth) <= 1 - J.RECALL < lost(1, depth + 1)
    # However many closer links there are, those at the threshold count by themselves.
    assert J.shortened([(0.99, 1e9)], together=True)[0] == depth
    assert J.shortened([(0.8, 1e3)], together=True)[0] == J.TOP


def test_tries_share_prefixes():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, size=400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:380], rng.integers(0, 1 << 63, size=20).astype(np.uint64)]))
    values = [J.signature(x, J.TREES * J.DEPTH).reshape(J.TREES, J.DEPTH) for x in (a, b)]
    keys = [J.tree_keys(x) for x in (a, b)]
    for t in range(J.TREES):
        common = int((values[0][t] == values[1][t]).cumprod().sum())
        assert (keys[0][0][t] == keys[1][0][t]) == (common >= J.TOP)
        for d in range(J.TOP + 1, J.DEPTH + 1):
            shift = np.uint64(16 * (J.DEPTH - d))
            same = keys[0][0][t] == keys[1][0][t] and keys[0][1][t] >> shift == keys[1][1][t] >> shift
            assert same == (common >= d)


def test_roots_and_shared_values():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, size=rng.integers(0, 5))) for _ in range(30)]
    got = J.shares_one(sets)
    assert all(got[a, b] == bool(set(sets[a].tolist()) & set(sets[b].tolist())) for a in range(30) for b in range(30) if a != b)
    chain = np.zeros((9, 9), dtype=bool)
    for a, b in ((8, 0), (0, 5), (5, 2), (3, 4)):
        chain[a, b] = chain[b, a] = True
    assert J.linked_roots(chain).tolist() == [0, 1, 0, 3, 3, 0, 6, 7, 0]


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(1, 50)).astype(np.uint64)) for _ in range(12)]
    got = J.intersections(sets)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(12) for b in range(12))


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4)], [(k, k + 1) for k in range(1, 12)], [(9, k) for k in range(1, 9)]])
def test_components(spark, edges):
    key = lambda x: bytes([x])
    got = {r.v[0]: r.root[0] for r in J.components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
