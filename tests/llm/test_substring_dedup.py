import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import substring_dedup as S


def brute(rows, window=S.WINDOW):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    counts = Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for r, ws in zip(rows, texts):
        gone = set()
        for i in range(len(ws) - window + 1):
            if counts[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((r.doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(frame):
    return sorted((tuple(r) for r in S.substring_digest(frame).collect()), key=str)


def test_against_brute_force(docs):
    want = brute(docs.collect())
    assert digest(docs) == want and any(r[2] for r in want)


def test_odd(odd, none):
    assert digest(odd) == brute(odd.collect())
    assert digest(none) == []
    out = S.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all(r.text is None or r.doc_id != 6 or r.text == "" for r in out.collect())


def test_inside_one_text_and_at_the_edges(spark):
    a, b = [f"a{k}" for k in range(35)], [f"b{k}" for k in range(34)]
    rows = [(1, " ".join([*a, "x", *a])), (2, " ".join(b)), (3, " ".join([*b, "y"])), (4, " ".join(["z", *a[:34]])), (5, " ".join(["q"] * 37))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = digest(frame)
    assert got == brute(frame.collect()) and [r[2] for r in got] == [70, 0, 0, 0, 37]


@given(st.lists(st.integers(0, 3), min_size=0, max_size=80), st.integers(2, 9))
def test_rolling_hash_and_anchors(values, size):
    words = S.mixed(np.array(values, dtype=np.uint64) + np.uint64(1))
    hashes = S.rolling(words, size)
    pieces = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(set(pieces)) == len(set(hashes.tolist())) and len(hashes) == len(pieces)
    window, gram = size + 7, size
    if len(values) >= window:
        found, at = S.anchors(words, window, gram)
        assert at.tolist() == [i + int(np.argmin(found[i : i + window - gram + 1])) for i in range(len(values) - window + 1)]


def test_intervals():
    assert S.removal_intervals(np.array([5, 0, 1, 100]), 35) == [(0, 40), (100, 135)]
    assert S.removal_intervals(np.array([0, 35]), 35) == [(0, 70)] and S.removal_intervals(np.array([], dtype=int)) == []
