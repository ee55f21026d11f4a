import re
from collections import Counter

import pytest

from tessera.llm import quality_rules as Q


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    repeated = {k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def check(frame, labels):
    got = Q.quality_rules(frame, labels).collect()
    want = Counter((r.doc_id, *brute(r.text)) for r in frame.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    return got


def test_statistics(docs, labels):
    check(docs, labels)


def test_odd(odd, none, labels):
    check(odd, labels)
    assert Q.quality_rules(none, labels).collect() == []
    out = Q.apply_rules(odd, Q.DecisionList(()))
    assert out.count() == odd.count() and {"doc_id", "text", "topic", "fp"} <= set(out.columns)
    assert Q.learned_rules(odd, labels.limit(0)).rules == ()


def test_long_and_repetitive(spark, labels):
    texts = ["a b c " * 4000, "x " * 9000, "a b a b a", "p q r s p q r", "\n".join(["same line here"] * 5 + ["", " ", "other"]), "#*$%&|<>" * 3]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels)


@pytest.fixture(scope="module")
def larger(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_learned_list_rejects_bad_and_keeps_good(larger):
    docs, labels = larger
    rules = Q.learned_rules(docs, labels)
    assert rules.rules and all(r.precision >= Q.MIN_PRECISION for r in rules.rules)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in Q.apply_rules(docs, rules).collect() if r.doc_id in known and not r.base_failed]
    good, bad = [r for r in rows if known[r.doc_id]], [r for r in rows if not known[r.doc_id]]
    assert sum(r.kept for r in good) / len(good) >= 0.97 and sum(not r.kept for r in bad) / len(bad) >= 0.8
    assert all(r.kept == (r.rule is None) for r in rows)


def test_a_conjunction_is_found(spark):
    """Bad where two conditions hold at once; ties and pruning leave a precise rule."""
    rows = [(k, 100, 500, (k % 10) * 20, 0, 0, 10, 0, 0, (k // 10 % 10) * 50, int(not (k % 10 >= 5 and k // 10 % 10 >= 5))) for k in range(600)]
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, n_digits long, quality int"
    rules = Q.learn(spark.createDataFrame(rows, names))
    assert rules.rules[0].precision == 1.0 and {x.feature for x in rules.rules[0].literals} == {"symbols_per_word", "digit_share"}
