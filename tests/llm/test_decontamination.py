import hashlib
import re

from tessera.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for r in items:
        ws = words(r.text)
        k = min(13, len(ws))
        for i in range(len(ws) - k + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + k]), set()).add("null" if r.item_id is None else str(r.item_id))
    out = []
    for r in docs:
        ws, hit, found = words(r.text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                if (ids := windows.get(tuple(ws[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= ids
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")]
        spans = ",".join(f"{at[i][0]}-{at[next(j for j in range(i, len(ws)) if j + 1 not in hit)][1]}" for i in sorted(hit) if i - 1 not in hit)
        out.append((r.doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws), spans))
    return sorted(out, key=str)


def report(docs, items):
    return sorted((tuple(r) for r in D.benchmark_report(docs, items).collect()), key=str)


def test_against_brute_force(docs, benchmark_items):
    want = brute(docs.collect(), benchmark_items.collect())
    assert report(docs, benchmark_items) == want and any(r[5] and r[6] for r in want)


def test_odd(spark, odd, none, benchmark_items):
    items = spark.createDataFrame([(1, "ONE"), (2, None), (3, ""), (None, "word3 word4"), (4, "one"), (4, "one"), (5, "é F"), (6, " ".join(f"word{k}" for k in range(20, 40)))], "item_id long, text string")
    assert report(odd, items) == brute(odd.collect(), items.collect())
    assert report(odd, items.limit(0)) == brute(odd.collect(), [])
    assert report(none, items) == []
    kept = D.decontaminate(odd, items)
    assert kept.columns == odd.columns
    bad = sum(r[5] for r in report(odd, items))
    assert bad and kept.count() == odd.count() - bad


def test_parts_give_the_same(docs, benchmark_items):
    whole = D.find_benchmark(docs, benchmark_items).select("doc_id", "n_hit", "item_ids").collect()
    parts = D.find_benchmark(docs, benchmark_items, part_chars=40_000).select("doc_id", "n_hit", "item_ids").collect()
    assert sorted(whole) == sorted(parts) and len(list(D._parts(benchmark_items, 13, 40_000))) > 1


def test_spans_are_those_of_the_original(spark):
    text = "Éa — Start: THE quick,brown fox; jumps over. The end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the QUICK brown-fox")], "item_id long, text string")
    r = D.with_spans(D.find_benchmark(docs, items)).first()
    assert [text[x.first : x.after] for x in r.spans] == ["THE quick,brown fox"]
