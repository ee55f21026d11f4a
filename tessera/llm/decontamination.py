"""Operator 6, benchmark decontamination: one Aho-Corasick automaton over normalised items.

A word is a run of ASCII digits, ASCII letters (lower-cased) or characters beyond ASCII.
A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none,
is one window.  The automaton holds every window as text, blank before and after each
word; each document is normalised and scanned once.  Hits are mapped from the normalised
text to word numbers and to offsets in the original.

The benchmark is a stated set of items.  Its windows are broadcast in parts of at most
``PART_CHARS`` characters, a bound that is checked; a larger benchmark is scanned part
after part, each pass adding its hits to the rows that the pass before has written.

Defined results
---------------
* null or empty text: no words, no hits, not contaminated;
* null or word-less items are never found; a null ``item_id`` is reported as ``null``;
* equal items each count, repeated rows of one item count once; repeated documents are
  judged row by row; empty tables give no rows or no hits;
* extra columns of ``docs`` are carried along; clashing ones (RESULTS) are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import text_bytes, written

WINDOW = 13
#: Bound of what one automaton holds and one broadcast sends; 2.2 million characters of windows made
#: an automaton of 96 MB, so a part makes some 200 MB in each worker.
PART_CHARS = 4_000_000
RESULTS = ("n_words", "n_hit", "item_ids", "spans", "contaminated")

_OUTSIDE = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_NORMAL = bytes.maketrans(bytes([*range(0x41, 0x5B), *_OUTSIDE]), bytes([*range(0x61, 0x7B), *[0x20] * len(_OUTSIDE)]))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def item_windows(raw: bytes, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = normal_words(raw)
    size = min(window, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def _parts(benchmark: DataFrame, window: int, part_chars: int) -> Iterator[dict[bytes, tuple[int, set[str]]]]:
    """Windows as text -> (words, ids of the items that have it), in parts of bounded size."""
    part: dict[bytes, tuple[int, set[str]]] = {}
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text")).toLocalIterator()
    for item_id, text in rows:
        for words in item_windows((text or "").encode(), window):
            key = b" " + b" ".join(words) + b" "
            if size + len(key) > part_chars and key not in part and part:
                yield part
                part, size = {}, 0
            if key not in part:
                part[key] = (len(words), set())
                size += len(key)
            part[key][1].add(item_id)
    yield part


_AUTOMATA: dict[str, object] = {}


def _automaton(key: str, windows: dict[bytes, tuple[int, set[str]]]):
    """One for each worker and part."""
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        out = ahocorasick.Automaton()
        for text, value in windows.items():
            out.add_word(text.decode("latin-1"), value)  # a character a byte
        out.make_automaton()
        _AUTOMATA[key] = out
    return _AUTOMATA[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(raw: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of a text, the merged word intervals that windows cover, ids of the items found."""
    words = normal_words(raw)
    if not words or not len(automaton):
        return len(words), [], set()
    normal = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(normal.decode("latin-1")))
    if not hits:
        return len(words), [], set()
    blanks = np.flatnonzero(np.frombuffer(normal, dtype=np.uint8) == 0x20)
    after = np.searchsorted(blanks, [end for end, _ in hits]).tolist()
    spans = [(e - size, e) for e, (_, (size, _)) in zip(after, hits)]
    return len(words), _merged(spans), set().union(*(ids for _, (_, ids) in hits))


def original_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as offsets, in code points, of the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(raw)]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in spans]


_STRUCTS = "array<struct<first:long,after:long>>"


def _pass(rows: DataFrame, part: dict[bytes, tuple[int, set[str]]]) -> DataFrame:
    """Add one part's hits to the columns n_words, _hits (word intervals) and item_ids."""
    shared, key = rows.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex
    kinds = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in batches:
            names = batch.schema.names
            texts = text_bytes(batch.column(names.index("text")))
            counts, hits, ids = [], [], []
            for raw, had, known in zip(texts, batch.column(names.index("_hits")).to_pylist(), batch.column(names.index("item_ids")).to_pylist()):
                n, spans, found = scan(raw, automaton)
                counts.append(n)
                hits.append([{"first": a, "after": b} for a, b in _merged([*spans, *((x["first"], x["after"]) for x in had)])])
                ids.append(sorted(found.union(known)))
            new = {"n_words": pa.array(counts, pa.int64()), "_hits": pa.array(hits, kinds), "item_ids": pa.array(ids, pa.list_(pa.string()))}
            yield pa.record_batch([new.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)

    return rows.mapInArrow(run, rows.schema)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids, ``_hits`` (word intervals) and ``contaminated``."""
    rows = docs.drop(*RESULTS, "_hits").withColumns({"n_words": F.lit(0).cast("long"), "_hits": F.array().cast(_STRUCTS), "item_ids": F.array().cast("array<string>")})
    previous = None
    for part in _parts(benchmark, window, part_chars):
        rows = _pass(rows if previous is None else written(rows, "benchmark-pass"), part)
        previous = rows
    n_hit = F.expr("aggregate(_hits, 0L, (a, x) -> a + x.after - x.first)")
    return rows.withColumn("n_hit", n_hit).withColumn("contaminated", contaminated())


def contaminated() -> Column:
    return F.expr("n_hit > 0 and 20 * n_hit >= n_words")


def with_spans(found: DataFrame) -> DataFrame:
    """Replace ``_hits`` by ``spans``: offsets (code points) of the hits in the original text."""
    kinds = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            k = names.index("_hits")
            spans = [
                [{"first": a, "after": b} for a, b in original_spans(raw, [(x["first"], x["after"]) for x in hits])]
                for raw, hits in zip(text_bytes(batch.column(names.index("text"))), batch.column(k).to_pylist())
            ]
            yield pa.record_batch([pa.array(spans, kinds) if i == k else batch.column(i) for i in range(len(names))], names=names)

    return found.mapInArrow(run, found.schema).withColumnRenamed("_hits", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with the columns of ``docs``."""
    return find_benchmark(docs.withColumn("_own", F.struct(*(F.col(f"`{c}`") for c in docs.columns))).select("_own", F.col("_own.text").alias("text")), benchmark).where("not contaminated").select("_own.*")


def benchmark_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One digest row a document, with the spans of its hits in the original ("first-after", in code points)."""
    found = with_spans(find_benchmark(docs.select(F.col("doc_id").cast("long"), "text"), benchmark))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        F.expr("array_join(transform(spans, x -> concat(x.first, '-', x.after)), ',')").alias("spans"),
    )
