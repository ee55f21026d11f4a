"""Operator 7, substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``.  Every window of ``WINDOW``
consecutive words that may repeat gets a polynomial rolling hash.  A word goes where a window
that covers it has a word sequence that also starts anywhere else.

So that not every hash has to be shuffled, windows are first sifted without loss: of the
``GRAM``-word pieces inside a window the one of the smallest hash (leftmost on ties) is its
anchor.  Equal windows have equal anchors at equal places, so a window whose anchor occurs
at one place only in all documents is unique.  Anchors, a tenth of the windows, are counted
first; the hashes of the windows at repeated anchors are then counted in Spark, joined back, and
merged into maximal removal intervals of each text.

Equal texts are kept once, with their number (their windows weigh as much), so that a
large group of copies neither meets in one task nor repeats its windows.  Counted hashes have
128 bits, from two independent polynomials: at n counted windows the odds that any unique one is
taken for repeated are n**2 / 2**129.  Anchors have 64; a chance pair there costs work, not words.

Defined results
---------------
* null or empty text: no words, nothing removed, the hash of the empty string;
* a text of fewer than ``WINDOW`` words loses nothing, however often it occurs;
* repeated rows are copies of each other, so their windows are repeated; null ``doc_id``
  is a value like any other; an empty table gives no rows;
* only ``doc_id`` and ``text`` are read; extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, grouped, plain_texts, release, text_bytes, text_key, word_hashes, written

WINDOW = 35
GRAM = 18
#: Bytes of texts that are hashed at once.
GROUP_BYTES = 16 << 20
#: Bases of the polynomials (fixed values; any odd bases will do).
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    if base not in _POWERS or _POWERS[base].shape[1] < n:
        out = np.ones((2, 1 << (n - 1).bit_length()), dtype=np.uint64)
        out[:, 1:] = np.array([[base], [pow(base, -1, 1 << 64)]], dtype=np.uint64)
        _POWERS[base] = np.multiply.accumulate(out, axis=1)
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose high and low bits depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of each ``size`` consecutive words (modulo 2**64), mixed."""
    n = len(words)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    powers = _powers(n, base)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers[1, :n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers[0, : n - size + 1])


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each ``gram``-word piece, place of the anchor of each window)."""
    pieces = rolling(words, gram)
    span = window - gram + 1
    at, size = np.arange(len(pieces)), 1
    while size * 2 <= span:
        a, b = at[:-size], at[size:]
        at, size = np.where(pieces[a] <= pieces[b], a, b), size * 2
    if size < span:
        a, b = at[: len(at) - (span - size)], at[span - size :]
        at = np.where(pieces[a] <= pieces[b], a, b)
    return pieces, at


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each window's hash; the second sees other hashes of the words."""
    return rolling(words, window), rolling(mixed(words * np.uint64(OTHER_BASE) + np.uint64(1)), window, OTHER_BASE)


def _first_pass(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row a document: (doc_id, k1, k2, n_words, whole_sha256, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, GROUP_BYTES):
            shas, found = [], []
            hashes, bounds = word_hashes(plain_texts(batch.column(3)))
            counts = np.diff(bounds)
            for raw, a, b in zip(text_bytes(batch.column(3)), bounds.tolist(), bounds[1:].tolist()):
                shas.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                if b - a < window:
                    found.append([])
                else:
                    pieces, at = anchors(hashes[a:b], window, gram)
                    found.append(pieces[np.unique(at)].view(np.int64))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n_words", "whole_sha256", "anchors"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, whole_sha256 string, anchors array<long>")


def _candidates(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, g, k1, k2, at, copies) of the windows of (k1, k2, copies, repeated, text) with a repeated anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1s, k2s, copies, repeated = (batch.column(k) for k in range(4))
            found, bounds = word_hashes(plain_texts(batch.column(4)))
            for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                words = found[a:b]
                pieces, at = anchors(words, window, gram)
                known = repeated[row].values.to_numpy().view(np.uint64)
                places = np.flatnonzero(np.isin(pieces, known)[at])
                h, g = (x[places].view(np.int64) for x in window_hashes(words, window))
                n = len(places)
                yield pa.record_batch(
                    [pa.array(h), pa.array(g), pa.array(np.full(n, k1s[row].as_py())), pa.array(np.full(n, k2s[row].as_py())), pa.array(places.astype(np.int32)), pa.array(np.full(n, copies[row].as_py()))],
                    names=["h", "g", "k1", "k2", "at", "copies"],
                )

    return rows.select("k1", "k2", "copies", "repeated", "text").mapInArrow(run, "h long, g long, k1 long, k2 long, at int, copies long")


def removal_intervals(places: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal word intervals that the windows at ``places`` cover."""
    places = np.sort(places)
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > window) + 1
    return [(int(x[0]), int(x[-1]) + window) for x in np.split(places, cut)]


def _last_pass(rows: DataFrame, window: int) -> DataFrame:
    """(k1, k2, n_removed, kept_sha256, kept, intervals) of (k1, k2, places, text)."""
    kinds = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept, spans = [], [], [], []
            for places, raw in zip(batch.column(2), text_bytes(batch.column(3))):
                words, after, parts = raw.split(), 0, []
                found = removal_intervals(np.array(places.as_py(), dtype=np.int64), window)
                for a, b in found:
                    parts += words[after:a]
                    after = b
                parts += words[after:]
                kept.append(b" ".join(parts))
                removed.append(len(words) - len(parts))
                shas.append(hashlib.sha256(kept[-1]).hexdigest())
                spans.append([{"first": a, "after": b} for a, b in found])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kinds)],
                names=["k1", "k2", "n_removed", "kept_sha256", "kept", "intervals"],
            )

    return rows.select("k1", "k2", "places", "text").mapInArrow(run, "k1 long, k2 long, n_removed long, kept_sha256 string, kept string, intervals array<struct<first:long,after:long>>")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): the key of each text beside it."""
    return docs.withColumns(text_key()).select("doc_id", "k1", "k2", "text")


def _with_text(some: DataFrame, docs: DataFrame) -> DataFrame:
    """``some`` (k1, k2, doc_id of one copy, ...) with that copy's text: only small rows meet all texts.

    Copies of a text differ in doc_id, so they spread over the tasks of this join.
    """
    texts = _keyed(docs).withColumnRenamed("doc_id", "_id")
    on = (texts.k1 == some.k1) & (texts.k2 == some.k2) & texts._id.eqNullSafe(some.doc_id)
    return some.join(texts, on).select(some["*"], texts.text)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, k1, k2, n_words, whole_sha256; a row a changed text: k1, k2,
    n_removed, kept_sha256, intervals, and ``kept`` where ``texts``).  Both are tables in the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    first = written(_first_pass(docs, window, gram), "windows-first")
    copies = first.where(F.col("n_words") >= window).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    copies = written(copies, "windows-copies")
    # Repeated rows (equal id and text) stay: their text has copies anyway, and its windows weigh more than one.
    one = copies.withColumnsRenamed({"k1": "r1", "k2": "r2"})
    reps = first.join(one, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    reps = written(reps.select("k1", "k2", "doc_id", "copies", "anchors"), "windows-reps")
    release(docs.sparkSession)

    places = reps.select("k1", "k2", "doc_id", "copies", F.explode("anchors").alias("anchor"))
    again = written(places.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "windows-anchors")
    release(docs.sparkSession)
    hot = places.join(again, "anchor").groupBy("k1", "k2", "doc_id", "copies").agg(F.collect_set("anchor").alias("repeated"))
    hot = written(hot, "windows-texts")
    discard(again)
    discard(reps)
    release(docs.sparkSession)

    found = written(_candidates(_with_text(hot, docs), window, gram), "windows-found")
    discard(hot)
    release(docs.sparkSession)
    counts = written(found.groupBy("h", "g").agg(F.sum("copies").alias("n")).where("n > 1").select("h", "g"), "windows-counts")
    release(docs.sparkSession)
    # What occurs in copies goes as a whole; only texts of one copy need their places.
    cut = found.where("copies = 1").join(counts, ["h", "g"]).groupBy("k1", "k2").agg(F.collect_list("at").alias("places"))
    cut = written(cut, "windows-places")
    discard(found)
    discard(counts)
    release(docs.sparkSession)

    ids = copies.withColumnsRenamed({"rep": "doc_id"}).where("copies = 1").join(cut, ["k1", "k2"]).select("k1", "k2", "doc_id", "places")
    partly = _last_pass(_with_text(ids, docs), window)
    whole_size = first.where(F.col("n_words") >= window).select("k1", "k2", "n_words").distinct()
    kinds = "array<struct<first:long,after:long>>"
    wholly = copies.where("copies > 1").join(whole_size, ["k1", "k2"]).select(
        "k1", "k2", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept"), F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("after"))).cast(kinds).alias("intervals")
    )
    both = partly.unionByName(wholly)
    changed = written(both if texts else both.drop("kept"), "windows-changed")
    discard(cut)
    discard(copies)
    release(docs.sparkSession)
    return first.drop("anchors"), changed


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, intervals) of every document."""
    rows, changed = repeated_windows(docs, window, gram)
    out = rows.join(changed, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        F.expr("transform(coalesce(intervals, array()), x -> concat(x.first, '-', x.after))").alias("intervals"),
    )


def substring_digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept words of every changed text, joined by one blank; other texts stay as they are."""
    _, changed = repeated_windows(docs, window, texts=True)
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).distinct()
    kept = keyed.join(changed, ["k1", "k2"]).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("kept").alias("_kept"))
    on = docs.doc_id.eqNullSafe(kept._id) & docs.text.eqNullSafe(kept._text)
    return docs.join(kept, on, "left").select(*(F.coalesce("_kept", docs.text).alias("text") if c == "text" else docs[c] for c in docs.columns))
