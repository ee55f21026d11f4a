"""Operator 5, toxicity: nearest labelled examples by exact TF-IDF cosine, block-max inverted index.

Terms are lower-cased runs of letters and, for longer ones, their first four and five
letters followed by ``*`` (stems).  Every term of every sampled labelled row is in the index
(a term that no example has can't be shared with one).  A term weighs (1 + ln tf) x idf x
its lift, where idf comes from the document frequencies over all documents and the lift,
log2(1 + smoothed ratio of its shares among toxic and clean examples), is 1 for a term
that tells nothing; no term is left out for it.

The examples' unit vectors form an inverted index cut into blocks of ``BLOCK`` examples that
are alike.  Terms that many examples have are stored block by block with each term's
largest weight in each block; the short postings of all others are walked as lists.  A
text's similarity to a block is bounded by its terms' block maxima plus its largest sum
over the lists; blocks whose bound is below the k-th similarity so far are skipped, all
others are multiplied out.  Single precision only selects, with a margin; the
similarities of what it selects are summed up again in double precision.

Votes are weighted by similarity and by how many labelled rows an example stands for, with
the base rate as prior, so that scores are calibrated shares; the neighbours are the evidence.

Bounds (documented parameters): MAX_TOXIC and MAX_CLEAN sampled rows.  Their terms bound
everything that is broadcast or counted on the driver.

Defined results
---------------
* null or empty text, or one that shares no term with an example: no neighbours; the score is
  the share of toxic rows among the sampled texts without terms, smoothed by one clean row;
* no labelled rows: no examples, the score is 0; of one label only: lifts are those of the
  smoothing, and the votes are all of that label;
* a row labelled twice counts with its larger label; repeated documents are scored row by row;
* ties of similarity go to the example that comes first by the md5 of its id;
* an empty table gives no rows; extra columns are not carried along.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Memo, discard, grouped, plain_texts, sole, spread, written

MAX_TOXIC = 1_500
MAX_CLEAN = 3_000
BLOCK = 64
NEIGHBOURS = 15
PRIOR_WEIGHT = 0.05
FOLDS = 5
#: Pseudo-examples that smooth a term's lift.
SMOOTHING = 2.0
#: A term is stored in blocks where at least one in so many examples has it, as a list otherwise.
COMMON = 32
#: What single precision may be off by.
MARGIN = 2e-5
#: Pieces of text whose terms a worker remembers; bytes of texts that are scored at once.
CACHE_PIECES = 2_000_000
GROUP_BYTES = 20 << 20
GROUP_TEXTS = 256
#: Terms whose document frequencies make one row.
SLICE = 4_096

_WORDS = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[str, ...]:
    if len(word) < 5:
        return (word,)
    return (word, word[:4] + "*") if len(word) < 6 else (word, word[:4] + "*", word[:5] + "*")


def held_out() -> "F.Column":
    return F.expr(f"crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} = 0")


def text_terms(text: str) -> Counter[str]:
    out: Counter[str] = Counter()
    for word, n in Counter(_WORDS.findall(text.lower())).items():
        for term in word_terms(word):
            out[term] += n
    return out


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term)


def training_sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (MAX_CLEAN, MAX_TOXIC)) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic, place) of at most ``most`` rows of each label outside the held-out fold,
    equal texts once, and the rows of each label."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    some = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(most[k]) for k in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # sum(most) rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    first = F.min(F.struct(order.alias("place"), F.col("doc_id"))).alias("x")
    return rows.groupBy("text", "toxic").agg(first).select("x.doc_id", "text", "toxic", "x.place"), totals


def sample_vectors(sample: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, toxic, hashes of the terms in rising order, counts) of the sampled rows, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted((term_hash(t), n) for t, n in text_terms(x or "").items()) for x in batch.column(3).to_pylist()]
            yield pa.record_batch(
                [
                    *(batch.column(k) for k in range(3)),
                    pa.array([np.array([h for h, _ in x], dtype=np.uint64).tobytes() for x in found], pa.binary()),
                    pa.array([np.array([n for _, n in x], dtype=np.int32).tobytes() for x in found], pa.binary()),
                ],
                names=["doc_id", "toxic", "place", "terms", "counts"],
            )

    rows = sample.select("doc_id", "toxic", "place", "text").mapInArrow(run, "doc_id long, toxic int, place string, terms binary, counts binary").collect()
    rows.sort(key=lambda r: (r["place"], r["doc_id"], r["toxic"]))
    return [(r["doc_id"], r["toxic"], np.frombuffer(r["terms"], dtype=np.uint64), np.frombuffer(r["counts"], dtype=np.int32)) for r in rows]


class Terms:
    """Texts -> numbers of their terms in ``vocabulary`` (sorted hashes)."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        self.memo = Memo(self._numbers, CACHE_PIECES)

    def _numbers(self, pieces: list[str]) -> list[bytes]:
        """The terms of each piece between white space, four bytes each; unknown ones are left out."""
        hashes, sizes, digest = [], [], xxhash.xxh3_64_intdigest
        for piece in pieces:
            before = len(hashes)
            for word in _WORDS.findall(piece.lower()):
                hashes.append(digest(word))
                if len(word) > 4:
                    hashes.append(digest(word[:4] + "*"))
                    if len(word) > 5:
                        hashes.append(digest(word[:5] + "*"))
            sizes.append(len(hashes) - before)
        wanted = np.array(hashes, dtype=np.uint64)
        at = np.searchsorted(self.vocabulary, wanted)
        known = np.zeros(len(wanted), dtype=bool)
        inside = at < len(self.vocabulary)
        known[inside] = self.vocabulary[at[inside]] == wanted[inside]
        ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)].tolist()
        raw = at[known].astype(np.int32).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    def vectors(self, texts: pa.Array, step: int = GROUP_TEXTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(text, term, count) of every term, in this order, and the number of texts, for each ``step`` of ``texts``.

        The pieces of all texts are looked up at once."""
        lists = pc.utf8_split_whitespace(texts)
        places = self.memo.places(lists.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        size = max(1, len(self.vocabulary))
        for at in range(0, len(texts), step):
            own = ends[at : at + step + 1]
            flat = self.memo.made.take(pa.array(places[own[0] : own[-1]]))
            offsets = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1]
            first, last = int(offsets[0]), int(offsets[-1])
            numbers = np.frombuffer(flat.buffers()[2], dtype=np.int32)[first // 4 : last // 4] if last > first else np.zeros(0, dtype=np.int32)
            n = len(own) - 1
            owner = np.repeat(np.arange(n), np.diff(offsets[own - own[0]]) // 4)
            keys, counts = np.unique(owner * size + numbers, return_counts=True)
            yield keys // size, keys % size, counts, n


_TERMS: dict[str, Terms] = {}


def _terms(key: str, vocabulary: np.ndarray) -> Terms:
    """One for each worker and vocabulary."""
    sole(_TERMS)
    if key not in _TERMS:
        _TERMS.clear()
        _TERMS[key] = Terms(vocabulary)
    return _TERMS[key]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, key: str) -> tuple[int, np.ndarray]:
    """(documents, documents that have each term of ``vocabulary``).

    Every task counts for itself; its counts go on as rows of SLICE terms, which the next
    tasks add up as they come."""
    size = len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = _terms(key, shared.value), np.zeros(size + 1, dtype=np.int64)
        for batch in grouped(batches, GROUP_BYTES):
            total[size] += batch.num_rows
            for _, terms, _, _ in own.vectors(plain_texts(batch.column(0))):
                total[:size] += np.bincount(terms, minlength=size)
        if total[size]:
            for k in range(0, size + 1, SLICE):
                yield pa.record_batch([pa.array([k // SLICE], pa.int32()), pa.array([total[k : k + SLICE].tobytes()], pa.binary())], names=["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(raw, dtype=np.int64)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "n"])

    parts = docs.select("text").mapInArrow(count, "slice int, n binary").repartition("slice").mapInArrow(add, "slice int, n binary")
    found = np.zeros(size + 1, dtype=np.int64)
    for r in parts.collect():  # the vocabulary of the sample, eight bytes a term
        some = np.frombuffer(r["n"], dtype=np.int64)
        found[r["slice"] * SLICE :][: len(some)] = some
    return int(found[size]), found[:size]


def lifts(terms: list[np.ndarray], labels: list[int], size: int) -> np.ndarray:
    """log2(1 + smoothed ratio of a term's shares among toxic and clean examples): 1 where they are equal."""
    texts = [max(1.0, float(sum(1 for x in labels if x == k))) for k in (0, 1)]
    have = [np.zeros(size), np.zeros(size)]
    for numbers, label in zip(terms, labels):
        have[label][numbers] += 1
    share = (have[0] + have[1]) / (texts[0] + texts[1])
    ratio = [(have[k] + SMOOTHING) / (texts[k] * share + SMOOTHING) for k in (0, 1)]
    return np.log2(1 + ratio[1] / ratio[0])


def unit(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The unit vector of term counts whose terms have ``weights``."""
    out = (1 + np.log(counts)) * weights
    return out / max(float(np.sqrt(out @ out)), 1e-300)


@dataclass
class BlockMaxIndex:
    """Inverted index over unit vectors, cut into blocks of ``BLOCK`` examples."""

    weights: np.ndarray  # of each term
    ids: np.ndarray  # of the examples, as all that follows in the order of the blocks
    labels: np.ndarray
    votes: np.ndarray  # what an example's vote weighs
    ranks: np.ndarray  # its place among ties
    columns: np.ndarray  # of each term among the common ones, -1 for the others
    blocks: np.ndarray  # (block, example, common term)
    maxima: np.ndarray  # (block, common term)
    starts: np.ndarray  # of each term's list
    listed: np.ndarray  # the examples of the lists
    values: np.ndarray
    base: float  # score without neighbours
    prior: float

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], labels: list[int], votes: list[float], weights: np.ndarray, base: float, prior: float) -> BlockMaxIndex:
        n, size = len(vectors), len(weights)
        padded = -(-n // BLOCK) * BLOCK
        terms = np.concatenate([x[0] for x in vectors]) if n else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(n), [len(x[0]) for x in vectors])
        values = np.concatenate([unit(c, weights[t]) for t, c in vectors]).astype(np.float32) if n else np.zeros(0, dtype=np.float32)
        common = np.flatnonzero(np.bincount(terms, minlength=size) * COMMON >= max(n, COMMON))
        columns = np.full(size, -1, dtype=np.int32)
        columns[common] = np.arange(len(common))
        dense = np.zeros((padded, len(common)), dtype=np.float32)
        often = columns[terms] >= 0
        dense[owner[often], columns[terms[often]]] = values[often]
        order = np.concatenate([alike(dense[:n]), np.arange(n, padded)])
        place = np.argsort(order)
        dense = dense[order].reshape(padded // BLOCK, BLOCK, len(common))
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(terms[rare], minlength=size))])
        real = order[:n]
        return cls(
            weights, np.array(ids, dtype=np.int64)[real], np.array(labels, dtype=np.float64)[real], np.array(votes, dtype=np.float64)[real], real,
            columns, dense, dense.max(axis=1), starts, place[owner[rare]].astype(np.int32), values[rare], base, prior,
        )

    def nearest(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """The ``k`` examples of greatest positive similarity to each of ``n`` texts, given as (text, term, count) in order."""
        if not len(self.ids) or not len(rows):
            return [[] for _ in range(n)]
        query = (1 + np.log(counts)) * self.weights[terms]
        query /= np.sqrt(np.bincount(rows, weights=query * query, minlength=n))[rows]
        often = self.columns[terms] >= 0
        exact = np.zeros((n, self.maxima.shape[1]))
        exact[rows[often], self.columns[terms[often]]] = query[often]
        dense = exact.astype(np.float32)

        width, seldom = len(self.blocks) * BLOCK, np.flatnonzero(~often)
        lengths = self.starts[terms[seldom] + 1] - self.starts[terms[seldom]]
        at = spread(self.starts[terms[seldom]], lengths)
        cells = np.repeat(rows[seldom] * width, lengths) + self.listed[at]
        lists = np.bincount(cells, weights=np.repeat(query[seldom], lengths) * self.values[at], minlength=n * width).reshape(n, width)

        bounds = dense @ self.maxima.T + lists.reshape(n, -1, BLOCK).max(axis=2) + MARGIN
        found = np.full((n, width), -1, dtype=np.float32)

        def visit(chosen: np.ndarray) -> None:
            for b in range(chosen.shape[1]):
                texts = np.flatnonzero(chosen[:, b])
                if len(texts):
                    part = slice(b * BLOCK, (b + 1) * BLOCK)
                    some = dense @ self.blocks[b].T if 2 * len(texts) > n else dense[texts] @ self.blocks[b].T
                    found[texts, part] = (some[texts] if len(some) > len(texts) else some) + lists[texts, part]

        def kth(values: np.ndarray) -> np.ndarray:
            """The k-th similarity of each text, -1 where there are fewer."""
            width = values.shape[1]
            return np.partition(values, width - k, axis=1)[:, width - k] if width > k else np.full(n, -1.0)

        # The two most promising blocks set the similarity that all others' bounds must reach.
        best = np.argsort(-bounds, axis=1, kind="stable")[:, :2]
        first = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(first, best, True, axis=1)
        visit(first)
        seen = np.take_along_axis(found.reshape(n, -1, BLOCK), best[:, :, None], axis=1).reshape(n, -1)
        visit(~first & (bounds > MARGIN) & (bounds >= (kth(seen) - MARGIN)[:, None]))
        least = np.maximum(kth(found) - MARGIN, 0)
        out = []
        for text in range(n):
            some = np.flatnonzero((found[text] >= least[text]) & (found[text] > 0))
            similar = (self.blocks.reshape(width, len(exact[text]))[some] * exact[text]).sum(axis=1) + lists[text, some]
            best = sorted((-round(float(s), 12), int(self.ranks[x]), int(x)) for s, x in zip(similar, some))[:k]
            out.append([(-s, x) for s, _, x in best])
        return out

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.base
        at = np.array([x for _, x in near])
        votes = np.array([s * s for s, _ in near]) * self.votes[at]
        return float((votes @ self.labels[at] + PRIOR_WEIGHT * self.prior) / (votes.sum() + PRIOR_WEIGHT))


def alike(dense: np.ndarray) -> np.ndarray:
    """An order of unit vectors that puts those of one main direction side by side."""
    if not dense.size:
        return np.arange(len(dense))
    heavy = dense[:, np.sort(np.argsort(-(dense * dense).sum(axis=0), kind="stable")[:512])]
    _, directions = np.linalg.eigh((heavy.T @ heavy).astype(np.float64))
    shares = heavy @ directions[:, ::-1][:, :16]
    main = np.abs(shares).argmax(axis=1)
    return np.lexsort((np.arange(len(dense)), -np.take_along_axis(shares, main[:, None], axis=1)[:, 0].round(6), main))


def fit_index(rows: list[tuple[int, int, np.ndarray, np.ndarray]], totals: dict[int, int], vocabulary: np.ndarray, n_docs: int, frequencies: np.ndarray) -> BlockMaxIndex:
    """The index of a bounded sample (MAX_TOXIC + MAX_CLEAN rows)."""
    size = Counter(toxic for _, toxic, _, _ in rows)
    weight = {k: totals.get(k, 0) / max(1, size[k]) for k in (0, 1)}
    plain = {k: weight[k] * sum(1 for r in rows if r[1] == k and not len(r[2])) for k in (0, 1)}
    full = [(d, k, np.searchsorted(vocabulary, t), c) for d, k, t, c in rows if len(t)]
    scale = max(weight.values(), default=1.0) or 1.0
    every = totals.get(0, 0) + totals.get(1, 0)
    idf = np.log((n_docs + 1.0) / (frequencies + 1.0)) + 1.0
    return BlockMaxIndex.build(
        [(t, c) for _, _, t, c in full],
        [d for d, _, _, _ in full],
        [k for _, k, _, _ in full],
        [weight[k] / scale for _, k, _, _ in full],
        idf * lifts([t for _, _, t, _ in full], [k for _, k, _, _ in full], len(vocabulary)),
        base=plain[1] / (plain[0] + plain[1] + 1.0),
        prior=totals.get(1, 0) / (every + 1.0),
    )


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbour_ids, similarities) of every document."""
    sample, totals = training_sample(docs, labels)
    sample = written(sample, "toxic-sample")
    rows = sample_vectors(sample)
    discard(sample)
    vocabulary = np.unique(np.concatenate([t for _, _, t, _ in rows])) if rows else np.zeros(0, dtype=np.uint64)
    key = uuid.uuid4().hex
    n_docs, frequencies = document_frequencies(docs, vocabulary, key)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, fit_index(rows, totals, vocabulary, n_docs, frequencies)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shared.value
        own = _terms(key, vocabulary)
        for batch in grouped(batches, GROUP_BYTES):
            near = [x for some in own.vectors(plain_texts(batch.column(1))) for x in index.nearest(*some)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([round(min(1.0, max(0.0, index.score(x))), 12) for x in near], pa.float64()),
                    pa.array([[int(index.ids[e]) for _, e in x] for x in near], pa.list_(pa.int64())),
                    pa.array([[s for s, _ in x] for x in near], pa.list_(pa.float64())),
                ],
                names=["doc_id", "score", "neighbour_ids", "similarities"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = texts.mapInArrow(run, "doc_id long, score double, neighbour_ids array<long>, similarities array<double>")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbour_ids", "similarities")
