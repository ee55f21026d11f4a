"""Operator 2, n-gram Jaccard join: MinHash LSH forest, then exact verification.

A text's shingles are the sets of ``SHINGLE`` consecutive words (runs of bytes other than
space and ``\\x09``-``\\x0D``, unchanged); a text of fewer words, but not none, is one shingle.
Two texts are linked where the Jaccard similarity of their shingle sets is 0.8 or more.

1. Documents of equal shingle sets are one class; classes, not copies, are joined.
2. The forest: every class has a signature of ``DEPTH`` minimum hashes in each of ``TREES`` trees.
   A tree is a prefix trie, kept as the signatures in sorted order: the first ``TOP`` values, which
   no descent goes below, are one key, the others sixteen bits each of one word.  Branches of one
   class are dropped.
3. The descent: the classes that share a prefix form a node.  The nodes of ``DEPTH`` values, those
   of the whole table, come first; their links, all counted by similarity, tell how far the prefix
   must be shortened, until the whole table loses no link with probability ``RECALL`` (or to
   ``TOP`` values).  One more link at the threshold is always reckoned with, so that no link has a
   lower recall than that, whatever the others are (:func:`descent`).  The nodes of that
   length follow.  Nodes of more than one block are put off, so that large groups aren't compared
   at both lengths: where there are any, the prefix is shortened to ``TOP`` values.
4. Of nodes with the same members, at either length, one is kept.  A node is cut into blocks of
   bounded rows and shingles, and each pair of blocks is one unit of work; a pair of classes is
   counted in the first node that both have.  Nothing emits the pairs: a unit returns the number
   of links of each class, a spanning forest of the links and their number by similarity.
5. Within a unit the similarity is exact: shingles that occur in the same classes of the
   unit are one column, weighted by their number, of a 0/1 matrix; the intersections are
   the product of the matrix with itself.
6. Connected components over the forests' edges (large-star / small-star steps, each a
   table in the shared folder) give the groups.

Shingles are compared by 64-bit hashes.

Defined results
---------------
* null or empty text: no shingles, its own group, no links;
* repeated rows and equal texts are copies: linked with each other, never expanded;
* ``class_id`` is the smallest doc_id of the group; null if all its ids are null;
* an empty table gives no rows; extra columns of ``docs`` are carried by :func:`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ROW_KEY, discard, grouped, id_key, partitions_for, plain_texts, release, row_key, sifted, text_key, word_hashes, written
from tessera.llm.substring_dedup import mixed

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
#: Length of the shortest prefix: there a pair at the threshold meets with probability 1 - 5e-8.
TOP = 4
RECALL = 0.99999
#: Bytes of texts that are signed at once.
GROUP_BYTES = 16 << 20
#: Bounds of a block: classes, and shingles of all its classes together.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 400_000

def shortened(links: list[tuple[float, float]], trees: int = TREES, depth: int = DEPTH, top: int = TOP, threshold: float = THRESHOLD, recall: float = RECALL, together: bool = False) -> tuple[int, float]:
    """(length of the prefix, recall expected of it) for links given as (similarity, weight).

    ``recall`` is that of a link on average or, with ``together``, the probability that none of
    them is lost.  One link at the threshold is added, so that few links don't promise too much."""
    links = [*links, (threshold, 1.0)]
    total = sum(w for _, w in links)
    while True:
        lost = sum(w * (1 - min(1.0, s) ** depth) ** trees for s, w in links)
        if lost <= (1 - recall) * (1 if together else total) or depth <= top:
            return depth, 1 - lost / total
        depth -= 1


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of the shingles of a text's word hashes, as 64-bit hashes."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mixed(out + hashes[k : n - size + 1 + k] * np.uint64(0x9FB21C651E98DF25))
    return np.unique(out)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    hashes, bounds = word_hashes(texts)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        yield shingles(hashes[a:b])


_FACTORS: dict[int, np.ndarray] = {}


def _factors(n: int) -> np.ndarray:
    if n not in _FACTORS:
        _FACTORS[n] = np.random.default_rng(20240229).integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _FACTORS[n]


def signature(found: np.ndarray, n: int) -> np.ndarray:
    """``n`` minimum hashes of a shingle set: multiplications by odd numbers permute the 64-bit words."""
    factors, out = _factors(n), np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(out, (found[at : at + 512, None] * factors).min(axis=0), out=out)
    return out


def tree_keys(found: np.ndarray, trees: int = TREES, depth: int = DEPTH, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """For each tree, the key of the first ``top`` minimum hashes, and sixteen bits of each further one, the first on top."""
    values = signature(found, trees * depth).reshape(trees, depth)
    heads = np.arange(trees, dtype=np.uint64)
    for k in range(top):
        heads = mixed(heads * np.uint64(0x9FB21C651E98DF25) + values[:, k])
    tails = np.zeros(trees, dtype=np.uint64)
    for k in range(top, depth):
        tails = tails << np.uint64(16) | mixed(values[:, k]) >> np.uint64(48)
    return heads, tails


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, fp, n_shingles, heads, tails) of every document; fp identifies the shingle set (null: no words)."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, GROUP_BYTES):
            fps, sizes, heads, tails = [], [], [], []
            for found in shingle_sets(plain_texts(batch.column(3))):
                sizes.append(len(found))
                fps.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                own = tree_keys(found) if len(found) else (found, found)
                heads.append(own[0].view(np.int64))
                tails.append(own[1].view(np.int64))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(heads, longs), pa.array(tails, longs)],
                names=["doc_id", "k1", "k2", "fp", "n_shingles", "heads", "tails"],
            )

    keyed = docs.withColumns(text_key()).select("doc_id", "k1", "k2", "text")
    return keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, fp binary, n_shingles long, heads array<long>, tails array<long>")


# -- exact verification within a unit -----------------------------------------------------


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]], dtype=np.float64)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(values)]]))
    # Shingles with the same owners are one column; a random word for each owner tells columns apart.
    marks = np.random.default_rng(7).integers(0, 1 << 63, size=(2, n), dtype=np.uint64)
    sums = np.stack([np.add.reduceat(m[owner], starts) for m in marks], axis=1)
    shared = counts > 1
    out = np.zeros((n, n), dtype=np.float64)
    if shared.any():
        _, first, number = np.unique(sums[shared], axis=0, return_index=True, return_counts=True)
        at, size = starts[shared][first], counts[shared][first]
        for low in range(0, len(at), 4096):
            a, s = at[low : low + 4096], size[low : low + 4096]
            rows = np.repeat(np.arange(len(a)), s)
            places = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(a, s)
            matrix = np.zeros((len(a), n), dtype=np.float32)
            matrix[rows, owner[places]] = 1
            out += matrix.T @ (matrix * number[low : low + 4096, None].astype(np.float32))
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all pairs."""
    common = intersections(sets)
    sizes = np.diag(common)
    return common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1)


def shares_one(owners: list[np.ndarray]) -> np.ndarray:
    """Whether the owners of each pair have a value in common; ``owners`` are sets."""
    n = len(owners)
    out = np.zeros((n, n), dtype=bool)
    values = np.concatenate(owners) if n else np.zeros(0, dtype=np.int64)
    if not len(values):
        return out
    owner = np.repeat(np.arange(n), [len(x) for x in owners])
    _, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    some = counts[number] > 1
    owner, (kept, number) = owner[some], np.unique(number[some], return_inverse=True)
    for low in range(0, len(kept), 4096):
        here = (number >= low) & (number < low + 4096)
        matrix = np.zeros((n, min(4096, len(kept) - low)), dtype=np.float32)
        matrix[owner[here], number[here] - low] = 1
        out |= matrix @ matrix.T > 0
    return out


def linked_roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component in a symmetric matrix."""
    n = len(linked)
    roots = np.arange(n)
    while True:
        after = np.minimum(roots, np.where(linked, roots[None, :], n).min(axis=1, initial=n))
        after = after[after]
        if (after == roots).all():
            return roots
        roots = after


def verify_unit(fps: list[bytes], copies: list[int], nodes: list[list[int]], blocks: list[int], sets: list[np.ndarray], node: int, low: int, high: int, threshold: float = THRESHOLD, before: list[list[int]] | None = None):
    """(links of each class counted here, edges of a spanning forest, pairs by thousandths of similarity)
    of one pair of blocks; ``before`` are nodes of each class that all come before this one."""
    n = len(fps)
    block = np.array(blocks)
    across = (block[:, None] == low) & (block[None, :] == high)
    if low == high:
        across &= np.triu(np.ones((n, n), dtype=bool), 1)
    alike = similarities(sets)
    found = across & (alike >= threshold - 1e-12)
    if found.any():  # pairs that an earlier node has too are counted there
        earlier = [x[x < node] for x in (np.array(x, dtype=np.int64) for x in nodes)]
        if before is not None:
            earlier = [np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in zip(earlier, before)]
        found &= ~shares_one(earlier)
    linked = found | found.T
    roots = linked_roots(linked)
    edges = [(fps[r], fps[k]) for k, r in enumerate(roots.tolist()) if r != k]
    kinds = np.unique((alike[found] * 1000 + 1e-6).astype(np.int64), return_counts=True)
    return (linked @ np.array(copies, dtype=np.int64)).tolist(), edges, list(zip(*(x.tolist() for x in kinds)))


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n, s): a class and links of it (b null), an edge (n 0), or the number of pairs of a
    similarity in thousandths (a and b null); members sorted by unit."""

    def unit(rows: list[dict], out: list[tuple]) -> None:
        if len(rows) < 2:
            return
        sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
        first = rows[0]
        links, edges, kinds = verify_unit(*([r[c] for r in rows] for c in ("fp", "copies", "nodes", "block")), sets, first["node"], first["low"], first["high"], threshold, [r["before"] for r in rows])
        out.extend((r["fp"], None, n, None) for r, n in zip(rows, links) if n)
        out.extend((a, b, 0, None) for a, b in edges)
        out.extend((None, None, n, s) for s, n in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        key = None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                own = (r["node"], r["low"], r["high"])
                if own != key:
                    unit(rows, out)
                    rows, key = [], own
                rows.append(r)
            yield _links(out)
        out = []
        unit(rows, out)
        yield _links(out)

    return members.mapInArrow(run, "a binary, b binary, n long, s int")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"a": pa.binary(), "b": pa.binary(), "n": pa.int64(), "s": pa.int32()}
    return pa.record_batch([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


# -- connected components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of the component of every vertex of ``edges`` (a, b).

    Large-star and small-star steps alternate until the edges form stars.  Every step is a
    minimum for each vertex (summed up before the shuffle) and a join, whose hot keys Spark splits.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-low")
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = written(large, "edges-large")
        # Small star: every vertex and its smaller neighbours point to the least of them.
        least = written(large.groupBy("b").agg(F.min("a").alias("m")), "edges-least")
        small = large.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        after = written(small, "edges")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        for old in (now, low, large, least):
            discard(old)
        now = after
        if (state["n"], state["h"]) == mark:
            break
        mark = (state["n"], state["h"])
    roots = now.groupBy("b").agg(F.min("a").alias("root"))
    return roots.select(F.col("b").alias("v"), "root").union(now.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())


# -- the operator -----------------------------------------------------------------------


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, fp of every document; fp, root, rep, copies, links of every class), both tables.

    ``rep`` names a class's first document by doc_id and text key; ``root`` names the group.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = written(_signed(docs), "forest-signed")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    one = [F.first(c).alias(c) for c in ("n_shingles", "heads", "tails")]  # equal in all of a class
    reps = written(signed.where("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"), F.min(name).alias("rep"), *one), "forest-signatures")
    rows = written(signed.select("doc_id", "k1", "k2", "fp"), "forest-rows")
    discard(signed)
    release(spark)

    # The tries: branches of several classes, by their first TOP values.
    member = reps.select("fp", "n_shingles", F.explode(F.arrays_zip("heads", "tails")).alias("x")).select("fp", "n_shingles", F.col("x.heads").alias("hi"), F.col("x.tails").alias("lo"))
    branches = written(member.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1"), "forest-branches")
    release(spark)
    # Most values are of one class: they are left out before the join shuffles them.
    tries = written(sifted(member, branches, ("hi",)).where("_may").drop("_may").join(branches, "hi"), "forest-tries")
    classes = written(reps.select("fp", "copies", "rep"), "forest-classes")
    for old in (branches, reps):
        discard(old)
    release(spark)
    wanted = written(tries.select("fp").distinct().join(classes, "fp"), "forest-wanted")
    release(spark)
    sets = written(_sets(docs, wanted), "forest-sets")
    discard(wanted)
    release(spark)

    # The longest prefixes first, then what their links call for.
    nodes = _nodes(tries, DEPTH)
    small = nodes.where("cut = 1")
    shared = _members(tries, DEPTH, small)
    found = [written(_counted(sets, shared, threshold), "forest-found")]
    done = [nodes, shared, tries, sets]
    release(spark)
    depth, _ = descent(found[0], threshold)
    if not nodes.where("cut > 1").isEmpty():
        depth = TOP  # large nodes are put off, and lie whole in the branches
    if depth < DEPTH:
        more = _nodes(tries, depth, small)
        rest = _members(tries, depth, more)
        found.append(written(_counted(sets, rest, threshold, shared), "forest-found"))
        done += [more, rest]
    for old in done:
        discard(old)
    release(spark)

    both = reduce(DataFrame.union, found)
    links = both.where("a is not null and b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("links"))
    groups = components(both.where("b is not null").select("a", "b")).withColumnRenamed("v", "fp")
    named = classes.join(groups, "fp", "left").join(links, "fp", "left")
    named = written(named.select("fp", F.coalesce("root", "fp").alias("root"), "rep", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links")), "forest-named")
    for old in (*found, classes):
        discard(old)
    release(spark)
    return rows, named


def _at(tries: DataFrame, depth: int) -> DataFrame:
    """(fp, n_shingles, node) of the tries at a depth."""
    node = F.col("hi") if depth == TOP else F.xxhash64("hi", F.shiftrightunsigned("lo", 16 * (DEPTH - depth)))
    return tries.select("fp", "n_shingles", node.alias("node"))


def _nodes(tries: DataFrame, depth: int, done: DataFrame | None = None) -> DataFrame:
    """(node, cut, size, weight, who0, who1) of the nodes of ``depth`` values, a table.

    Nodes with the same members do the same work, so one of them stays, and none that ``done`` has."""
    who = [F.sum(F.xxhash64("fp", F.lit(k)).cast("decimal(38,0)")).alias(f"who{k}") for k in (0, 1)]
    same = ["size", "weight", "who0", "who1"]
    kinds = _at(tries, depth).groupBy("node").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), *who).where("size > 1")
    nodes = kinds.groupBy(*same).agg(F.min("node").alias("node"))
    if done is not None:
        nodes = nodes.join(done.select(*same), same, "left_anti")
    cut = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    nodes = written(nodes.select("node", cut.alias("cut"), *same), "forest-nodes")
    release(tries.sparkSession)
    return nodes


def _members(tries: DataFrame, depth: int, nodes: DataFrame) -> DataFrame:
    """(fp, node, cut, block) of the members of ``nodes``, a table."""
    block = F.pmod(F.xxhash64("fp"), "cut").cast("int")
    shared = written(_at(tries, depth).select("fp", "node").join(nodes.select("node", "cut"), "node").withColumn("block", block), "forest-shared")
    release(tries.sparkSession)
    return shared


def _counted(sets: DataFrame, shared: DataFrame, threshold: float, before: DataFrame | None = None) -> DataFrame:
    """What :func:`_verified` says of all pairs in the nodes of ``shared`` but those in a node of ``before``."""
    of = lambda x, name: x.groupBy("fp").agg(F.collect_list("node").alias(name))
    own = of(shared, "nodes")
    if before is not None:
        own = own.join(of(before, "before"), "fp", "left")
    none = F.array().cast("array<long>")
    own = own.select("fp", "nodes", (none if before is None else F.coalesce("before", none)).alias("before"))
    pairs = F.expr("transform(sequence(0, cut - 1), k -> named_struct('low', least(k, block), 'high', greatest(k, block)))")
    units = shared.select("node", "fp", "block", F.explode(pairs).alias("p")).select("node", "fp", "block", "p.low", "p.high")
    work = units.join(sets.join(own, "fp"), "fp").repartition(partitions_for(sets), "node", "low", "high").sortWithinPartitions("node", "low", "high")
    return _verified(work.select("node", "low", "high", "block", "fp", "copies", "nodes", "before", "shingles"), threshold)


def descent(found: DataFrame, threshold: float = THRESHOLD) -> tuple[int, float]:
    """(length of the prefix that will do, recall expected of it), from all links of the nodes of ``DEPTH`` values.

    A link of similarity s is among them with a known probability, by whose inverse it counts."""
    rows = found.where("s is not null").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").collect()
    links = [(r["s"] / 1000, r["n"] / (1 - (1 - (r["s"] / 1000) ** DEPTH) ** TREES)) for r in rows]
    return shortened(links, threshold=threshold, together=True)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, copies, shingles) of the classes in ``wanted``, from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(plain_texts(batch.column(2)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["fp", "copies", "shingles"])

    one = _named_rows(wanted.select("fp", "copies", "rep"))
    # Few texts are wanted, and others aren't shuffled.  Repeated rows, equal in id and text, meet in the join's own partitioning.
    texts = sifted(docs.withColumns(row_key()), one).where("_may").drop("_may").join(one, ROW_KEY).dropDuplicates(ROW_KEY)
    return texts.select("fp", "copies", "text").mapInArrow(run, "fp binary, copies long, shingles binary")


def _named_rows(rows: DataFrame) -> DataFrame:
    """``rep`` as the columns of a row key."""
    return rows.select(*(c for c in rows.columns if c != "rep"), F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"), F.col("rep.none").cast("int").alias("d0"), F.coalesce("rep.doc_id", F.lit(0).cast("long")).alias("d1"))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, copy_id) of every document: its group, the number of other
    documents of similarity ``threshold`` or more, and the first document of its copies."""
    rows, classes = near_classes(docs, threshold)
    first = classes.groupBy("root").agg(F.min("rep.doc_id").alias("class_id"))
    classes = classes.join(first, "root").select("fp", "class_id", F.col("rep.doc_id").alias("copy_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    classes = written(classes, "forest-classed")
    out = rows.join(classes, "fp", "left")
    alone = F.when(F.col("fp").isNull(), F.col("doc_id"))
    return out.select("doc_id", F.coalesce("class_id", alone).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copy_id", alone).alias("copy_id"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id; rows without words all stay."""
    rows, classes = near_classes(docs, threshold)
    first = written(_named_rows(classes.groupBy("root").agg(F.min("rep").alias("rep")).select("rep")), "forest-first")
    several = classes.where("copies > 1 or links > 0").select("fp")
    several = written(rows.join(several, "fp").withColumns(id_key()).select(*ROW_KEY).distinct(), "forest-several")
    release(docs.sparkSession)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("*").alias("_own")).withColumns(row_key())
    # Rows that aren't of a group of several are their groups' only ones: their texts stay where they are.
    wordless = F.coalesce("text", F.lit("")).rlike(r"\A[ \t\n\x0B\f\r]*\z")
    packed = sifted(packed, several).withColumn("_may", F.col("_may") & ~wordless)
    kept = packed.where("_may").select("_own", *ROW_KEY).join(first, ROW_KEY).dropDuplicates(ROW_KEY)
    return kept.select("_own.*").unionByName(packed.where("not _may").select("_own.*"))
