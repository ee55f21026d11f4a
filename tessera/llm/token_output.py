"""Operator 1, token-ID / binary output: frequency-ranked ids in byte-aligned variable-length coding.

File format
-----------
A folder with two Parquet tables, so that Spark's committer makes retried tasks safe and
any file system will do:

* ``ranks`` (rank, id, n): the ids that occur, most frequent first (ties: smaller id first);
* ``tokens`` (shard, seq, first, doc_id, n_tokens, control, data): one record a document, in
  ascending (doc_id, content) order over shards and within them.  ``first`` counts the ids
  of the shard before the record.  ``data`` holds the rank of every id in 1 to 4 bytes,
  little end first, without gaps; ``control`` holds two bits an id (its bytes less one),
  four ids a byte, the first in the lowest bits.  Unused codes of the last byte are 0.

Decoding looks every control byte up in a table of four lengths; the running sum of the
lengths gives the offsets, and all ids are gathered at once with numpy.

Defined results
---------------
* null or empty text: the end id alone;  * empty table: empty files, no rows;
* null ``doc_id`` sorts first; repeated rows and equal ids stay apart, ordered by content;
* strings of added tokens in a text (``<|endoftext|>``) become those tokens, as the library has it;
* extra columns of ``docs`` aren't written; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Memo, discard, grouped, partitions_for, sole, temporary_path, written

#: Chunks that a worker remembers the ids of before it starts afresh.
CACHE_CHUNKS = 2_000_000
#: Single matches, parts of new chunks, that it remembers.
CACHE_MATCHES = 400_000
#: Characters of texts that are encoded at once, about.
GROUP_BYTES = 32 << 20
#: Marks the rows that carry a task's token counts.
COUNTS = -1

# -- coding ---------------------------------------------------------------------------

_CODES = np.arange(256, dtype=np.uint8)
#: The lengths of the four ids that a control byte describes.
LENGTHS = np.stack([(_CODES >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.int64)


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of every id where each array is padded to fours, first control byte of each array and their number)."""
    fours = -(-counts // 4)
    first = np.concatenate([[0], np.cumsum(fours)])
    starts = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(4 * first[:-1] - starts, counts), first


def encode_many(ranks: np.ndarray, counts: list[int]) -> list[tuple[bytes, bytes]]:
    """(control, data) of each of the arrays of ranks below 2**32 that lie one after another."""
    sizes = np.array(counts, dtype=np.int64)
    ranks = ranks.astype("<u4", copy=False)
    most = max(1, -(-int(ranks.max()).bit_length() // 8)) if len(ranks) else 1
    used, own = np.ones((len(ranks), most), dtype=bool), np.zeros(len(ranks), dtype=np.uint8)
    for k in range(1, most):
        used[:, k] = ranks >= 1 << 8 * k
        own += used[:, k]
    places, first = _padded(sizes)
    codes = np.zeros(4 * first[-1], dtype=np.uint8)
    codes[places] = own
    four = codes.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :most][used].tobytes()
    ends = np.concatenate([[0], np.cumsum(own, dtype=np.int64) + np.arange(1, len(own) + 1)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [(control[first[k] : first[k + 1]], data[ends[k] : ends[k + 1]]) for k in range(len(sizes))]


def decode_many(streams: list[tuple[bytes, bytes]], counts: list[int]) -> np.ndarray:
    """The ranks of all (control, data) of ``counts`` ids each, one after another, by table lookup."""
    places, _ = _padded(np.array(counts, dtype=np.int64))
    lengths = LENGTHS[np.frombuffer(b"".join(x[0] for x in streams), dtype=np.uint8)].reshape(-1)[places]
    raw = np.frombuffer(b"".join(x[1] for x in streams), dtype=np.uint8)
    ends = np.cumsum(lengths)
    if len(ends) and ends[-1] != len(raw):
        raise ValueError("control bytes and data differ in length")
    at = ends - lengths
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << 8 * k
    return out


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    return encode_many(ranks, [len(ranks)])[0]


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    return decode_many([(control, data)], [n])


#: Ids that are coded at once.
GROUP_IDS = 16_000


def _groups(counts: list[int]) -> Iterator[tuple[int, int]]:
    """Slices of consecutive documents with about GROUP_IDS ids each."""
    first = total = 0
    for k, n in enumerate(counts):
        if total and total + n > GROUP_IDS:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(counts):
        yield first, len(counts)


# -- tokenising -----------------------------------------------------------------------

#: White space, in the widest sense of the pattern's and Python's.
_SPACES = "".join(f"\\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace())
#: Some blank of the text follows white space or starts the text.
_SOME_BLANKS = rf"[{_SPACES}] |\A "
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _byte_alphabet() -> dict[int, str]:
    """The byte-level models' rule: visible Latin-1 characters stand for themselves, other bytes for U+0100 onward."""
    seen = {c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or 0xAE <= c}
    return {c: chr(c) for c in seen} | {c: chr(0x100 + k) for k, c in enumerate(sorted(set(range(256)) - seen))}


class ChunkTokenizer:
    """Ids of whole texts, remembering the ids of chunks.

    The byte-level pattern never lets a match run from a character that isn't white space
    into a blank, so a text can be cut before each such blank and every chunk encoded by
    itself: the ids are those of the whole text.  Arrow numbers the chunks of a batch,
    looks them up among those seen before and puts their ids together; only new chunks
    come to Python.  One that is plainly a match or two goes to the library's model, any
    other through its whole tokenizer.

    That holds for byte-level pair encodings without normaliser, prefix blank and further
    steps (``chunked``).  With any other vocabulary file, and for a text that contains the
    string of an added token, the library encodes the whole text.
    """

    def __init__(self, tokenizer_json: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunked = _byte_level(json.loads(tokenizer_json))
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.alphabet = _byte_alphabet()
        self.blank = self.alphabet[0x20]
        self.cut = re.compile(r"(?<=\S) ")
        self.matches: dict[str, bytes] = {}
        self.known = Memo(lambda new: list(map(self.chunk, new)), CACHE_CHUNKS)

    def match(self, piece: str) -> bytes:
        """The ids of a single match of the pattern: the library's model, in its alphabet of bytes."""
        found = self.matches.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                mapped = self.blank + piece[1:] if piece[0] == " " else piece
            else:
                mapped = piece.encode().decode("latin-1").translate(self.alphabet)
            if len(self.matches) >= CACHE_MATCHES:
                self.matches.clear()
            found = self.matches[piece] = array(self.code, [x.id for x in self.tokenize(mapped)]).tobytes()
        return found

    def chunk(self, chunk: str, lead: str = " ") -> bytes:
        """The ids of a chunk and of the blank before it, if any."""
        if chunk.isalpha():
            return self.match(lead + chunk)
        core = chunk.rstrip(_MARKS)
        if not core and chunk:  # marks only
            return self.match(lead + chunk)
        if core.isalpha():  # letters, then marks: two matches
            return self.match(lead + core) + self.match(chunk[len(core) :])
        lines = chunk.split("\n")
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            # A lone line feed between other characters is a match by itself.
            return self.match("\n").join([self.chunk(lines[0], lead), *(self.chunk(x, "") for x in lines[1:])])
        return array(self.code, self.tokenizer.encode(lead + chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array, end_id: int = 0) -> pa.Array:
        """The ids of each text (no nulls) and the end id, as bytes of ``self.code``."""
        end = array(self.code, [end_id]).tobytes()
        if not self.chunked:
            return self._whole(texts, end)
        whole = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        some = pc.match_substring_regex(texts, _SOME_BLANKS).to_numpy(zero_copy_only=False) & ~whole
        if not whole.any() and not some.any():
            return self._gathered(pc.split_pattern(texts, " "), end)
        kinds = np.where(whole, 2, some)
        parts = [texts.filter(pa.array(kinds == k)) for k in range(3)]
        cut = pa.array([self.cut.split(x) for x in parts[1].to_pylist()], pa.list_(pa.string()))
        found = [self._gathered(pc.split_pattern(parts[0], " "), end), self._gathered(cut, end), self._whole(parts[2], end)]
        back = np.argsort(np.argsort(kinds, kind="stable"), kind="stable")
        return pa.concat_arrays(found).take(pa.array(back))

    def _whole(self, texts: pa.Array, end: bytes) -> pa.Array:
        found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
        return pa.array([array(self.code, x.ids).tobytes() + end for x in found], pa.binary())

    def _gathered(self, lists: pa.ListArray, end: bytes) -> pa.Array:
        n = len(lists)
        if not n:
            return pa.array([], pa.binary())
        values, bounds = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        places = self.known.places(values)
        # Texts begin with a chunk that has no blank before it, and end with the end id.
        first = bounds - np.diff(bounds, prepend=0)
        heads = pa.array([self.chunk(x, "") for x in values.take(pa.array(first)).to_pylist()] + [end], pa.binary())
        places[first] = len(self.known.made) + np.arange(n)
        places = np.insert(places, bounds, len(self.known.made) + n)
        flat = pa.concat_arrays([self.known.made, heads]).take(pa.array(places))
        offsets = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset :][np.concatenate([[0], bounds + np.arange(1, n + 1)])]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), flat.buffers()[2]])


def _byte_level(spec: dict) -> bool:
    """Whether texts may be cut at blanks: the plain byte-level pattern and nothing before or behind it."""
    model, before, behind = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("post_processor") or {}
    return (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and behind.get("type") in (None, "ByteLevel")
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    )


_TOKENIZERS: dict[int, ChunkTokenizer] = {}


def _tokenizer(shared) -> ChunkTokenizer:
    """One for each worker and broadcast."""
    sole(_TOKENIZERS)
    if shared.id not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[shared.id] = ChunkTokenizer(shared.value[1])
    return _TOKENIZERS[shared.id]


class _Shared:
    """A broadcast that workers can tell from others."""

    def __init__(self, broadcast, key: str) -> None:
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids, width, tie): the ids of every whole text and the end id, two or four bytes
    each, and a hash of them that orders equal doc_ids.

    A last row of each task has n_tokens ``COUNTS`` and its token counts (eight bytes an id).
    """
    import uuid

    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; a vocabulary file of bounded size
        shared = _Shared(docs.sparkSession.sparkContext.broadcast((tokenizer_path, f.read())), uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(shared)
        width = array(own.code).itemsize
        total = np.zeros(0, dtype=np.int64)
        for batch in grouped(batches, GROUP_BYTES):
            raw = own.encode(batch.column(1).cast(pa.string()).fill_null(""), end_id)
            sizes = pc.divide(pc.binary_length(raw).cast(pa.int64()), width)
            ties = np.fromiter((xxhash.xxh3_64_intdigest(x.as_buffer()) >> 1 for x in raw), dtype=np.int64, count=len(raw))
            yield pa.record_batch([batch.column(0), sizes, raw, pa.array(np.full(len(raw), width, dtype=np.int32)), pa.array(ties)], names=["doc_id", "n_tokens", "ids", "width", "tie"])
            some = np.bincount(_ids(raw.buffers()[2], width)[: pc.sum(sizes).as_py()])
            if len(some) > len(total):
                total = np.concatenate([total, np.zeros(len(some) - len(total), dtype=np.int64)])
            total[: len(some)] += some
        if len(total):
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([COUNTS], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([8], pa.int32()), pa.array([0], pa.int64())], names=["doc_id", "n_tokens", "ids", "width", "tie"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, width int, tie long")


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4")


def frequency_ranks(encoded: DataFrame) -> DataFrame:
    """(rank, id, n): ids by falling frequency; as many rows as the vocabulary has at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = np.frombuffer(raw, dtype=np.int64)
                used = np.flatnonzero(total)
                yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = encoded.where(F.col("n_tokens") == COUNTS).select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((r["id"], r["n"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    return encoded.sparkSession.createDataFrame([(k, i, n) for k, (i, n) in enumerate(rows)], "rank long, id long, n long")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write ``docs`` to ``folder`` in the file format above."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    encoded = written(encode_documents(docs, tokenizer_path, end_id), "token-ids")
    ranks = frequency_ranks(encoded)
    documents = encoded.where(F.col("n_tokens") != COUNTS)
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    found = ranks.collect()
    table = np.zeros(1 + max((r["id"] for r in found), default=0), dtype=np.uint32)
    for r in found:
        table[r["id"]] = r["rank"]
    shared = spark.sparkContext.broadcast(table)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, first, rank_of = TaskContext.get().partitionId(), 0, 0, shared.value
        for batch in batches:
            counts, raws, streams = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            width = batch.column(3)[0].as_py() if counts else 2
            for a, b in _groups(counts):
                streams += encode_many(rank_of[_ids(b"".join(raws[a:b]), width)], counts[a:b])
            firsts = [first, *(first + x for x in accumulate(counts))]
            first = firsts.pop()
            k = len(counts)
            yield pa.record_batch(
                [pa.array([shard] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), pa.array(firsts, pa.int64()), batch.column(0), batch.column(1), pa.array([x[0] for x in streams], pa.binary()), pa.array([x[1] for x in streams], pa.binary())],
                names=["shard", "seq", "first", "doc_id", "n_tokens", "control", "data"],
            )
            seq += k

    # Rows equal in id and text are alike, so any order of theirs will do: a salt lets them be split.
    salted = documents.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(partitions_for(encoded), "doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie")
    coded = dealt.select("doc_id", "n_tokens", "ids", "width").mapInArrow(code, "shard int, seq long, first long, doc_id long, n_tokens long, control binary, data binary")
    coded.write.option("compression", "zstd").parquet(f"{folder}/tokens")
    discard(encoded)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the ids of every document (array), read back from the files."""
    return _read(spark, folder, "ids array<long>", lambda ids: ids.astype(np.int64))


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files."""
    return _read(spark, folder, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4", copy=False)))


def _read(spark: SparkSession, folder: str, column: str, make) -> DataFrame:
    tokens = spark.read.parquet(f"{folder}/tokens")
    name, kind = column.split(" ", 1)
    kind_of = pa.list_(pa.int64()) if kind.startswith("array") else pa.int64()
    base, before = {}, 0
    for r in tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # a row a file
        base[r["shard"]] = before
        before += r["n"]
    found = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # as many as the vocabulary at most
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in found], dtype=np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for batch in batches:
            shards, firsts, counts, control, data = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            out = []
            for a, b in _groups(counts):
                ids = id_of[decode_many(list(zip(control[a:b], data[a:b])), counts[a:b])]
                ends = [0, *accumulate(counts[a:b])]
                out += [make(ids[x:y]) for x, y in zip(ends, ends[1:])]
            starts = [base[s] + f for s, f in zip(shards, firsts)]
            yield pa.record_batch([batch.column(2), pa.array(starts, pa.int64()), batch.column(3), pa.array(out, kind_of)], names=["doc_id", "start", "n_tokens", name])

    return tokens.select("shard", "first", "doc_id", "n_tokens", "control", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` (a temporary one by default) and return the digest of what the files hold."""
    folder = folder or temporary_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer_path, end_id)
    return token_digest(docs.sparkSession, folder)
