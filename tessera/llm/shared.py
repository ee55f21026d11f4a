"""What the operators of this subpackage share: the shared folder, Arrow batching, words, stable hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and a Python worker; a batch of documents of
#: 100 kB each stays near 25 MB.
ARROW_ROWS = 256


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, and ship this package to them once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        here = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera-package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(here.rglob("*.py")):
                out.write(path, path.relative_to(here.parent))
        context.addPyFile(str(archive))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where it is
    unset and one machine runs everything."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            current = spark.sparkContext.getCheckpointDir()
        root = current
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Folders made since the application began, in order.
_MADE: list[str] = []


def temporary_path(spark: SparkSession, name: str) -> str:
    """A folder to be, gone with the application at the latest: what a lazy result still reads can't be deleted before."""
    path = shared_path(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = temporary_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def made() -> int:
    """How many temporary folders were made so far."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the temporary folders made after the first ``since``, but for that of ``keep``."""
    kept = getattr(keep, "_tessera_path", None)
    for path in _MADE[since:]:
        if path != kept:
            _delete(spark, path)
    _MADE[since:] = [kept] if kept in _MADE[since:] else []


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over the cores where it comes in fewer pieces than there are cores."""
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and out._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores:
        return out.repartition(cores)
    return out


#: Bytes of a stored table that one task of an explicit repartitioning takes.
TASK_BYTES = 64 << 20


def partitions_for(df: DataFrame, times: float = 1.0) -> int:
    """Partitions of an explicit repartitioning of ``times`` the bytes of a table made by :func:`written`:
    the session's own setting, or more where a task would get more than ``TASK_BYTES``."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    size = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size * times) // TASK_BYTES + 1)


_CACHES: list[dict] = []


def sole(cache: dict) -> None:
    """Let ``cache`` be the only large one of this worker: others, of operators that ran before, are emptied."""
    for other in _CACHES:
        if other is not cache:
            other.clear()
    if not any(x is cache for x in _CACHES):
        _CACHES.append(cache)


def text_key(column: str = "text") -> dict[str, Column]:
    """k1 and k2, 128 bits that stand for a text (null as empty)."""
    text = F.coalesce(F.col(column), F.lit(""))
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def id_key() -> dict[str, Column]:
    """d0 and d1, which stand for a document's id (long) without nulls."""
    return {"d0": F.col("doc_id").isNull().cast("int"), "d1": F.coalesce("doc_id", F.lit(0).cast("long"))}


#: The columns of :func:`row_key`.
ROW_KEY = ["k1", "k2", "d0", "d1"]


def row_key() -> dict[str, Column]:
    """Columns without nulls that stand for a document's id (long) and text: joins on them keep one partitioning."""
    return text_key() | id_key()


#: Bits of a sieve for each key, and of the largest sieve (32 MB): beyond that more rows pass for nothing.
SIEVE_BITS = 16
SIEVE_MOST = 1 << 28


def sifted(df: DataFrame, keys: DataFrame, on: tuple[str, ...] = tuple(ROW_KEY)) -> DataFrame:
    """``df`` and a column _may, false only where the row's columns ``on``, without nulls, are none of ``keys``
    (without repeats, read twice).

    A bitmap of the keys' hashes, in pieces of 2^15 bits, is broadcast; about one other row in ``SIEVE_BITS`` passes too."""
    bits = min(SIEVE_MOST, max(1 << 15, SIEVE_BITS * keys.count()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    piece, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    sieve = keys.select(piece.alias("_piece"), bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return df.withColumn("_piece", piece).join(F.broadcast(sieve), "_piece", "left").withColumn("_may", may).drop("_piece", "_bits")


class Memo:
    """Pieces of text -> bytes, remembered as Arrow arrays: what ``make`` says of pieces not seen before."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int) -> None:
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.pieces, self.made = pa.array([], pa.string()), pa.array([], pa.binary())

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place in ``made`` of each of ``pieces`` (repeats allowed); good until the next call."""
        if len(self.pieces) > self.most:
            self.clear()
        coded = pieces.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.pieces)
        new = coded.dictionary.filter(pc.is_null(found))
        out = found.fill_null(0).to_numpy().copy()
        if len(new):
            out[found.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            made = pa.array(self.make(new.to_pylist()), pa.binary())
            self.pieces, self.made = pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.made, made])
        return out[coded.indices.to_numpy()]


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, first word of each text and their number); a word is
    a run of characters other than space and \\x09-\\x0D.  Arrow finds the distinct words of the batch."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    known = np.array([digest(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
    real = pc.binary_length(coded.dictionary).to_numpy() > 0  # white space at either end leaves an empty piece
    at = coded.indices.to_numpy()
    kept = real[at] if len(at) else np.zeros(0, dtype=bool)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    bounds = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    return known[at[kept]], bounds


def plain_texts(column) -> pa.Array:
    """An Arrow string column, null as empty."""
    return column.cast(pa.string()).fill_null("")


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]
