"""Token ids in Arrow files of equal-length sequences, and their random-access reader.

Documents go out in ascending id order, cut into shards of some ``SHARD_IDS`` ids, and a shard is one Arrow IPC file. Its record
batches have the columns ``tokens`` and ``mask``, both fixed-size lists of ``sequence_length`` entries, so sequence k of a
shard lies in batch ``k // SEQUENCES_PER_BATCH`` and is read without copying. The mask is true on real ids and false on the filling
of a shard's last sequence. The schema's metadata hold, under ``documents``, an Arrow stream of each document's id and number
of ids. Ids take 16 bits if the vocabulary allows, else 32. A shard's folder names its number, documents and ids
(``shard=3/n_docs=700/n_ids=90000``), so what lies before it is known from listing alone.

Files are written and read by Spark's own sources, so any folder that Spark opens will do, and a task that runs again or is
lost leaves nothing behind. The text source writes bytes as they are, and a separator after each row; a row is a whole Arrow
file but for its last six bytes, and the separator is these.

Defined cases: a null text counts as empty and yields the end id alone; documents with one id stay
apart, and a null id sorts first; an empty table writes no shard; other columns are not read. A document lies in one shard
whole, so one document's ids take less than 2 GB, as its text does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import new_path
from .tokenizing import encoded

SEQUENCES_PER_BATCH = 256
#: A shard ends with the slice of documents that brings it to either; 16-bit ids and masks of so many take 36 MB.
SHARD_IDS, SHARD_DOCUMENTS = 1 << 24, 1 << 19
#: Shards up to which their starts are broadcast, 16 bytes each; the files are shuffled beyond.
BROADCAST_SHARDS = 2_000_000
#: What every Arrow file ends with.
END = b"ARROW1"
_PER_TASK = 1 << 32


class _Shard:
    """Documents' ids in, one Arrow file out."""

    def __init__(self, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.n_ids = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.ids.append(ids.astype(self.dtype))
        self.counts.append(counts)
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(counts)

    def _documents(self) -> bytes:
        index = pa.table({"doc_id": pa.chunked_array(self.doc_ids, pa.int64()), "n_ids": np.concatenate(self.counts).astype(np.int64)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index.combine_chunks())
        return sink.getvalue().to_pybytes()

    def file(self) -> pa.Buffer:
        ids = np.concatenate(self.ids)
        self.ids = []
        fields = [("tokens", pa.list_(pa.from_numpy_dtype(self.dtype), self.length)), ("mask", pa.list_(pa.bool_(), self.length))]
        schema = pa.schema(fields, {"documents": self._documents()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, schema) as out:
            for at in range(0, len(ids), SEQUENCES_PER_BATCH * self.length):
                run = ids[at : at + SEQUENCES_PER_BATCH * self.length]
                rows = -(-len(run) // self.length)
                values, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
                values[: len(run)], mask[: len(run)] = run, True
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
                out.write_batch(pa.record_batch(lists, schema=schema))
        return sink.getvalue()

    def row(self, shard: int) -> pa.RecordBatch:
        file = self.file()
        if file[-len(END) :].to_pybytes() != END:
            raise ValueError("an Arrow file ends otherwise than known here")
        cut = file.slice(0, file.size - len(END))
        column = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, cut.size], np.int32)), cut])
        numbers = [pa.array([n], pa.int64()) for n in (shard, self.n_docs, self.n_ids)]
        return pa.record_batch([*numbers, column], names=["shard", "n_docs", "n_ids", "file"])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int, sequence_length: int = 2048, id_column: str = "doc_id", text_column: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents' ids below ``folder``, which must not exist, and returns its manifest, a row for each shard."""
    dtype = np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * _PER_TASK
        shard = _Shard(sequence_length, dtype)
        for batch in batches:
            for lo, hi, ids, counts in encoded(batch.column(1), tokenizer_path, end_id):
                shard.add(batch.column(0)[lo:hi], ids, counts)
                if shard.n_ids >= shard_ids or shard.n_docs >= SHARD_DOCUMENTS:
                    yield shard.row(number)
                    shard, number = _Shard(sequence_length, dtype), number + 1
        if shard.n_docs:
            yield shard.row(number)

    ordered = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(write, "shard long, n_docs long, n_ids long, file binary").withColumn("file", F.col("file").cast("string"))
    rows.write.partitionBy("shard", "n_docs", "n_ids").options(lineSep=END.decode(), compression="none").text(folder)
    return manifest(docs.sparkSession, folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="part-*").load(folder)
    named = [F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("long").alias(name) for name in ("shard", "n_docs", "n_ids")]
    return files.select(*named, "path", "content")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """shard, n_docs, n_ids and path of each shard below a folder, by their names; no file is opened."""
    return _files(spark, folder).drop("content")


def shard_bases(shards: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids in all shards before: one row a shard, so one small window."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class ShardReader:
    """Random access to the ids of one shard, batch by batch, without copying within a batch."""

    def __init__(self, source: str | bytes | pa.Buffer):
        """``source``: a file's bytes, or the path of a file on this machine, which is mapped."""
        self.file = pa.ipc.open_file(pa.memory_map(source.removeprefix("file:")) if isinstance(source, str) else source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.step = SEQUENCES_PER_BATCH * self.length
        self.at, self.values = -1, None

    def documents(self) -> pa.Table:
        """doc_id and n_ids of the shard's documents, in their order."""
        return pa.ipc.open_stream(self.file.schema.metadata[b"documents"]).read_all()

    def _batch(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.values = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.values

    def ids(self, start: int, n: int) -> np.ndarray:
        runs, end = [], start + n
        while start < end:
            k, at = divmod(start, self.step)
            runs.append(self._batch(k)[at : at + end - start])
            start += len(runs[-1])
        return runs[0] if len(runs) == 1 else np.concatenate(runs)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k`` of the shard."""
        b, row = divmod(k, SEQUENCES_PER_BATCH)
        batch = self.file.get_batch(b)
        cut = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)[cut], batch.column(1).flatten().to_numpy(zero_copy_only=False)[cut]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start over all shards, n_tokens and ids (little-endian unsigned 32 bits) of each document, from the files below a folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = ShardReader(content.as_buffer())
                documents = shard.documents()
                doc_ids, counts = documents.column(0).combine_chunks(), documents.column(1).to_numpy()
                starts = np.cumsum(counts) - counts
                for lo in range(0, len(starts), 512):
                    cut = slice(lo, lo + 512)
                    ids = [shard.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts[cut].tolist(), counts[cut].tolist())]
                    yield pa.record_batch([doc_ids[cut], pa.array(starts[cut] + base), pa.array(counts[cut]), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    shards = manifest(spark, folder)
    bases = shard_bases(shards).select("shard", "base")
    if shards.count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)
    return _files(spark, folder).join(bases, "shard").select("content", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Writes, reads back and digests all documents."""
    folder = new_path(spark, "token-shards")
    write_tokens(docs, folder, tokenizer_path, end_id, vocabulary)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
