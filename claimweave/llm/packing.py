"""Packing by concatenating and cutting: all ids form one stream, cut into windows of equal length.

Pass 1 tokenises each partition and stores, for each document, its ids and its start within the
partition. The partitions' totals, a row each, give prefix sums and so every document's global
start. Pass 2 cuts at the multiples of the window: a document that crosses a border leaves a
boundary record on each side. Only the last window can be short, so padding is less than one window.

Defined cases: a null text counts as empty and yields the end id alone; documents with one id stay
apart; an empty table yields no piece; other columns are not read; a text longer than a window
takes as many pieces as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .tokenizing import encoded

STORED = "part int, doc_id long, local_start long, n_ids long, ids binary"
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ROWS = 256


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pass 1: ids (little-endian, 16 bits while they fit, else 32) and the start within the partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, hi, ids, counts in encoded(batch.column(1), tokenizer_path, end_id):
                stops = np.cumsum(counts)
                wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
                raw = [x.astype("<u4" if wide else "<u2").tobytes() for x in np.split(ids, stops[:-1])]
                yield pa.record_batch([pa.array(np.full(hi - lo, part, np.int32)), doc_ids[lo:hi], pa.array(at + stops - counts), pa.array(counts), pa.array(raw, pa.binary())], names=["part", "doc_id", "local_start", "n_ids", "ids"])
                at += int(stops[-1])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(encode, STORED)


def cut(tokens: DataFrame, window: int) -> DataFrame:
    """Pass 2: pieces of stored documents that have a global start."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                rows = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
                for doc_id, begin, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(begin + start, window)
                        length = min(window - offset, n - start)
                        for k, v in (("doc_id", doc_id), ("start", start), ("length", length), ("ids", ids[start : start + length].tobytes()), ("doc_tokens", n), ("sequence_id", sequence), ("offset", offset)):
                            rows[k].append(v)
                        start += length
                if rows["start"]:
                    yield pa.record_batch([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], names=list(rows))

    return tokens.select("doc_id", "global_start", "n_ids", "ids").mapInArrow(pieces, PIECE)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents with their ids; each id lies in exactly one, and each window is gapless from 0."""
    tokens = stored(tokenized(docs, tokenizer_path, end_id, id_column, text_column), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row for each task of pass 1, whatever the rows: small enough for every executor.
    placed = tokens.join(F.broadcast(bases), "part").withColumn("global_start", F.col("base") + F.col("local_start"))
    return cut(placed, window)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
