"""Exact Jaccard self-join of shingle sets by PartEnum signatures, and the groups that its links form.

Sizes fall in bands whose bounds rise by 4/3, so sets that can link lie in one band or in two in a
row, and instance j joins bands j - 1 and j. Links have a Hamming distance of at most d = (|a| + |b|) / 7.
An instance cuts the domain of features in partitions, and each of these in three parts; a signature
is a set's features in two of a partition's three parts. A partition in which two sets are equal gives
three common signatures, one with a single difference gives one, so sets at distance d have at least
3p - 2d of them in common for d <= p partitions and 2p - d beyond. A quarter more partitions than one
common signature asks for let each set leave out its weakest ones, all but one of that number: if all
sets order signatures alike, the first common one stays on both sides. Weak are those that hold few
features which aren't frequent, so a passage that a third of all documents share makes no signature
where others suffice.

Work on all texts stays in the tasks that read them: 5-byte signatures with document numbers, packed
by bucket, are all that is shuffled, and the groups of a signature with two documents or more all
that is kept. A signature that is frequent in a task goes to its bucket once, and its documents to
many others. Copies of one set count once. First each document is compared with a few partners, the
smallest of most of its groups under as many orders. Documents of groups that aren't yet one component
then form families around the largest component of most of their groups; a group that several families
meet in is one more family. Parity sketches as long as the sets ask, whose distance never exceeds the
sets', are packed in blocks and compared block by block within a family. What the sketches can't tell
apart is compared by whole sets. No pair is left out and none is needed inside a component.

Frequencies are collected from all documents, and a bounded list of the most frequent goes to the
tasks; they set the order of signatures only, and any order gives the same result.

Defined cases: null texts and texts without words have empty sets and link with nothing; fewer than
five words make one shingle; documents with one id are one document for their links, each with its
own size; a null id links with nothing and has a null component; ids are any longs; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .components import components
from .shingles import linked, shingle_sets
from .storage import dropped, stored

tb.mapped_apart()  # workers outlive their tasks

#: A shingle is frequent in this share of documents, or in FREQUENT_LEAST if that is more; so many are listed at most.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 0.003, 24, 500_000
#: Documents, or shingles if these are more than 500 a document, that a task counts over at a time; it reports shingles in FREQUENT_HERE of the documents.
COUNTED, COUNTED_SHINGLES, FREQUENT_HERE = 1_000, 500_000, 8
#: Parts of a partition, and how many more partitions there are than one common signature asks for.
PARTS, SLACK = 3, 0.25
BUCKET_ROWS, FLUSH_ROWS = 500_000, 500_000
#: A signature that more documents of a flush have than keep buckets to a few BUCKET_ROWS, and than this, goes to its bucket once.
HOT_LEAST = 8
#: Partners that each set is compared with first: under so many orders, the set that is smallest in most of its groups.
PARTNERS = 3
#: Bits of the sketch for each shingle.
FINE_BITS = 4
#: Sets and bytes of sketches in a block.
BLOCK_SETS, BLOCK_BYTES = 256, 64 << 10
#: Bits of the filter of needed documents: 256 rows of 4 KB at most.
FILTER_BLOCKS = 2048


def _bounds() -> np.ndarray:
    at = [1]
    while at[-1] < 1 << 40:
        at.append(max(at[-1] + 1, ceil(Fraction(4, 3) * at[-1])))
    return np.array(at)


BOUNDS = _bounds()


def _odd(k: int) -> np.uint64:
    return tb.mix(np.array([k], np.uint64))[0] | np.uint64(1)


def instances(size: int) -> list[tuple[int, int, int]]:
    """(instance, role, d): role 0 in the own band's, 1 as the smaller set in the next; d is the largest distance of a link there."""
    band = int(np.searchsorted(BOUNDS, size, side="right")) - 1
    most = 4 * size // 3
    out = [(band, 0, (size + min(most, int(BOUNDS[band + 1]) - 1)) // 7)]
    if most >= BOUNDS[band + 1]:
        out.append((band + 1, 1, (size + most) // 7))
    return out


def partitions(instance: int) -> int:
    """So many that two sets of the instance have a common signature at any distance of a link, and SLACK more."""
    enough = 2 * (int(BOUNDS[instance + 1]) - 1) // 7 // 2 + 1
    return enough + int(SLACK * enough)


def least_common(p: int, d: int) -> int:
    """Signatures that two sets at distance d have in common at least, over p partitions."""
    return PARTS * p - (PARTS - 1) * d if d <= p else 2 * p - d


@lru_cache(256)
def _tags(instance: int) -> np.ndarray:
    return np.arange(PARTS * partitions(instance), dtype=np.uint64) * _odd(97) + tb.mix(np.array([instance], np.uint64))


def signatures(own: np.ndarray, rare: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(role, signatures) of a set in its instances; ``rare`` has 0 for each frequent feature and 1 for the others."""
    out = []
    for instance, role, d in instances(len(own)):
        if not d:
            continue  # only equal sets could link here
        p = partitions(instance)
        cell = ((own * _odd(2 * instance)) >> np.uint64(20)) % np.uint64(PARTS * p)
        order = np.argsort(cell.astype(np.uint16 if PARTS * p < 1 << 16 else np.uint32), kind="stable")
        at = cell[order]
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        sums = np.zeros(PARTS * p, np.uint64)
        sums[at[cuts]] = np.add.reduceat((own * _odd(2 * instance + 1))[order], cuts)
        held = np.bincount(cell.astype(np.int64), weights=rare, minlength=PARTS * p).reshape(p, PARTS)
        sums = sums.reshape(p, PARTS)
        values = tb.mix((sums.sum(axis=1, dtype=np.uint64, keepdims=True) - sums).ravel() + _tags(instance))
        kept = PARTS * p - least_common(p, d) + 1
        if kept < len(values):
            strength = np.minimum((held.sum(axis=1, keepdims=True) - held).ravel(), 255).astype(np.uint64)
            rank = ((np.uint64(255) - strength) << np.uint64(56)) | (values >> np.uint64(8))
            values = values[np.argpartition(rank, kept - 1)[:kept]]
        out.append((role, values))
    return out


def parities(own: np.ndarray) -> bytes:
    """Parities by the low bits of the hashes; a power of two of at least FINE_BITS for each."""
    size = max(512, 1 << (FINE_BITS * len(own) - 1).bit_length())
    counts = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities at a shorter length."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(x: bytes | pa.Buffer, y: bytes | pa.Buffer) -> int:
    """At most the distance of two sets, by their parities; the longer is folded to the shorter's length."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(dtype=np.int64))


def measured(docs: DataFrame) -> DataFrame:
    """kind 0: a row for each document (size, two keys of its set, parities); kind 1: a shingle and how often it was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n_held = 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(FREQUENT_HERE, len(held) // 100)
            m = int(often.sum())
            zero = pa.array(np.zeros(m, np.int64))
            return pa.record_batch([pa.array(np.ones(m, np.int32)), zero, pa.array(counts[often].astype(np.int64)), pa.array(values[often].view(np.int64)), zero, pa.nulls(m, pa.binary())], names=names)

        names = ["kind", "doc_id", "n", "key1", "key2", "bits"]
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets)
                n = np.array([len(s) for s in sets], np.int64)
                key1 = np.array([tb.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                key2 = np.array([(s * (s >> np.uint64(32) | np.uint64(1))).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                bits = pa.array([parities(s) if len(s) else None for s in sets], pa.binary())
                yield pa.record_batch([pa.array(np.zeros(hi - lo, np.int32)), batch.column(0)[lo:hi], pa.array(n), pa.array(key1), pa.array(key2), bits], names=names)
                for s, k in zip(sets, key1.tolist()):
                    if k not in seen:
                        seen.add(k)
                        held.append(s)
                        n_held += len(s)
                if len(held) >= COUNTED or n_held >= COUNTED_SHINGLES and len(held) >= FREQUENT_HERE:
                    yield frequent()
                    held.clear()
                    seen.clear()
                    n_held = 0
        if len(held) >= FREQUENT_HERE:
            yield frequent()

    return docs.mapInArrow(run, "kind int, doc_id long, n long, key1 long, key2 long, bits binary")


def frequent_shingles(all_measured: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted; at most FREQUENT_MOST."""
    n_docs = all_measured.where("kind = 0").count()
    met = all_measured.where("kind = 1").groupBy("key1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(FREQUENT_LEAST, FREQUENT_SHARE * n_docs))
    return np.sort(met.orderBy(F.desc("n"), "key1").limit(FREQUENT_MOST).select("key1").toArrow().column(0).to_numpy().view(np.uint64))


def signature_groups(docs: DataFrame, frequent: np.ndarray, n_buckets: int, hot_rows: int, wide: bool) -> DataFrame:
    """(gid, doc): the documents of each signature that two or more have; equal groups of a bucket once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    number = np.dtype("<u8" if wide else "<u4")

    def planes(values: np.ndarray, width: int) -> np.ndarray:
        return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]

    def rows_of(bucket: np.ndarray, values: np.ndarray, width: int, who: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        spans = list(zip(cuts, np.append(cuts[1:], len(bucket))))
        shown, owner = planes(values, width), planes(who, number.itemsize)
        return pa.record_batch([
            pa.array(bucket[cuts].astype(np.int32)), pa.array([shown[a:b].T.tobytes() for a, b in spans], pa.binary()), pa.array([owner[a:b].T.tobytes() for a, b in spans], pa.binary()),
        ], names=["bucket", "signatures", "docs"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        rows = 0

        def packed() -> Iterator[pa.RecordBatch]:
            """Signatures (39 bits and the role's) by bucket; those of hot ones by gid, dealt to as many buckets more."""
            values, who = np.concatenate(held), np.concatenate(owners)
            bucket = ((values >> np.uint64(40)) * np.uint64(n_buckets)) >> np.uint64(24)
            order = np.argsort(values, kind="stable")  # by bucket too, as that is their highest bits
            values, who, bucket = values[order] & np.uint64((1 << 40) - 1), who[order], bucket[order]
            key = (bucket << np.uint64(39)) | (values >> np.uint64(1))
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lengths = np.diff(np.append(cuts, len(key)))
            hot = lengths >= hot_rows
            if hot.any():
                of_hot = np.repeat(hot, lengths)
                dealt = np.uint64(n_buckets) + tb.mix(key[of_hot] ^ (who[of_hot] * _odd(3))) % np.uint64(n_buckets)
                by = np.argsort(dealt, kind="stable")
                yield rows_of(dealt[by], key[of_hot][by], 8, who[of_hot][by])
                values[cuts[hot]] &= ~np.uint64(1)
                keep = ~of_hot
                keep[cuts[hot]] = True
                values, who, bucket = values[keep], who[keep], bucket[keep]
            yield rows_of(bucket, values, 5, who)

        for batch in batches:
            for lo, _, data, offsets in tb.text_slices(batch.column(1)):
                ids = batch.column(0)[lo : lo + len(offsets) - 1].to_numpy().view(np.uint64)
                sets = shingle_sets(data, offsets)
                flat = np.concatenate(sets)
                rare = np.ones(len(flat))
                if len(keys):
                    rare[keys[np.minimum(np.searchsorted(keys, flat), len(keys) - 1)] == flat] = 0
                at = 0
                for doc, own in zip(ids, sets):
                    at += len(own)
                    key = hash((len(own), int(own.sum(dtype=np.uint64)), int(tb.mix(own).sum(dtype=np.uint64))))
                    if not len(own) or key in seen:
                        continue
                    seen.add(key)
                    for role, values in signatures(own, rare[at - len(own) : at]):
                        held.append((values & ~np.uint64(1)) | np.uint64(role))
                        owners.append(np.full(len(values), doc, np.uint64))
                        rows += len(values)
                if rows >= FLUSH_ROWS:
                    yield from packed()
                    held, owners, rows = [], [], 0
                    seen.clear()
        if rows:
            yield from packed()

    def unpacked(blobs: list[bytes], width: int) -> np.ndarray:
        out = []
        for blob in blobs:
            shown = np.frombuffer(blob, np.uint8).reshape(width, -1)
            padded = np.zeros((shown.shape[1], 8), np.uint8)
            padded[:, :width] = shown.T
            out.append(padded.view("<u8")[:, 0])
        return np.concatenate(out)

    def gather(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        who = unpacked(rows.column("docs").to_pylist(), number.itemsize)
        if bucket >= n_buckets:
            gid = unpacked(rows.column("signatures").to_pylist(), 8)
            return pa.table({"gid": pa.array(gid.view(np.int64)), "doc": pa.array(who.view(np.int64))})
        values = unpacked(rows.column("signatures").to_pylist(), 5)
        order = np.argsort(values, kind="stable")
        values, who = values[order], who[order]
        own_role, values = (values & np.uint64(1)) == 0, values >> np.uint64(1)
        same = np.append(False, values[1:] == values[:-1])
        several = same.copy()
        several[:-1] |= same[1:]
        values, who, own_role = values[several], who[several], own_role[several]
        gid, doc = (np.zeros(0, np.uint64),) * 2
        if len(values):
            cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            lengths = np.diff(np.append(cuts, len(values)))
            members = np.add.reduceat(tb.mix(who), cuts) + lengths.astype(np.uint64)
            good = np.flatnonzero((np.minimum.reduceat(who, cuts) < np.maximum.reduceat(who, cuts)) & np.logical_or.reduceat(own_role, cuts))
            good = good[np.unique(members[good], return_index=True)[1]]
            gid = np.repeat((np.uint64(bucket) << np.uint64(39)) | values[cuts[good]], lengths[good])
            doc = who[tb.ragged(cuts[good], lengths[good])]
        tb.released()
        return pa.table({"gid": pa.array(gid.view(np.int64)), "doc": pa.array(doc.view(np.int64))})

    blobs = docs.mapInArrow(emit, "bucket int, signatures binary, docs binary")
    return blobs.groupBy("bucket").applyInArrow(gather, "gid long, doc long")


def bit_filtered(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The documents whose id may be needed, by a bitmap of at most FILTER_BLOCKS rows of 4 KB: none that is needed goes."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BLOCKS * 32768))
    bits = needed.select(place("doc_id").alias("p")).groupBy((F.expr("p div 32768")).alias("block")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bits"))
    placed = docs.withColumn("p", place("doc_id")).withColumn("block", F.expr("p div 32768"))
    test = F.expr("(cast(conv(hex(substring(bits, cast((p % 32768) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(p % 8 as int))) != 0")
    return placed.join(F.broadcast(bits), "block").where(test).select("doc_id", "text")


def possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) without those whose sizes or sketches lie farther apart than linked sets can."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k) for k in range(2, 6)))
            yield batch.select([0, 1]).filter(pa.array([7 * apart(x.as_buffer(), y.as_buffer()) <= n.as_py() + m.as_py() for n, x, m, y in rows], pa.bool_()))

    left, right = (marks.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    near = pairs.join(right, "b").join(left, "a").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return near.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(check, "a long, b long").distinct()


def blocks(rows: DataFrame) -> DataFrame:
    """(family, rep, component, n, bits) packed: consecutive sets of a family by component and size, with the block's ranges.

    Ranges deal the rows, so a large family lies in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            family, reps, parts, sizes, marks = zip(*held)
            columns = [[family[0]], [min(parts)], [max(parts)], [min(sizes)], [max(sizes)], [min(zip(parts, sizes, reps))[2]]]
            blobs = [np.array(v, np.int64).tobytes() for v in (reps, parts, sizes, [len(m) for m in marks])] + [b"".join(marks)]
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), *(pa.array([b], pa.binary()) for b in blobs)], names=names)

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 512) for r in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns))):
                if held and (row[0] != held[0][0] or len(held) == BLOCK_SETS or size + len(row[4]) > BLOCK_BYTES):
                    yield packed()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield packed()

    names = ["family", "low", "high", "least", "most", "first", "reps", "parts", "sizes", "lengths", "marks"]
    dealt = rows.select("family", "rep", "component", "n", "bits").repartitionByRange("family", "component", "n", "rep").sortWithinPartitions("family", "component", "n", "rep")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names[:6]) + ", " + ", ".join(f"{c} binary" for c in names[6:]))


def met_in_families(packed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a family in different components that sizes and sketches don't tell apart."""
    blobs = ["reps", "parts", "sizes", "lengths", "marks"]

    def opened(row: list[pa.Buffer]) -> list[tuple]:
        """(reps, components, sizes, parities) by length of the parities."""
        reps, parts, sizes, lengths = (np.frombuffer(v, np.int64) for v in row[:4])
        marks, starts, out = np.frombuffer(row[4], np.uint8), np.cumsum(lengths) - lengths, []
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            bits = marks[(starts[own][:, None] + np.arange(length)).ravel()].view(np.uint64).reshape(len(own), -1)
            out.append((reps[own], parts[own], sizes[own], bits))
        return out

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_buffer() for c in batch.columns]
                left, right = opened(row[:5]), opened(row[5:])
                found: list[np.ndarray] = []
                for reps_a, parts_a, n_a, bits_a in left:
                    for reps_b, parts_b, n_b, bits_b in right:
                        words = min(bits_a.shape[1], bits_b.shape[1])
                        total = n_a[:, None] + n_b
                        may = (parts_a[:, None] != parts_b) & (7 * np.minimum(n_a[:, None], n_b) >= 3 * total)
                        own = np.flatnonzero(may.any(axis=1))
                        if not len(own):
                            continue
                        a, b = folded(bits_a, words)[own], folded(bits_b, words)
                        distance = np.zeros((len(own), len(n_b)), np.int64)
                        for at in range(0, words, 64):
                            distance += np.bitwise_count(a[:, None, at : at + 64] ^ b[None, :, at : at + 64]).sum(axis=2, dtype=np.int64)
                        i, j = np.nonzero(may[own] & (7 * distance <= total[own]))
                        pair = np.stack([reps_a[own][i], reps_b[j]])
                        found.append(np.stack([pair.min(axis=0), pair.max(axis=0)]))
                pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
                if pairs.shape[1]:
                    yield pa.record_batch([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], names=["a", "b"])

    x, y = packed.alias("x"), packed.alias("y")
    met = (
        (F.col("x.family") == F.col("y.family")) & F.expr("struct(x.low, x.least, x.first) <= struct(y.low, y.least, y.first)")
        & F.expr("NOT (x.low = x.high AND y.low = y.high AND x.low = y.low) AND 4 * x.most >= 3 * y.least AND 4 * y.most >= 3 * x.least")
    )
    both = x.join(y, met).select(*(F.col(f"x.{c}").alias(f"{c}_x") for c in blobs), *(F.col(f"y.{c}").alias(f"{c}_y") for c in blobs))
    return both.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v), stored: of stored pairs (a, b) those whose whole sets link; only the sets of their documents are moved, as sorted hashes."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(1)):
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())], names=["doc_id", "own"])

    sets = stored(bit_filtered(docs, ids).mapInArrow(hashed, "doc_id long, own binary"), "jaccard-verified")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2), batch.column(3))
            yield batch.select([0, 1]).filter(pa.array([linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in row)) for row in rows], pa.bool_()))

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("own").alias("own_a")), sets.select(F.col("doc_id").alias("b"), F.col("own").alias("own_b"))
    links = stored(pairs.join(right, "b").join(left, "a").select("a", "b", "own_a", "own_b").mapInArrow(check, "a long, b long"), "jaccard-links")
    dropped(pairs, sets)
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def first_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each set with a few partners, under each order (the bits of the id, some flipped) the smallest of most of its groups.

    Groups by chance differ in their smallest sets, those of near copies agree."""
    flips = [int(v) for v in tb.mix(np.arange(PARTNERS, dtype=np.uint64)) & np.uint64((1 << 62) - 1)]
    flipped = lambda k: F.col("rep").bitwiseXOR(F.lit(flips[k]))
    least = members.groupBy("gid").agg(*(F.min(flipped(k)).alias(f"m{k}") for k in range(PARTNERS)))
    seen = [F.when(F.col(f"m{k}") != flipped(k), F.struct(F.lit(k).alias("k"), F.col(f"m{k}").bitwiseXOR(F.lit(flips[k])).alias("center"))) for k in range(PARTNERS)]
    votes = members.join(least, "gid").select("rep", F.explode(F.array_compact(F.array(*seen))).alias("v")).groupBy("rep", "v.k", "v.center").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("rep", "k").agg(F.max_by("center", F.struct("n", "center")).alias("center"))
    return chosen.select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()


def second_pairs(members: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b): what sizes and sketches can't tell apart of sets with a common signature in different components."""
    placed = stored(members.join(found, members["rep"] == found["node"], "left").select("gid", "rep", F.coalesce("component", "rep").alias("component")), "jaccard-placed")
    largest = lambda c: F.max_by(c, F.struct("n", F.negative(F.col(c))))
    hubs = placed.groupBy("gid", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("gid").agg(largest("component").alias("hub"), F.count(F.lit(1)).alias("met")).where("met > 1")
    still = stored(placed.join(hubs, "gid").select("gid", "rep", "component", "hub"), "jaccard-open")
    families = still.groupBy("rep", "component", "hub").agg(F.count(F.lit(1)).alias("n")).groupBy("rep", "component").agg(largest("hub").alias("family"))
    families = stored(families, "jaccard-families")

    # Groups of two families or more are compared as a family each.
    named = still.select("gid", "rep").join(families, "rep")
    mixed = named.groupBy("gid").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low < high").select("gid")
    across = stored(named.join(mixed, "gid").select(F.col("gid").alias("family"), "rep", "component"), "jaccard-across")
    by_block = [stored(blocks(rows.join(marks, "rep")), "jaccard-blocks") for rows in (families, across)]
    found_pairs = stored(met_in_families(by_block[0]).union(met_in_families(by_block[1])).distinct(), "jaccard-second")
    dropped(placed, still, families, across, *by_block)
    return found_pairs


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    everything = stored(measured(rows), "jaccard-measured")
    sizes = everything.where("kind = 0")
    sets = sizes.where("n > 0 AND doc_id IS NOT NULL")

    by_set = ["key1", "key2", "n"]
    reps = sets.groupBy(*by_set).agg(F.min("doc_id").alias("rep"))
    named = stored(sets.select("doc_id", *by_set).join(reps, by_set).select("doc_id", "rep").distinct(), "jaccard-sets")

    total, largest, smallest = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0)), F.coalesce(F.min("doc_id"), F.lit(0))).first()
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS + 1)
    hot_rows = max(HOT_LEAST, BUCKET_ROWS // (total // FLUSH_ROWS + 1))
    groups = signature_groups(known, frequent_shingles(everything), n_buckets, hot_rows, wide=smallest < 0 or largest >= 1 << 32)
    members = stored(groups.join(named.withColumnRenamed("doc_id", "doc"), "doc").select("gid", "rep").distinct(), "jaccard-groups")
    in_groups = members.select(F.col("rep").alias("doc_id")).distinct()
    marks = stored(sets.join(in_groups, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "bits").distinct(), "jaccard-marks")

    links = verified(stored(possible(first_pairs(members), marks), "jaccard-first"), known)
    found = stored(components(links), "jaccard-components")
    more = verified(second_pairs(members, found, marks), known)
    final = components(more.union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    dropped(members, marks)

    # Documents with one id are one node, whatever their sets.
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        ids = named.join(final, named["rep"] == final["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    else:
        whole = components(final.select(F.col("node").alias("u"), F.col("component").alias("v")).union(named.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
        ids = named.select("doc_id").distinct().join(whole, F.col("doc_id") == whole["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
