"""Mergeable sketches of fixed size: repeated-cell bitmaps and filters of ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session
from .arrowtext import binary_column, mix, releasing

#: A block of a bitmap has 2**20 cells at most, so that what its group reads follows from the cells an entry, not from the input.
BLOCK_LOG = 20
KIND = "block int, once binary, twice binary"


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - bits)).astype(np.int64)


def merged_sketch(cells_of: DataFrame, bits: int) -> bytes:
    """One bitmap of cells counted twice or more, from rows (block, once, twice) of partial sketches.

    Partial sketches list cells, so a block's group holds four bytes for each entry
    of the block (an eighth of its cells on average) and each task's share of the few
    cells that every task has; the dense form exists for one block at a time.
    """
    size = 1 << min(bits, BLOCK_LOG)

    def merge(group: pa.Table) -> pa.Table:
        one = np.zeros(size, bool)
        two = np.zeros(size, bool)
        for once, twice in zip(group.column("once"), group.column("twice"), strict=True):
            at = np.frombuffer(once.as_buffer(), np.uint32)
            two[at[one[at]]] = True
            one[at] = True
            two[np.frombuffer(twice.as_buffer(), np.uint32)] = True
        # A cell that one task counts twice is two, whatever the others counted.
        return pa.table({"block": group.column("block").slice(0, 1), "bitmap": [np.packbits(two).tobytes()]})

    out = bytearray(max(1, (1 << bits) // 8))
    each = size // 8
    for row in cells_of.groupBy("block").applyInArrow(merge, "block int, bitmap binary").collect():  # blocks of a fixed size, one bitmap in all
        out[row["block"] * each : (row["block"] + 1) * each] = row["bitmap"]
    return bytes(out)


def partial_sketch(bits: int, pending: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of one task's counts: the cells seen once and those seen more often, by block."""
    size = 1 << min(bits, BLOCK_LOG)
    found, counts = np.unique(np.concatenate(pending) if pending else np.zeros(0, np.int64), return_counts=True)
    block = found // size
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(found) else np.zeros(0, np.int64)
    rows = []
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(found)], strict=False):
        own = (found[lo:hi] - block[lo] * size).astype(np.uint32)
        rows.append((int(block[lo]), own[counts[lo:hi] == 1].tobytes(), own[counts[lo:hi] > 1].tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], names=["block", "once", "twice"])


def bits_for(size: int, entries_per_byte: float) -> int:
    """Bits for about 8 cells an entry, without a ceiling."""
    return max(20, math.ceil(math.log2(max(1, size * entries_per_byte * 8))))


def sketch_bits(docs: DataFrame, entries_per_byte: float, max_bits: int) -> tuple[int, int]:
    """Bits of the sketch, and a number of tasks that follows the input beyond the sketch's ceiling."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(size, entries_per_byte)
    return max(20, min(max_bits, bits)), 1 << max(0, bits - 24)


def seen(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the cells are set."""
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def id_filter(ids: DataFrame, bits: int) -> Broadcast:
    """A bitmap of the cells of all long columns of ``ids``: no id is missed, others may slip through."""
    columns = ids.columns

    @releasing
    def mark(batches) -> Iterator[pa.RecordBatch]:
        held = [cells(batch.column(c).to_numpy().astype(np.uint64), bits) for batch in batches for c in columns]
        if held:
            yield partial_sketch(bits, [np.repeat(np.unique(np.concatenate(held)), 2)])

    return ids.sparkSession.sparkContext.broadcast(merged_sketch(ids.mapInArrow(mark, KIND), bits))


def filter_bits(n: int) -> int:
    """Bits for a filter of n ids: about 32 cells each, 16 MB at most."""
    return max(12, min(27, 5 + n.bit_length()))


def only(docs: DataFrame, ids: Broadcast, bits: int, present: bool = True) -> DataFrame:
    """The rows whose doc_id the filter has (or, for certain, has not). doc_id is a long and not null."""

    @releasing
    def pick(batches) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(ids.value, np.uint8)
        for batch in batches:
            hit = seen(bitmap, cells(batch.column("doc_id").to_numpy().astype(np.uint64), bits))
            yield batch.filter(pa.array(hit == present))

    return docs.mapInArrow(pick, docs.schema)


#: Ids up to this many are broadcast as they are, about 32 MB; beyond, as a bitmap of 16 MB at most.
FEW = 1_000_000


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among the distinct ``ids`` (doc_id), rows that are not): only the first need a join, and so a shuffle."""
    n = ids.count()
    if n <= FEW:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi"), docs.join(F.broadcast(ids), "doc_id", "left_anti")
    found = id_filter(ids, filter_bits(n))
    return only(docs, found, filter_bits(n)), only(docs, found, filter_bits(n), False)


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the distinct ``ids`` (doc_id), and perhaps a few others; ``ids`` should be a written table."""
    n = ids.count()
    if n <= FEW:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return only(docs, id_filter(ids, filter_bits(n)), filter_bits(n))


#: Spans as they are found: one row for each part that a task finds some for.
PACKED = "part int, spans binary"
#: Spans that a task holds before it packs them.
HELD = 1 << 20


def packed_spans(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """One row for each part that has some of the spans ``found`` (ids, rows, start << 24 | length), as three columns of numbers; a text has one part."""
    ids, rows, spans = (np.concatenate(x) for x in zip(*found, strict=True))
    part = (mix(ids.astype(np.uint64) ^ mix(rows.astype(np.uint64))) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((spans, rows, ids, part))
    table, part = np.stack([ids, rows, spans]).astype("<i8")[:, order], part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    blobs = [table[:, lo:hi].tobytes() for lo, hi in zip(cut, [*cut[1:], len(part)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "spans"])


def united(ids: np.ndarray, rows: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, (start, end) pairs): the maximal runs that the spans cover, by id, row and start."""
    order = np.lexsort((spans, rows, ids))
    ids, rows, start = ids[order], rows[order], spans[order] >> 24
    end = start + (spans[order] & 0xFFFFFF)
    # Texts follow each other on one line, so that no run goes on into the next text.
    base = np.cumsum(np.r_[False, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    cut = np.flatnonzero(np.r_[True, (start + base)[1:] > reach[:-1]])
    last = np.r_[cut[1:], len(ids)] - 1
    return ids[cut], rows[cut], np.stack([start[cut], reach[last] - base[last]], axis=1)


def spans_by_row(packed: DataFrame, parts: int) -> DataFrame:
    """(doc_id, row, spans), one row for each text, from all ``packed`` spans."""

    @releasing
    def unite(batches) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(blob.as_buffer(), "<i8").reshape(3, -1) for batch in batches for blob in batch.column("spans")]
        if held:
            ids, rows, pairs = united(*np.concatenate(held, axis=1))
            new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])
            blobs = binary_column(np.ascontiguousarray(pairs, "<i8").reshape(-1).view(np.uint8), 16 * np.diff(np.r_[new, len(ids)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[new], pa.int64()), pa.array(rows[new], pa.int64()), blobs], names=["doc_id", "row", "spans"])

    return packed.repartition(parts, "part").mapInArrow(unite, "doc_id long, row long, spans binary")


def spans_in(cell: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of a row that ``with_spans`` has joined."""
    return tuple(np.frombuffer(cell.as_buffer(), "<i8").reshape(-1, 2).T)


def row_of(text: str = "text"):
    """A hash of the text, which tells rows that share a doc_id apart; equal rows are alike in all that follows."""
    return F.xxhash64(text)


def with_spans(docs: DataFrame, runs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column, and its name: the spans that the written ``runs`` (doc_id, row, spans) has for the row, or null."""
    at, doc, row = (session.fresh(c, docs) for c in ("_spans", "_doc", "_row"))
    spans = runs.withColumnsRenamed({"doc_id": doc, "row": row, "spans": at})
    ids = session.kept_table(runs.select("doc_id").distinct())
    some, others = split_by_ids(docs.where("doc_id is not null"), ids)
    joined = some.join(spans, (F.col("doc_id") == F.col(doc)) & (row_of() == F.col(row)), "left").drop(doc, row)
    return joined.unionByName(others.unionByName(docs.where("doc_id is null")).withColumn(at, F.lit(None).cast("binary"))), at
