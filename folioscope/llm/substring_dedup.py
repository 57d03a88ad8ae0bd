"""Substring dedup over word windows, with a count-min prefilter.

A window is ``width`` consecutive words of one document. A word goes if a window
covers it whose word sequence also starts earlier (smaller doc_id, or the same
document at an earlier word). Windows are judged on the input.

1. Each task counts its windows in a partial sketch. Windows are counted under
   their minimiser (the least hash among their sub-windows of half the width),
   once for each distinct place of it, so a sixth of the entries suffices: equal
   windows have equal minimisers at distinct places, so a cell never
   underestimates a window's count. Partial sketches are lists of cells; they
   merge block by block into one bitmap, "two or more".
2. A second pass emits only the windows whose cell is estimated repeated, under a
   128-bit hash of the whole word sequence. Each task first settles what repeats
   within its own buffer, so a passage that a third of all documents share gives
   one row for each buffer and not for each document. Grouping by hash then finds
   the earliest start exactly; a window that the sketch overestimated is alone in
   its group and nothing is lost.
3. Windows travel in runs under one minimiser, and flagged starts go to their
   documents in runs as well, packed by part of the documents and united there.

The bitmap has 2**bits cells, about 8 for each expected entry, up to ``max_bits``
(2**30 cells, 128 MB); beyond that only the prefilter weakens. Nothing else is
broadcast.

Edge cases: null, empty or short text has no window and keeps all words. Rows with
a null doc_id have no place in the order: they are kept whole and match nothing.
Rows that share a doc_id don't remove each other, whatever their texts: each loses what
a smaller doc_id has and what it repeats itself. Texts of any length are read whole, in
chunks or, if longer, alone. An empty table gives an empty result. Other columns pass
through, whatever their names, but for inputs named like an output, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .arrowtext import binary_column, chunks, mix, releasing, rolling, sliding, text_buffers, word_hashes, word_spans
from .sketches import HELD, KIND, PACKED, cells, merged_sketch, packed_spans, partial_sketch, row_of, seen, sketch_bits, spans_by_row, spans_in, with_spans

#: Windows that a task holds before it settles and emits them.
BUFFER = 1 << 18
#: A run's length has 24 bits beside its place.
LONGEST = (1 << 24) - 1
_SECOND = 0xA24BAED4963EE407  # odd


def _windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """Word rows, the rank of each row's first word, word hashes, window starts and their minimisers."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(rows, np.arange(len(offsets)), "left")
    if len(rows) < width:
        return rows, first, hashes, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    part = (width + 1) // 2
    parts = rolling(hashes, part)
    least = sliding(parts, width - part + 1, np.minimum)
    at = np.flatnonzero(rows[: len(rows) - width + 1] == rows[width - 1 :])
    return rows, first, hashes, at, least, parts


def _minimiser_places(parts: np.ndarray, least: np.ndarray, valid: np.ndarray, reach: int) -> np.ndarray:
    """Places of sub-windows that are the least of a valid window; ties count too, which only overestimates."""
    if len(valid) == 0:
        return np.zeros(0, np.int64)
    top = np.zeros(len(least), np.uint64)
    top[valid] = least[valid]
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), top, np.zeros(reach - 1, np.uint64)])
    return np.flatnonzero((sliding(padded, reach, np.maximum)[: len(parts)] == parts) & (parts > 0))


def _runs(ids: np.ndarray, pos: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive places of one document, cut at ``LONGEST``; input sorted by (ids, pos)."""
    if len(ids) == 0:
        return (np.zeros(0, np.int64),) * 2
    cut = np.ones(len(ids), bool)
    cut[1:] = (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1] + 1)
    for x in same:
        cut[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(cut)
    times = (np.diff(np.r_[at, len(ids)]) - 1) // LONGEST + 1
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    at = np.repeat(at, times) + nth * LONGEST
    return at, np.diff(np.r_[at, len(ids)])


def _first_of_each(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the order by hash, document, row and place, and which in it stay: their row's first start, no smaller document having one."""
    order = np.lexsort((pos, rows, ids, h2, h1))
    h1, h2, ids, rows, pos = h1[order], h2[order], ids[order], rows[order], pos[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    own = new.copy()
    own[1:] |= (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    lead, mine = (np.flatnonzero(x)[np.cumsum(x) - 1] for x in (new, own))
    return order, (ids == ids[lead]) & (pos == pos[mine])


def _in_place(ids: np.ndarray, rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The order by document, row and place, each place once."""
    order = np.lexsort((pos, rows, ids))
    ids, rows, pos = ids[order], rows[order], pos[order]
    return order[np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (pos[1:] != pos[:-1])]] if len(order) else order


def repeated_starts(docs: DataFrame, width: int = 20, max_bits: int = 30) -> DataFrame:
    """(doc_id, row, spans): runs of words at which a repeated, not first, window starts, one row for each text that has any.

    ``row`` is ``row_of`` the text, which tells rows of one doc_id apart. Spans are
    (start, end) ranks of words; on their way they are the rank of a run's first word
    times 2**24, plus its length.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_of().alias("row"), "text")
    bits, least_tasks = sketch_bits(texts, 1 / 33, max_bits)
    part = (width + 1) // 2

    @releasing
    def count(batches) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(*text_buffers(batch.column("text"))):
                rows, _, _, at, least, parts = _windows(data, offsets, width)
                places = _minimiser_places(parts, least, at, width - part + 1)
                pending.append(cells(parts[places], bits))
                held += len(places)
                if held > BUFFER:
                    yield partial_sketch(bits, pending)
                    pending, held = [], 0
        if held:
            yield partial_sketch(bits, pending)

    sketch = spark.sparkContext.broadcast(merged_sketch(texts.select("text").mapInArrow(count, KIND), bits))

    names = ["key", "doc_id", "row", "span", "hashes"]

    def known(ids: np.ndarray, rows: np.ndarray, pos: np.ndarray) -> tuple[pa.Array, ...]:
        order = _in_place(ids, rows, pos)
        ids, rows, pos = ids[order], rows[order], pos[order]
        at, lengths = _runs(ids, pos, rows)
        return pa.array(ids[at]), pa.array(rows[at]), pa.array((pos[at] << 24) + lengths)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Emit the buffer's first start of each sequence, in runs under one minimiser; flag the others here."""
        h1, h2, ids, rows, pos, least = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = _first_of_each(h1, h2, ids, rows, pos)
        late, order = order[~first], order[first]
        if len(late):
            own, row, spans = known(ids[late], rows[late], pos[late])
            yield pa.RecordBatch.from_arrays([pa.array(mix(own.to_numpy().astype(np.uint64)).view(np.int64)), own, row, spans, pa.nulls(len(own), pa.binary())], names=names)
        order = order[_in_place(ids[order], rows[order], pos[order])]
        ids, rows, pos, least = ids[order], rows[order], pos[order], least[order]
        at, lengths = _runs(ids, pos, rows, least)
        both = np.stack([h1[order], h2[order]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(mix(least[at]).view(np.int64)), pa.array(ids[at]), pa.array(rows[at]), pa.array((pos[at] << 24) + lengths), binary_column(both.view(np.uint8), lengths * 16)], names=names)

    @releasing
    def emit(batches) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sketch.value, np.uint8)
        held, n = [], 0
        for batch in batches:
            ids, rows_of = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
            for lo, _, data, offsets in chunks(*text_buffers(batch.column("text"))):
                rows, first, hashes, at, least, _ = _windows(data, offsets, width)
                if len(at) == 0:
                    continue
                at = at[seen(bitmap, cells(least[at], bits))]
                if len(at):
                    held.append((rolling(hashes, width)[at], rolling(hashes, width, _SECOND)[at], ids[lo + rows[at]], rows_of[lo + rows[at]], at - first[rows[at]], least[at]))
                    n += len(at)
                if n > BUFFER:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    @releasing
    def find(batches) -> Iterator[pa.RecordBatch]:
        held, found, n = [], [], 0
        for batch in batches:
            settled = batch.filter(pa.compute.is_null(batch.column("hashes")))
            if settled.num_rows:
                found.append(tuple(settled.column(c).to_numpy() for c in ("doc_id", "row", "span")))
                n += settled.num_rows
                if n > HELD:
                    yield packed_spans(found, parts)
                    found, n = [], 0
            rest = batch.filter(pa.compute.is_valid(batch.column("hashes")))
            if rest.num_rows:
                raw, _ = text_buffers(rest.column("hashes"))
                both = raw.view(np.uint64).reshape(-1, 2)
                span = rest.column("span").to_numpy()
                lengths = span & 0xFFFFFF
                inner = np.arange(len(both)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                held.append((both[:, 0], both[:, 1], *(np.repeat(rest.column(c).to_numpy(), lengths) for c in ("doc_id", "row")), np.repeat(span >> 24, lengths) + inner))
        if held:
            h1, h2, ids, rows, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = _first_of_each(h1, h2, ids, rows, pos)
            late = order[~first]
            if len(late):
                found.append(tuple(x.to_numpy() for x in known(ids[late], rows[late], pos[late])))
        if found:
            yield packed_spans(found, parts)

    emitted = texts.mapInArrow(emit, "key long, doc_id long, row long, span long, hashes binary")
    # Sized so that a task holds a few million windows; the number follows the input.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least_tasks)
    return spans_by_row(emitted.repartition(parts, "key").mapInArrow(find, PACKED), parts)


def dedup_words(docs: DataFrame, width: int = 20, max_bits: int = 30) -> DataFrame:
    """All rows and columns, plus n_words, n_removed, kept_sha256 and kept_text.

    ``kept_text`` is the original text where nothing is removed, else the kept
    words joined by one space; ``kept_sha256`` is always of the joined words.
    """
    starts = session.kept_table(repeated_starts(docs, width, max_bits))
    joined, spans_at = with_spans(docs, starts)
    taken = {"n_words", "n_removed", "kept_sha256", "kept_text"}
    own = [c for c in docs.columns if c not in taken]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in taken] + ["n_words long, n_removed long, kept_sha256 string, kept_text string"])

    @releasing
    def remove(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text"), batch.column(spans_at)
            n_words, n_removed, digests, kept = [], [], [], []
            for text, runs in zip(texts, spans, strict=True):
                text = text.as_py()
                words = text.encode().split() if text else []
                gone = 0
                if runs.is_valid and len(words) >= width:
                    at, end = spans_in(runs)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.minimum(at, len(words)), 1)
                    np.add.at(edge, np.minimum(end + width - 1, len(words)), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    left = list(compress(words, keep.tolist())) if gone else words
                else:
                    left = words
                joined_words = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(gone)
                digests.append(hashlib.sha256(joined_words).hexdigest())
                kept.append(joined_words.decode() if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=[*own, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return joined.select(*own, spans_at).mapInArrow(remove, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir).select("doc_id", "text")
    return dedup_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
