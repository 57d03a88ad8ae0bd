"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a ``width``-byte string covers it that also starts in a document with
a smaller doc_id. Strings are judged on the input and never cross documents.

1. A merged sketch of minimisers (see ``substring_dedup``, here over bytes) keeps
   only windows that may be repeated; none that is repeated is lost.
2. Consecutive windows under one minimiser travel as one string to the bucket of that
   minimiser, so equal windows always meet, and a bucket is a small, complete text
   collection. Equal strings collapse first, within the sender and then in the
   bucket: what a later document shares with an earlier one as a whole is settled
   here. Only distinct strings that share a minimiser go on.
3. The bucket's strings are dealt into shards. Each shard is sorted once and gives its
   Burrows-Wheeler transform; the shards' transforms are then merged by iterative
   interleave refinement: an array that names the shard of each suffix is refined by
   stable passes over the transforms, each of which orders it by two bytes more. No
   suffix is compared or sorted again. Where a pass first separates neighbours is
   their common prefix; the blocks left after ``width`` bytes, of common prefixes of
   ``width`` throughout, are the repeated intervals, and the least doc_id of a block tells which of its windows go.
4. Flagged windows go to their documents in runs: a task packs the runs that it finds
   into a row for each part of the documents, and a part's runs are united by document.

Stride and depth: transforms hold the two preceding bytes, so ``width`` / 2 passes
suffice. Strings end in byte 0xFF, which UTF-8 never has.

Edge cases: null, empty and short texts lose nothing; rows with a null doc_id are kept
whole and match nothing; rows that share a doc_id don't remove each other, each loses
what a smaller doc_id has. Texts of any length are read whole. An empty table gives an
empty result. Other columns pass through, whatever their names, but for inputs named
like an output, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .arrowtext import chunks, gather, inverse, mix, powers, releasing, rolling, sliding, text_buffers
from .sketches import HELD, KIND, PACKED, cells, merged_sketch, packed_spans, partial_sketch, row_of, seen, sketch_bits, spans_by_row, spans_in, with_spans

WIDTH = 50
#: Bytes of the sub-windows that minimisers are taken from.
PART = 20
BUFFER = 1 << 16
#: Bytes of strings that merge at once, and the shards they are dealt into.
BATCH = 1 << 19
SHARDS = 4
END = 0xFF
_BYTE = np.random.Generator(np.random.PCG64(50)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_BASE_2 = 0xA24BAED4963EE407


def _windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """Part hashes, each window's minimiser, and the starts of windows within one document."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = rolling(_BYTE[data], PART)
    least = sliding(parts, width - PART + 1, np.minimum)
    valid = np.ones(n, bool)
    for end in offsets[1:-1].tolist():
        valid[max(0, end - width + 1) : end] = False
    return parts, least, np.flatnonzero(valid)


def _string_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each slice of ``data``."""
    out = []
    values = _BYTE[data]
    for base in (_BASE, _BASE_2):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * powers(base, len(data)), out=sums[1:])
        out.append(mix((sums[starts + lengths] - sums[starts]) * powers(inverse(base), len(data) + 1)[starts]) + lengths.astype(np.uint64))
    return out[0], out[1]


def shard_transform(text: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, two preceding bytes of each) of a shard of strings, sorted by ``width`` bytes and more.

    ``begin`` and ``size`` give for each byte the start and length of its string;
    contexts run around within a string. Sorted by prefix doubling.
    """
    inner = np.arange(len(text)) - begin
    around = lambda k: begin + (inner + k) % size
    # The first sort takes eight bytes at once; each one after it doubles the reach.
    key = np.zeros(len(text), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | text[around(k)]
    reach = 8
    while reach < width:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        key = rank << 32 | rank[around(reach)]
        reach *= 2
    order = np.argsort(key, kind="stable")
    before = text[around(-2)].astype(np.uint16) << 8 | text[around(-1)]
    return order, before[order]


def merged_transforms(transforms: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards, block of equal ``width``-byte prefixes, and common prefix with the suffix before.

    ``transforms`` hold two preceding bytes for each suffix in shard order. Common
    prefixes are in steps of two and end at ``width``.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block = np.zeros(len(shard), np.int32)
    symbols = np.empty(len(shard), np.uint16)
    common = np.zeros(len(shard), np.int16)
    new = np.zeros(len(shard), bool)
    for _ in range(0, width, 2):
        for s, t in enumerate(transforms):
            symbols[np.flatnonzero(shard == s)] = t
        order = np.argsort(symbols, kind="stable")
        shard, block, ordered = shard[order], block[order], symbols[order]
        new[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        block = np.cumsum(new, dtype=np.int32)
        # Blocks keep their places as they are refined, so a place counts until it first parts two blocks.
        common += (~new).view(np.int8) * np.int8(2)
    return shard, block, common


def repeated_in(strings: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int, shards: int = SHARDS) -> np.ndarray:
    """For each byte of the concatenated strings, whether a window starts there that a smaller owner also has."""
    n = len(lengths)
    size = lengths + 1
    starts = np.cumsum(size) - size
    text = np.full(int(size.sum()), END, np.uint8)
    first = np.cumsum(lengths) - lengths
    to = np.arange(len(strings)) + np.repeat(starts - first, lengths)
    text[to] = strings
    begin, whole = np.repeat(starts, size), np.repeat(size, size)
    owner = np.repeat(owners, size)
    bounds = np.r_[starts, len(text)][np.linspace(0, n, min(shards, n) + 1).astype(int)]
    orders, transforms = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        order, transform = shard_transform(text[lo:hi], begin[lo:hi] - lo, whole[lo:hi], width)
        orders.append(order + lo)
        transforms.append(transform)
    shard, block, common = merged_transforms(transforms, width)
    place = np.empty(len(text), np.int64)
    for s, order in enumerate(orders):
        place[shard == s] = order
    full = place - begin[place] + width < whole[place]
    # A repeated interval goes on where the common prefix with the suffix before is a whole window.
    block = np.cumsum(common < width)
    place, block = place[full], block[full]
    flags = np.zeros(len(text), bool)
    if len(place):
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        least = np.minimum.reduceat(owner[place], cut)
        flags[place] = owner[place] > np.repeat(least, np.diff(np.r_[cut, len(place)]))
    return flags[to]


def _spans(ids: np.ndarray, rows: np.ndarray, pos: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (doc_id, row, start << 24 | length), runs over 2**24 cut."""
    while (over := lengths >= 1 << 24).any():
        ids, rows, pos, lengths = np.r_[ids, ids[over]], np.r_[rows, rows[over]], np.r_[pos, pos[over] + (1 << 23)], np.r_[np.where(over, 1 << 23, lengths), lengths[over] - (1 << 23)]
    return np.stack([ids, rows, pos << 24 | lengths], axis=1)


def _lead(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each ordered row, least id of each group) by equal hashes."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    group = np.cumsum(new) - 1
    return order, group, ids[order][new]


def repeated_runs(docs: DataFrame, width: int = WIDTH, max_bits: int = 30) -> DataFrame:
    """(doc_id, row, spans): runs of bytes at which a window starts that an earlier document also has, one row for each text that has any."""
    if width % 2 or width < PART + 1:
        raise ValueError("width must be even and longer than the minimiser's part")
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_of().alias("row"), "text")
    bits, least_tasks = sketch_bits(texts, 2 / (width - PART + 2), max_bits)
    reach = width - PART + 1

    @releasing
    def count(batches) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(*text_buffers(batch.column("text"))):
                parts, least, at = _windows(data, offsets, width)
                if len(at) == 0:
                    continue
                top = np.zeros(len(least), np.uint64)
                top[at] = least[at]
                pad = np.zeros(reach - 1, np.uint64)
                places = np.flatnonzero((sliding(np.concatenate([pad, top, pad]), reach, np.maximum)[: len(parts)] == parts) & (parts > 0))
                pending.append(cells(parts[places], bits))
                held += len(places)
                if held > 1 << 19:
                    yield partial_sketch(bits, pending)
                    pending, held = [], 0
        if held:
            yield partial_sketch(bits, pending)

    sketch = spark.sparkContext.broadcast(merged_sketch(texts.select("text").mapInArrow(count, KIND), bits))
    names = ["bucket", "kind", "meta", "body"]
    # About 8 MB of strings in a task; the number follows the input.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least_tasks)
    buckets = 8 * tasks

    def packed(bucket: np.ndarray, kind: int, meta: np.ndarray, body: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row for each bucket; rows of ``meta`` and slices of ``body`` are in bucket order."""
        if len(bucket):
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[cut[1:], len(bucket)]
            bytes_to = np.concatenate([[0], np.cumsum(lengths)])
            raw, text = np.ascontiguousarray(meta.astype("<i8")), body
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array([kind] * len(cut), pa.int32()), pa.array([raw[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]), pa.array([text[bytes_to[a] : bytes_to[b]].tobytes() for a, b in zip(cut, ends, strict=True)])], names=names)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        least, ids, rows, pos, lengths, h1, h2 = (np.concatenate(x) for x in list(zip(*held, strict=True))[:7])
        text = np.concatenate([x[7] for x in held])
        order, group, lead = _lead(h1, h2, ids)
        late = ids[order] > lead[group]
        gone, rest = order[late], order[~late]
        spans = _spans(ids[gone], rows[gone], pos[gone], lengths[gone] - width + 1)
        to = (mix(spans[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        yield from packed(to[by], 1, spans[by], text[:0], np.zeros(len(by), np.int64))
        first = np.cumsum(lengths) - lengths
        to = (mix(least[rest] + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)
        rest = rest[np.lexsort((pos[rest], ids[rest], to))]
        to = (mix(least[rest] + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)
        yield from packed(to, 0, np.stack([least[rest].view(np.int64), ids[rest], rows[rest], pos[rest], lengths[rest]], axis=1), gather(text, first[rest], lengths[rest]), lengths[rest])

    @releasing
    def emit(batches) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sketch.value, np.uint8)
        held, n = [], 0
        for batch in batches:
            ids, rows_of = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
            for lo, _, data, offsets in chunks(*text_buffers(batch.column("text"))):
                _, least, at = _windows(data, offsets, width)
                at = at[seen(bitmap, cells(least[at], bits))]
                if len(at) == 0:
                    continue
                own = least[at]
                rows = np.searchsorted(offsets, at, "right") - 1
                cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])])
                starts, lengths, rows = at[cut], np.diff(np.r_[cut, len(at)]) + width - 1, rows[cut]
                h1, h2 = _string_hashes(data, starts, lengths)
                held.append((own[cut], ids[lo + rows], rows_of[lo + rows], starts - offsets[rows], lengths, h1, h2, gather(data, starts, lengths)))
                n += len(starts)
                if n > BUFFER:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    @releasing
    def merge(batches) -> Iterator[pa.RecordBatch]:
        metas, bodies, spans, n = [], [], [], 0
        for batch in batches:
            for kind, meta, body in zip(batch.column("kind").to_pylist(), batch.column("meta"), batch.column("body"), strict=True):
                rows = np.frombuffer(meta.as_py(), "<i8")
                if kind:
                    spans.append(rows.reshape(-1, 3))
                    n += len(spans[-1])
                else:
                    metas.append(rows.reshape(-1, 5))
                    bodies.append(np.frombuffer(body.as_py(), np.uint8))
                if n > HELD:
                    yield packed_spans([x.T for x in spans], tasks)
                    spans, n = [], 0
        if metas:
            for found in flagged(np.concatenate(metas), np.concatenate(bodies), width):
                spans.append(found)
                n += len(found)
                if n > HELD:
                    yield packed_spans([x.T for x in spans], tasks)
                    spans, n = [], 0
        if n:
            yield packed_spans([x.T for x in spans], tasks)

    emitted = texts.mapInArrow(emit, "bucket int, kind int, meta binary, body binary")
    return spans_by_row(emitted.repartition(tasks, "bucket").mapInArrow(merge, PACKED), tasks)


def flagged(meta: np.ndarray, text: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Spans of the windows to remove, from rows (minimiser, doc_id, row, start, length) and their strings."""
    least, ids, rows, pos, lengths = meta.T
    first = np.cumsum(lengths) - lengths
    h1, h2 = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
    for lo, hi in _batches(lengths, 4 * BATCH):
        base = first[lo]
        h1[lo:hi], h2[lo:hi] = _string_hashes(text[base : first[hi - 1] + lengths[hi - 1]], first[lo:hi] - base, lengths[lo:hi])
    order, group, lead = _lead(h1, h2, ids)
    late = ids[order] > lead[group]
    gone, kept, group = order[late], order[~late], group[~late]
    yield _spans(ids[gone], rows[gone], pos[gone], lengths[gone] - width + 1)
    # One string for each group, beside the others that share its minimiser.
    one = kept[np.r_[True, group[1:] != group[:-1]]]
    by = np.argsort(least[one], kind="stable")
    key = least[one][by]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.repeat(np.diff(np.r_[cut, len(key)]), np.diff(np.r_[cut, len(key)])) > 1
    own = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(key)]))[many]
    chosen = by[many]
    if len(chosen) == 0:
        return
    members = np.argsort(group, kind="stable")
    member_first = np.searchsorted(group[members], np.arange(len(one) + 1))
    for lo, hi in _batches(lengths[one[chosen]], BATCH, own):
        some = one[chosen[lo:hi]]
        size = lengths[some]
        # The strings arrive by document within a minimiser; shards should mix minimisers, so order by hash.
        mixed = np.argsort(h1[some], kind="stable")
        some, size = some[mixed], size[mixed]
        flags = repeated_in(gather(text, first[some], size), size, ids[some], width)
        at = np.flatnonzero(flags)
        if len(at) == 0:
            continue
        starts = np.cumsum(size) - size
        string = np.searchsorted(starts, at, "right") - 1
        inner = at - starts[string]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (string[1:] != string[:-1])])
        run = np.diff(np.r_[new, len(at)])
        string, inner = string[new], inner[new]
        g = chosen[lo:hi][mixed][string]
        times = member_first[g + 1] - member_first[g]
        those = kept[members[np.repeat(member_first[g] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]]
        yield _spans(ids[those], rows[those], pos[those] + np.repeat(inner, times), np.repeat(run, times))


def _batches(lengths: np.ndarray, limit: int, together: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` in total length; equal values of ``together`` stay in one."""
    total = np.cumsum(lengths)
    lo, n = 0, len(lengths)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        if together is not None and hi < n:
            hi = int(np.searchsorted(together, together[hi - 1], "right"))
        yield lo, hi
        lo = hi


def dedup_bytes(docs: DataFrame, width: int = WIDTH, max_bits: int = 30) -> DataFrame:
    """All rows and columns, plus n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes."""
    runs = session.kept_table(repeated_runs(docs, width, max_bits))
    joined, spans_at = with_spans(docs, runs)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    own = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in own]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"])

    @releasing
    def remove(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows = []
            for i, found in enumerate(batch.column(spans_at)):
                raw = data[offsets[i] : offsets[i + 1]]
                n_spans = 0
                n = len(raw)
                if found.is_valid:
                    at, end = spans_in(found)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(at, n), 1)
                    np.add.at(edge, np.minimum(end + width - 1, n), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    n_spans = int((keep[:-1] & ~keep[1:]).sum()) + int(n > 0 and not keep[0])
                    raw = raw[keep]
                left = raw.tobytes()
                rows.append((n, n - len(left), n_spans, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True))], names=[*names, *added])

    return joined.select(*names, spans_at).mapInArrow(remove, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir).select("doc_id", "text")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
