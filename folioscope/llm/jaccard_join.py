"""Exact Jaccard join on word shingles, and the components of its links.

A document's set holds its distinct ``width``-word shingles (of A-Z lower-cased
text); two documents link when ``100 * intersection >= percent * union``.

1. Documents with equal sets form a class; only its least doc_id goes on. Sets are
   compared by count and two 64-bit sums of element hashes.
2. Shingles are ordered by an estimate of their document frequency (a merged counter
   sketch of fixed size), then by hash. Any order gives exact results; rare first
   keeps shared passages out of the prefixes. Sets that link must share an element
   of their prefixes (the least fifth for the longer, a ninth for the shorter).
3. First round: in each prefix element's group, sorted by size, each document meets
   its predecessor and the group's first. The partner that a document meets most
   often in either way is checked. Groups of copies fall together here with as many
   checks as documents, not pairs.
4. Only elements whose documents are still in several components go on, of their rows
   those in a tile of the last round that has both sides and several components, and of the
   elements that have the same documents only the first in the order: a pair that
   shares one of them shares them all. In a few more rounds each document meets the
   ones beside it in other orders, so that what is left of a large group of near
   copies falls together, again with a fixed number of checks a document.
5. Last round, for exactness: documents are dealt into size-banded tiles (a factor
   1.25 wide, so partners lie in the same or the next band), and large tiles into
   square blocks of bounded bytes. Within a block, pairs of different components are
   compared on arrays: the places of the shared element, and hashed bitmaps of four
   to eight bits an element. Of a hashed set, ``|A| - bits(A and not B)`` bounds the
   overlap from above. Only pairs that this leaves become rows.
6. Each of them is checked by intersecting sorted arrays. What it links are
   components of the rounds before, so the last contraction is small.

Elements are 64-bit hashes of shingles. Groups estimated hot are salted.

Edge cases: null, empty and blank texts have the empty set, link with nothing and are
their own component; a text of fewer than ``width`` words has one element, the whole
sequence; rows that share a doc_id are one document, which has the links of each of
its rows; null doc_ids are kept with a null component and link with nothing. An empty
table gives an empty result. Texts of any length are read whole. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import session
from .arrowtext import binary_column, chunks, mix, releasing, rolling, text_buffers, whole_groups, word_hashes, word_spans
from .components import components
from .sketches import among, split_by_ids

CELLS_LOG = 21
PARTS = 1024
#: Counts merge in two steps, the first for so many tasks at a time; a task gives 4 KB to each part, a first step 8 KB.
FAN = 1024
BITMAP_BITS = 1024
#: A key whose cell counts more than this, beside twice what cells count on average, is dealt out by salt.
HOT = 4096
SALTS = 64
#: Further rounds of cheap meetings before tiles are compared.
ROUNDS = 3
#: Bytes of the bitmaps of one side of a block, and its documents at most.
BLOCK_BYTES = 1 << 23
BLOCK_ROWS = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = word_hashes(_LOWER[data], starts, ends)
    first = np.searchsorted(rows, np.arange(len(offsets)), "left")
    all_windows = rolling(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(all_windows[a : b - width + 1])
        else:
            yield rolling(hashes[a:b], b - a) if b > a else hashes[:0]


def _cell(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(64 - CELLS_LOG)).astype(np.int64)


def frequency_ranks(docs: DataFrame, width: int) -> bytes:
    """A rank 0..255 for each sketch cell, rising with the logarithm of its count."""
    size = (1 << CELLS_LOG) // PARTS

    @releasing
    def count(batches) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS_LOG, np.int32)
        for batch in batches:
            for _, _, data, offsets in chunks(*text_buffers(batch.column("text"))):
                np.add.at(cells, _cell(np.concatenate(list(sets_of(data, offsets, width)))), 1)
        parts = np.minimum(cells, 65535).astype(np.uint16).reshape(PARTS, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId() // FAN] * PARTS, pa.int32()), pa.array([x.tobytes() for x in parts]), pa.array([2] * PARTS, pa.int32())], names=["part", "fan", "counts", "wide"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for raw, wide in zip(group.column("counts"), group.column("wide").to_pylist(), strict=True):
            total += np.frombuffer(raw.as_buffer(), np.uint16 if wide == 2 else np.int32)
        return pa.table({"part": group.column("part").slice(0, 1), "fan": pa.array([0], pa.int32()), "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], "wide": pa.array([4], pa.int32())})

    def rank(group: pa.Table) -> pa.Table:
        counts = np.frombuffer(merge(group).column("counts")[0].as_py(), np.int32)
        return pa.table({"part": group.column("part").slice(0, 1), "ranks": [rank_of(counts).tobytes()]})

    kind = "part int, fan int, counts binary, wide int"
    level = docs.select("text").mapInArrow(count, kind).groupBy("part", "fan").applyInArrow(merge, kind)
    total = np.zeros((PARTS, size), np.uint8)
    for row in level.groupBy("part").applyInArrow(rank, "part int, ranks binary").collect():  # PARTS rows of a fixed size
        total[row["part"]] = np.frombuffer(row["ranks"], np.uint8)
    return total.tobytes()


def rank_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(6 * np.log2(counts + 1.0))).astype(np.uint8)


def hot_rank(ranks: bytes) -> int:
    """The rank from which a key counts as hot."""
    mean = float((2 ** (np.frombuffer(ranks, np.uint8) / 6.0) - 1).mean())
    return int(rank_of(np.array([HOT + 2 * mean]))[0])


def prefixes(docs: DataFrame, width: int, percent: int, ranked: bytes) -> DataFrame:
    """(doc_id, n, s1, s2, keys, bits, next): set size and sums, prefix keys, bitmap, and the bitmap for the next band if that is larger."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranks = docs.sparkSession.sparkContext.broadcast(ranked)
    names = ["doc_id", "n", "s1", "s2", "keys", "bits", "next"]

    @releasing
    def build(batches) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks.value, np.uint8)
        for batch in batches:
            for lo, hi, data, offsets in chunks(*text_buffers(batch.column("text"))):
                ns, s1, s2, keys, lengths, bits, wider = [], [], [], [], [], [], []
                for u in sets_of(data, offsets, width):
                    n = len(u)
                    ns.append(n)
                    s1.append(int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if n else 0)
                    s2.append(int(mix(u ^ np.uint64(0x14057B7EF767814F)).sum().view(np.int64)) if n else 0)
                    key = np.sort(rank[_cell(u)].astype(np.uint64) << np.uint64(56) | (u & np.uint64(0xFFFFFFFFFFFFFF)))
                    take = n - (percent * n + 99) // 100 + 1 if n else 0
                    keys.append(key[:take].view(np.int64))
                    lengths.append(take)
                    at, band = mix(u), _band(n, percent) if n else 0
                    own, more = (_bits(x, percent) for x in (band, band + 1))
                    bits.append(_bitmap(at, own))
                    wider.append(_bitmap(at, more) if more > own else None)
                bounds = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(keys))), pa.array(bits, pa.binary()), pa.array(wider, pa.binary())],
                    names=names,
                )

    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {kind}, n long, s1 long, s2 long, keys array<long>, bits binary, next binary")


def _bitmap(at: np.ndarray, size: int) -> bytes:
    word = np.zeros(size, np.uint8)
    word[(at & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(word).tobytes()


def _band(n: int, percent: int) -> int:
    """Rises by one where sizes grow by 100 / percent; sizes at a bound go to the upper band."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))


def _bits(band: int, percent: int) -> int:
    """Bits of the bitmaps of a band: four to eight for each element of its largest sets, 1,024 at least, a power of two."""
    return max(BITMAP_BITS, 1 << int(np.ceil(np.log2((100 / percent) ** (band + 1) * 4))))


def bounded(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule the link out."""
    side = lambda x: signs.select(F.col("doc_id").alias(x), *(F.col(c).alias(c + x) for c in ("n", "bits", "next")))

    @releasing
    def check(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column("n" + x).to_numpy() for x in "ab"]
            maps = [batch.column(c + x) for x in "ab" for c in ("bits", "next")]
            keep = []
            for i, (na, nb) in enumerate(zip(*sizes, strict=True)):
                short, wide, long_ = (maps[0][i], maps[1][i], maps[2][i]) if na <= nb else (maps[2][i], maps[3][i], maps[0][i])
                x, y = short.as_buffer(), long_.as_buffer()
                if x.size != y.size and wide.is_valid:
                    x = wide.as_buffer()
                if x.size != y.size:  # too far apart in size to be compared
                    keep.append(True)
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                lacks, extra = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
                room = min(min(na, nb) - lacks, max(na, nb) - extra)
                keep.append(100 * room >= percent * (na + nb - room))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "nexta", "bitsb", "nextb").mapInArrow(check, "a long, b long")


def linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, checked on sorted arrays of the documents concerned. A written table."""
    pairs = session.kept_table(pairs)
    named = session.kept_table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())

    @releasing
    def arrays(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(*text_buffers(batch.column("text"))):
                found = list(sets_of(data, offsets, width))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), binary_column(np.concatenate(found).view(np.uint8), np.array([8 * len(x) for x in found]))], names=["id", "set"])

    # Written once, so that both joins read it and texts are cut into shingles once.
    elements = session.kept_table(among(docs, named).mapInArrow(arrays, "id long, set binary"))
    df = pairs.join(elements.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(elements.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    @releasing
    def check(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = session.kept_table(df.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))
    session.drop(pairs, named, elements)
    return links


def _shorter(n: Column, percent: int) -> Column:
    """How many of the least elements a set of ``n`` shares one of with any longer partner."""
    both = 100 + percent
    return n - F.floor((2 * percent * n + (both - 1)) / both) + 1


def _own(percent: int) -> Column:
    """``_band`` of the column n."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def tiled(mixed: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share an element of ``mixed`` and that places and bitmaps don't rule out.

    ``mixed`` has (key, doc_id, n, pos, c). Tiles and blocks are planned on these small
    rows; the bitmaps join them last.
    """
    rows = mixed.select("key", "doc_id", F.col("n").cast("long").alias("n"), "pos", "c", _own(percent).alias("own"))
    size = F.greatest(F.lit(BITMAP_BITS), F.pow(F.lit(2.0), F.ceil(F.log2(F.pow(F.lit(100 / percent), F.col("band") + 1) * 4)))) / 8
    each = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(16), F.floor(BLOCK_BYTES / size)))
    blocks = rows.select("key", F.explode(F.array("own", F.col("own") + 1)).alias("band")).groupBy("key", "band").agg(F.count(F.lit(1)).alias("m"))
    blocks = blocks.select("key", "band", F.ceil(F.col("m") / each).cast("int").alias("blocks"))
    # A document is the shorter partner in its own band's tile and in the next, the longer one in its own.
    short = F.col("pos") < _shorter(F.col("n"), percent)
    part = lambda side, step, test: F.when(test, F.struct(F.lit(side).alias("side"), (F.col("own") + step).alias("band")))
    rows = rows.withColumn("p", F.explode(F.array_compact(F.array(part(0, 0, short), part(0, 1, short), part(1, 0, F.lit(True))))))
    rows = rows.select("key", "doc_id", "n", "pos", "c", "own", "p.side", "p.band").join(blocks, ["key", "band"])
    mine, other = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    first = F.col("side") == 0
    rows = rows.withColumn("o", F.explode(other)).withColumns({"x": F.when(first, mine).otherwise(F.col("o")), "y": F.when(first, F.col("o")).otherwise(mine)})
    both = rows.join(signs.select("doc_id", "n", "bits", "next"), ["doc_id", "n"])
    both = both.select("key", "band", "x", "y", "side", "doc_id", "n", "pos", "c", F.when(F.col("band") > F.col("own"), F.coalesce("next", "bits")).otherwise(F.col("bits")).alias("bits"))

    @releasing
    def compare(batches) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "band", "x", "y"]):
            side, ids, n, pos, c = (table.column(k).to_numpy() for k in ("side", "doc_id", "n", "pos", "c"))
            raw, _ = text_buffers(table.column("bits"))
            sign = raw.reshape(len(ids), -1).view(np.uint64)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = []
            for i in a.tolist() if len(b) else []:
                able = (c[b] != c[i]) & (100 * n[i] >= percent * n[b]) & ((n[i] < n[b]) | ((n[i] == n[b]) & (ids[i] < ids[b])))
                j = b[able]
                # Of the elements that a pair shares, the first has at most the rest of both sets after it.
                room = np.minimum(n[i] - pos[i], n[j] - pos[j])
                j = j[100 * room >= percent * (n[i] + n[j] - room)]
                if len(j):
                    lacks = np.bitwise_count(sign[i] & ~sign[j]).sum(axis=1, dtype=np.int64)
                    extra = np.bitwise_count(sign[j] & ~sign[i]).sum(axis=1, dtype=np.int64)
                    room = np.minimum(n[i] - lacks, n[j] - extra)
                    j = j[100 * room >= percent * (n[i] + n[j] - room)]
                    if len(j):
                        found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(found, axis=1), axis=1)], names=["a", "b"])

    dealt = both.repartition("key", "band", "x", "y").sortWithinPartitions("key", "band", "x", "y")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _labels(rows: DataFrame, sure: DataFrame) -> DataFrame:
    """``rows`` with the component c of each document."""
    return rows.join(sure, F.col("doc_id") == F.col("id"), "left").withColumn("c", F.coalesce("component", "doc_id")).drop("id", "component")


def _live(rows: DataFrame, percent: int) -> DataFrame:
    """The rows in a tile (see ``tiled``) that has a shorter and a longer side and several components; a pair that may link shares its first element there."""
    rows = rows.withColumns({"_own": _own(percent), "_short": F.col("pos") < _shorter(F.col("n").cast("long"), percent)})
    own = F.struct(F.col("_own").alias("band"), F.col("_short").alias("short"), F.lit(True).alias("long"))
    above = F.when(F.col("_short"), F.struct((F.col("_own") + 1).alias("band"), F.lit(True).alias("short"), F.lit(False).alias("long")))
    tiles = rows.select("key", "c", F.explode(F.array_compact(F.array(own, above))).alias("t")).groupBy("key", "t.band")
    tiles = tiles.agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("t.short").alias("short"), F.max("t.long").alias("long")).where("lo <> hi and short and long")
    bands = tiles.groupBy("key").agg(F.collect_set("band").alias("_bands"))  # bands rise with the logarithm of sizes, so a key has few
    return rows.join(bands, "key").where(F.array_contains("_bands", F.col("_own")) | (F.col("_short") & F.array_contains("_bands", F.col("_own") + 1))).drop("_own", "_short", "_bands")


def _several(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of the elements whose documents are in several components; of elements with the same documents, the first.

    Rows without another row of the element that their size lets link, and those that no
    tile can pair, are left out first.
    """
    by_size = W.partitionBy("key").orderBy("n", "doc_id")
    rows = rows.withColumns({"_less": F.lag("n").over(by_size), "_more": F.lead("n").over(by_size)})
    rows = rows.where((100 * F.col("_less") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("_more"))).drop("_less", "_more")
    rows = _live(rows, percent)
    flipped = F.col("key").bitwiseXOR(F.lit(-(2**63)))  # the order of keys is that of unsigned numbers
    keys = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("lo <> hi")
    first = keys.groupBy("m", "x", "y").agg(F.min(flipped).alias("key")).select(flipped.alias("key"))
    return session.kept_table(rows.join(first, "key", "left_semi"))


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, way, a): for each way, the partner that a document meets most often and that its size lets link."""
    fits = 100 * F.least("a.n", "n") >= percent * F.greatest("a.n", "n")
    often = rows.where(fits).select("doc_id", "way", F.col("a.doc_id").alias("a")).where("a <> doc_id").groupBy("doc_id", "way", "a").agg(F.count(F.lit(1)).alias("times"))
    return often.groupBy("doc_id", "way").agg(F.max_by("a", F.struct("times", "a")).alias("a"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()


def _over(links: DataFrame, sure: DataFrame | None) -> DataFrame:
    """The components after further links, which join whole components of ``sure``."""
    if sure is None:
        return components(links)
    of = lambda x: sure.select(F.col("id").alias(x), F.col("component").alias("c" + x))
    bridges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(bridges).withColumnsRenamed({"id": "c", "component": "o"})
    moved = sure.join(over, F.col("component") == F.col("c"), "left").select("id", F.coalesce("o", "component").alias("component"))
    return session.kept_table(moved.unionByName(over.join(sure, F.col("c") == F.col("id"), "left_anti").select(F.col("c").alias("id"), F.col("o").alias("component"))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = frequency_ranks(docs, width)
    sets = session.kept_table(prefixes(docs, width, percent, ranks))
    full = sets.where("n > 0 and doc_id is not null")
    classes = session.kept_table(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    # One row of each class; several where rows of one doc_id differ. Only rows that may be copies are shuffled.
    copies = session.kept_table(full.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).where("doc_id <> rep").select("doc_id", "n", "s1", "s2"))
    some, others = split_by_ids(full, session.kept_table(copies.select("doc_id").distinct()))
    reps = others.unionByName(some.join(copies, ["doc_id", "n", "s1", "s2"], "left_anti").select(*full.columns))
    # Rows that share a doc_id: equal ones are read once, and different ones link their classes.
    several = session.kept_table(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    twice = full.join(several, "doc_id").join(classes, ["n", "s1", "s2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    texts = docs.where("doc_id is not null")
    if not several.isEmpty():
        some, others = split_by_ids(texts, several)
        texts = some.dropDuplicates(["doc_id", "text"]).unionByName(others)

    reps = reps if several.isEmpty() else reps.dropDuplicates(["doc_id", "n", "s1", "s2"])
    signs = session.kept_table(reps.select("doc_id", "n", "bits", "next"))
    rows = reps.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("pos", "key"))
    hot = F.shiftrightunsigned("key", 56) >= hot_rank(ranks)
    rows = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    order = W.partitionBy("key", "salt").orderBy("n", "doc_id")
    whole = F.struct("n", "doc_id")
    rows = rows.withColumns({"before": F.lag(whole).over(order), "first": F.first(whole).over(order.rowsBetween(W.unboundedPreceding, 0)), "after": F.lead("doc_id").over(order)})
    # A hot key's rows meet across salts below, so one that is alone in its salt stays, whatever the salt.
    shared = session.kept_table(rows.where(F.col("before").isNotNull() | F.col("after").isNotNull() | hot).drop("after", "salt"))
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("before").alias("a")), F.struct(F.lit(1).alias("way"), F.col("first").alias("a")))
    meets = shared.select("doc_id", "n", F.explode(ways).alias("w")).select("doc_id", "n", "w.way", "w.a")
    line = W.partitionBy("key").orderBy("n", "doc_id")
    heads = shared.where(hot & F.col("before").isNull()).withColumn("a", F.lag(whole).over(line)).select("doc_id", "n", F.lit(2).alias("way"), "a")
    links = linked(bounded(_pairs(_met(meets.union(heads), percent)), signs, percent), texts, width, percent)
    sure = _over(links.unionByName(twice), None)

    mixed = _several(_labels(shared.select("key", "doc_id", "n", "pos"), sure), percent)
    session.drop(shared, links)
    named = session.kept_table(mixed.select("doc_id").distinct())
    near = session.kept_table(among(signs, named))
    session.drop(signs, named)
    for step in range(ROUNDS):
        by = W.partitionBy("key").orderBy(F.xxhash64("doc_id", F.lit(step)), "doc_id")
        beside = [F.struct(F.lit(k).alias("way"), F.lag(F.struct("n", "doc_id", "c"), k).over(by).alias("a")) for k in (1, 2, 3)]
        meets = mixed.select("doc_id", "n", "c", F.array(*beside).alias("beside")).select("doc_id", "n", "c", F.explode("beside").alias("w")).select("doc_id", "n", "c", "w.way", "w.a").where("a.c <> c")
        links = linked(bounded(_pairs(_met(meets, percent)), near, percent), texts, width, percent)
        if links.isEmpty():
            break
        sure = _over(links, sure)
        again = _several(_labels(mixed.drop("c"), sure), percent)
        session.drop(mixed, links)
        mixed = again
    sure = _over(linked(tiled(mixed, near, percent), texts, width, percent), sure)

    found = classes.join(sure, F.col("rep") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("c"))
    out = sets.select("doc_id", "n", "s1", "s2").join(found, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(session.documents(spark, sf_dir).select("doc_id", "text"))
