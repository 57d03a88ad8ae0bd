"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

1. Each document becomes its token ids and an end id; only a document longer than
   the capacity is cut, into full pieces after a first piece that may be shorter.
2. The histogram of piece lengths, at most ``capacity`` counts, is all the planner
   sees. It enumerates patterns of two or three lengths that fill a sequence
   exactly, fits how often each repeats by non-negative least squares, rounds down,
   and packs what is left by best fit, decreasing, on counts (so its cost doesn't
   grow with the number of documents).
3. Pieces get a rank among those of their length, counted in salted groups so that a
   length that many copies share is not one task, and the plan maps (length, rank)
   to a sequence and an offset.

With ``added``, as in op7 and the pipeline, an added token's string in a text gives its
id, as `tokenizers` does by default; without, it is tokenised as ordinary text.

Edge cases: null and empty text give one piece that holds only the end id; a text of
any length is cut, never shortened; equal rows are packed each on its own; an empty
table gives no pieces. Input columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import session
from .arrowtext import releasing, text_buffers

CAPACITY = 2048
END = 0
SALTS = 256
#: Fixed value: the pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text tokenised at once, and of distinct words in one call.
CHUNK = 8 << 20
JOINED = 1 << 16
_WHITE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ODD = f"[{_WHITE}] [{_WHITE}]|[{_WHITE}] $"
_LOOSE = f"^$|^[{_WHITE}]|[{_WHITE}]$"
_LOADED: dict[tuple[str, bool], Pieces] = {}


class Pieces:
    """Token ids by byte-level BPE, each distinct word of a chunk being tokenised once.

    A text is cut before every space. Pre-tokens never extend over such a cut, except
    inside longer runs of white space (a space with white space on both sides, or after
    white space at the end of the text); texts that have one, or the string of an
    added token where these count, are tokenised whole.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["id"] for t in data["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]} if added else {}
        self.any_added = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if i not in special}
        # The file's vocabulary, merged in order of id, several times faster than the library that reads the file.
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    def each(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]

    def whole(self, text: str) -> list[int]:
        """Ids of a text that is cut at the added tokens only."""
        parts = re.split(f"({self.any_added})", text) if self.added else [text]
        return [i for p in parts for i in ([self.added[p]] if p in self.added else self.encoding.encode_ordinary(p))]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word), every word with a space before it."""
        counts = np.zeros(len(words), np.int64)
        loose = pc.match_substring_regex(words, _LOOSE).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~loose)
        found: list[np.ndarray] = []
        order: list[np.ndarray] = []
        lengths = pc.binary_length(words.cast(pa.binary())).to_numpy() + 1
        total = np.cumsum(lengths[plain])
        lo = 0
        while lo < len(plain):  # joined, so that the cost of a call is shared
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + JOINED, "right")))
            some = plain[lo:hi]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(words.take(pa.array(some)).to_pylist())), np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths[some])) + 1
            counts[some] = np.diff(np.r_[0, ends])
            found.append(ids)
            order.append(some)
            lo = hi
        rest = np.flatnonzero(loose)
        if len(rest):
            ids_of = self.each([" " + w for w in words.take(pa.array(rest)).to_pylist()])
            counts[rest] = [len(x) for x in ids_of]
            found.append(np.array([i for x in ids_of for i in x], np.uint32))
            order.append(rest)
        if not found:
            return np.zeros(0, np.uint32), counts
        by = np.concatenate(order)
        ids, first = np.concatenate(found), np.zeros(len(words), np.int64)
        first[by] = np.cumsum(counts[by]) - counts[by]
        return ids[_slices(first, counts)], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = flat.dictionary_encode()
        ids, counts = self.words(coded.dictionary)
        starts = np.cumsum(counts) - counts
        heads = self.each(flat.take(pa.array(bounds[:-1])).to_pylist())
        wholes = [self.whole(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        for i, whole in zip(np.flatnonzero(odd), wholes, strict=True):
            heads[i] = whole
        head_counts = np.array([len(x) for x in heads], np.int64)
        head_starts = len(ids) + np.cumsum(head_counts) - head_counts
        ids = np.concatenate([ids, np.array([i for x in heads for i in x], np.uint32)])
        at = coded.indices.to_numpy()
        start, count = starts[at], counts[at]
        start[bounds[:-1]], count[bounds[:-1]] = head_starts, head_counts
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids[_slices(start, count)], np.diff(ends[bounds])


def _slices(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of many slices, one after another."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - first, counts)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, added: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    @releasing
    def cut(batches) -> Iterator[pa.RecordBatch]:
        if (tokenizer, added) not in _LOADED:
            _LOADED[tokenizer, added] = Pieces(tokenizer, added)
        encoder = _LOADED[tokenizer, added]
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_buffers(texts)
            lo, n = 0, batch.num_rows
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
                all_ids, counts = encoder.encode(texts.slice(lo, hi - lo))
                ends = np.cumsum(counts)
                rows, which, kept = [], [], []
                for i in range(hi - lo):
                    ids = np.append(all_ids[ends[i] - counts[i] : ends[i]], np.uint32(END)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for k in range(len(bounds) - 1):
                        part = ids[bounds[k] : bounds[k + 1]]
                        rows.append((k, bounds[k], len(part), zlib.crc32(part.tobytes())))
                        which.append(lo + i)
                        if with_ids:
                            kept.append(part)
                piece, start, length, crc = zip(*rows, strict=True)
                columns = [batch.column("doc_id").take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                lo = hi

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def patterns(counts: np.ndarray, capacity: int, spread: int = 8) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence: all pairs, and triples spread over the common lengths."""
    have = np.flatnonzero(counts)
    have = have[(have > 0) & (have < capacity)]
    if len(have) == 0:
        return np.zeros((0, 3), np.int64)
    rows = [(a, capacity - a, 0) for a in have if 2 * a >= capacity and counts[capacity - a]]
    weight = np.cumsum(counts[have])
    for a in have[3 * have >= capacity]:
        rest = capacity - a
        fits = have[(have * 2 <= rest) | (have == rest // 2)]
        if len(fits) == 0:
            continue
        at = np.searchsorted(weight, np.linspace(0, weight[len(fits) - 1], spread, endpoint=False) + weight[len(fits) - 1] / (2 * spread))
        for b in set(have[np.minimum(at, len(fits) - 1)].tolist()):
            c = rest - b
            if 0 < b <= c <= a and counts[c]:
                rows.append((a, c, b))
    return np.array(sorted(set(rows)), np.int64).reshape(-1, 3)


def fitted_repeats(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - counts|**2, by accelerated projected gradient."""
    if len(rows) == 0:
        return np.zeros(0)
    want = counts.astype(float)
    want[0] = 0

    def made(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(rows[:, k], x, len(counts)) for k in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    probe = np.ones(len(rows))
    for _ in range(20):  # largest eigenvalue by power iteration
        probe = back(made(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(made(y) - want) / (1.05 * norm))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def planned(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[( [(length, how many), ...], repeats ), ...] that uses up ``counts`` exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    if left[capacity]:
        out.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    rows = patterns(left, capacity)
    x = np.floor(fitted_repeats(rows, left) + 1e-6).astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        if x[k] <= 0:
            break
        need: dict[int, int] = defaultdict(int)
        for v in rows[k].tolist():
            if v:
                need[v] += 1
        repeats = min(int(x[k]), *(int(left[v]) // m for v, m in need.items()))
        if repeats > 0:
            out.append((list(need.items()), repeats))
            for v, m in need.items():
                left[v] -= repeats * m
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, decreasing, on counts: bins with equal room and contents are one entry."""
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for v in range(capacity, 0, -1):
        need = int(left[v])
        if not need:
            continue
        for r in sorted(k for k in room if k >= v and room[k]):
            fit = r // v
            for entry in room.pop(r):
                bag, m = entry
                use = min(m, need // fit)
                if use:
                    room[r - fit * v].append(([*bag, (v, fit)], use))
                    need -= use * fit
                    m -= use
                if m and need:  # fewer are left than this bin could take
                    room[r - need * v].append(([*bag, (v, need)], 1))
                    need, m = 0, m - 1
                if m:
                    room[r].append((bag, m))
            if not need:
                break
        fit = capacity // v
        if need // fit:
            room[capacity - fit * v].append(([(v, fit)], need // fit))
        if need % fit:
            room[capacity - need % fit * v].append(([(v, need % fit)], 1))
    return [x for entries in room.values() for x in entries]


def slot_table(plan: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), and the first sequence and the offset of each slot."""
    given: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for bag, repeats in plan:
        offset = 0
        for v, m in bag:
            for _ in range(m):
                rows.append((v << 44 | given[v], sequence, offset))
                given[v] += repeats
                offset += v
        sequence += repeats
    rows.sort()
    keys, sequences, offsets = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 3))
    return keys, sequences, offsets


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; ``pieces`` should be computed once (see ``session.kept``)."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    groups = session.kept(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    slots = pieces.sparkSession.sparkContext.broadcast(slot_table(planned(counts, capacity)))

    before = F.sum("n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    first = groups.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_first"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(first, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_l", "_s", "_first", "_salt")
    names = pieces.columns

    @releasing
    def place(batches) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = slots.value
        for batch in batches:
            key = batch.column("length").to_numpy() << 44 | batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, added: bool = True) -> DataFrame:
    return packed(session.kept(pieces_of(docs, tokenizer or default_tokenizer(), capacity, with_ids, added)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(session.documents(spark, sf_dir))
