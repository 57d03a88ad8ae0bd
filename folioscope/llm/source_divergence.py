"""Source divergence audit: how far apart the word use of a language's sources is, and by which terms.

Terms are counted inside the tasks that read the texts and combined before they are
shuffled. The kept terms of a language fall into blocks by a hash, its sources into
tiles; a task holds a dense int64 matrix of the sources of two tiles by the terms of one
block, broadcasts all pairs of sources over it and returns their partial sums, which are
added up over the blocks, and a heap of the best terms of each source, which are merged.

All arithmetic is on integers. A share is ``1 + floor(10**9 (count + 1) / (N + V))``,
divided in three steps of a thousand; it is exact while N + V is under 9 * 10**15, and
the sums of divergences while V is under 2 * 10**9.

Edge cases: null text, language and source are read as ''. A group without terms counts
with its added ones; where a language keeps no term every divergence is 0 and there are
no term rows. Repeated rows are documents of their own, whatever their ids; doc_id isn't
read. Texts of any length are counted whole. Equal values rank by the item's UTF-8
bytes. A language of one source has term rows only; an empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import session
from .arrowtext import chunks, gather, releasing, text_buffers
from .secret_scan import runs

#: Documents of a language that must have a term.
LEAST_DOCUMENTS = 3
#: Terms of a source that are reported.
TOP = 200
#: Terms of a block (about) and sources of a tile; they bound a task's matrix.
TERMS, SOURCES = 512, 256
UNIT = 10**9
#: Bytes of text that are counted at once, counts that a task holds before it passes them on, and rows that it passes on at once.
BYTES, HELD, SENT = 1 << 19, 200_000, 20_000
#: Elements of a broadcast of pairs.
PAIRS = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 32


def lists(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings of ``values`` between starts and ends."""
    lengths = ends - starts
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32).tobytes()), pa.py_buffer(gather(values, starts, lengths).tobytes()))


def chunk_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, count, documents) of a chunk whose rows belong to the numbered groups."""
    starts, ends = runs(_LETTER[data], offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    words = lists(_LOWERED[data], starts, ends).dictionary_encode()
    n = max(1, len(words.dictionary))
    codes = words.indices.to_numpy().astype(np.int64)
    pairs, times = np.unique(rows * n + codes, return_counts=True)
    keys, where = np.unique(groups[pairs // n] * n + pairs % n, return_inverse=True)
    count = np.zeros(len(keys), np.int64)
    np.add.at(count, where, times)
    return keys // n, words.dictionary.take(pa.array(keys % n)), count, np.bincount(where, minlength=len(keys)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, m): occurrences and documents of each term in each group, each task's own; to be summed."""
    names = ["lang", "source", "term", "n", "m"]

    def combined(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["g", "term"]).aggregate([("n", "sum"), ("m", "sum")]).rename_columns(["g", "term", "n", "m"])

    def named(table: pa.Table, groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        for some in table.combine_chunks().to_batches(max_chunksize=SENT):
            yield pa.RecordBatch.from_arrays([lang.take(some.column("g")), source.take(some.column("g")), *(some.column(c) for c in ("term", "n", "m"))], names=names)

    @releasing
    def count(batches) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, {}
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            pairs = zip(*(pc.fill_null(batch.column(c), "").to_pylist() for c in ("lang", "source")), strict=True)
            groups = np.array([known.setdefault(p, len(known)) for p in pairs], np.int64)
            for lo, hi, some, at in chunks(data, offsets, BYTES):
                group, term, n, m = chunk_counts(some, at, groups[lo:hi])
                held.append(pa.table([pa.array(group), term, pa.array(n), pa.array(m)], names=["g", "term", "n", "m"]))
                size += len(n)
                if size > 2 * HELD:
                    held = [combined(held)]
                    size = len(held[0])
                    if size > HELD:
                        yield from named(held[0], list(known))
                        held, size = [], 0
        if held:
            yield from named(combined(held), list(known))

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, m long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total, head): counts of the kept terms, their sums over the language, and one row of each term marked."""
    sums = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    term = W.partitionBy("lang", "term")
    sums = sums.withColumns({"total": F.sum("n").over(term), "in_docs": F.sum("m").over(term), "head": F.col("source") == F.min("source").over(term)})
    return session.kept_table(sums.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "head"))


def numbered_groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, g, tile, n_group, n_lang, v, blocks), one row for each occurring group; g counts from 0 in each language."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count_if("head").alias("v"))
    lang = W.partitionBy("lang")
    df = groups.join(sums, ["lang", "source"], "left").fillna(0, ["n_group", "v"])
    df = df.withColumns({"g": F.row_number().over(lang.orderBy("source")) - 1, "n_lang": F.sum("n_group").over(lang), "v": F.sum("v").over(lang)})
    return session.kept_table(df.select("lang", "source", "g", F.floor(F.col("g") / SOURCES).cast("int").alias("tile"), "n_group", "n_lang", "v", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("long").alias("blocks")))


def shares(counts: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """``1 + floor(10**9 (counts + 1) / (n + v))``, which never multiplies more than a remainder by a thousand."""
    of = n + v
    out, rest = np.divmod(counts + 1, of)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        out = out * 1000 + more
    return out + 1


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over terms of ``floor((p - q)**2 / q)`` for all rows of p against all rows of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, PAIRS // max(1, q.size))
    for lo in range(0, len(p), step):
        gap = p[lo : lo + step, None, :] - q[None, :, :]
        gap *= gap
        out[lo : lo + step] = (gap // q[None, :, :]).sum(axis=2)
    return out


def best_terms(n: np.ndarray, p: np.ndarray, q: np.ndarray, terms: list[bytes], top: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, value, term) of the ``top`` best terms of each row: with a count and a share over the language's."""
    for r in range(len(n)):
        at = np.flatnonzero((n[r] > 0) & (p[r] > q))
        gap = p[r, at] - q[at]
        value = gap * gap // q[at]
        if len(at) > top:  # all that tie with the last one stay for the heap
            some = value >= np.partition(value, len(at) - top)[len(at) - top]
            at, value = at[some], value[some]
        for v, term in heapq.nsmallest(top, zip((-value).tolist(), (terms[i] for i in at.tolist()), strict=True)):
            yield r, -v, term


_PARTIAL = "lang string, part string, g int, other int, term string, value long"


def tile(top: int, sources: int):
    """One tile pair and block: from its groups and counts to partial pair sums, the best terms of each group, and how many terms it saw."""

    def partial(key, groups: pa.Table, counts: pa.Table) -> pa.Table:
        lang, a, b = (k.as_py() for k in key[:3])
        g, n_group = groups["g"].to_numpy(), groups["n_group"].to_numpy()
        n_lang, v = groups["n_lang"][0].as_py(), groups["v"][0].as_py()
        order = np.argsort(g)
        g, n_group = g[order], n_group[order]
        words = counts["term"].combine_chunks().dictionary_encode() if len(counts) else pa.array([], pa.string()).dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        term = words.indices.to_numpy()
        n, total = np.zeros((len(g), len(words.dictionary)), np.int64), np.zeros(len(words.dictionary), np.int64)
        n[np.searchsorted(g, counts["g"].to_numpy()), term] = counts["n"].to_numpy()
        total[term] = counts["total"].to_numpy()
        p = shares(n, n_group[:, None], v) if n.size else n
        left, right = g // sources == a, g // sources == b
        found = [(g[left], g[right], pair_sums(p[left], p[right]))]
        if a != b:
            found.append((g[right], g[left], pair_sums(p[right], p[left])))
        ones, others, values = (np.concatenate(x) for x in zip(*((np.repeat(x, len(y)), np.tile(y, len(x)), s.ravel()) for x, y, s in found), strict=True))
        real = ones != others
        ones, others, values = ones[real], others[real], values[real]
        best = list(best_terms(n, p, shares(total, n_lang, v), [w.encode() for w in words.dictionary.to_pylist()], top)) if a == b and n.size else []
        size = len(ones)
        return pa.table(
            {
                "lang": pa.array([lang] * (size + len(best) + 1), pa.string()),
                "part": pa.array(["pair"] * size + ["term"] * len(best) + ["seen"], pa.string()),
                "g": pa.array([*ones.tolist(), *(int(g[r]) for r, _, _ in best), a], pa.int32()),
                "other": pa.array([*others.tolist(), *[None] * len(best), b], pa.int32()),
                "term": pa.array([*[None] * size, *(t.decode() for _, _, t in best), None], pa.string()),
                "value": pa.array([*values.tolist(), *(x for _, x, _ in best), len(words.dictionary)], pa.int64()),
            }
        )

    return partial


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source beside each other one of its language, and its ``top`` terms."""
    terms = kept_terms(docs, least)
    groups = numbered_groups(docs, terms)
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"), F.first("blocks").alias("blocks")).select("lang", "last", "blocks")

    def beside(df: DataFrame, block) -> DataFrame:
        """Each row once for each pair of tiles (a <= b) that has its own."""
        other = F.explode(F.sequence(F.lit(0), F.col("last")))
        return df.join(tiles, "lang").withColumn("_o", other).withColumns({"a": F.least("tile", "_o"), "b": F.greatest("tile", "_o"), "block": block}).drop("_o", "last", "blocks")

    by_group = F.struct("lang", "source")
    numbers = groups.select(by_group.alias("key"), F.col("g").alias("g"), F.col("tile").alias("tile"))  # other columns than those of ``members``
    # A group's counts are at most its language's terms, so no group is hotter than that; broadcast only where few groups are counted.
    numbered = session.join_small(terms.select(by_group.alias("key"), "lang", "term", "n", "total"), numbers, "key", "term", how="inner").drop("key")
    counts = beside(numbered, F.pmod(F.xxhash64("term"), F.col("blocks")))
    members = beside(groups.select("lang", "g", "tile", "n_group", "n_lang", "v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["lang", "a", "b", "block"]
    partial = members.groupBy(*key).cogroup(counts.groupBy(*key)).applyInArrow(tile(top, SOURCES), _PARTIAL)
    partial = session.kept_table(partial)
    names = groups.select("lang", "g", "source")
    pairs = partial.where("part = 'pair'").groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    sides = groups.select("lang", "g", "tile", "v", F.expr(f"1 + {UNIT} div greatest(n_group + v, 1)").alias("p"))
    others = groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item"), F.col("tile").alias("tile2"), F.expr(f"1 + {UNIT} div greatest(n_group + v, 1)").alias("q"))
    # Kept terms that no source of the two tiles has were not in their matrices; all of them are alike there.
    seen = partial.where("part = 'seen'").groupBy("lang", F.col("g").alias("a"), F.col("other").alias("b")).agg(F.sum("value").alias("seen"))
    pairs = pairs.join(sides, ["lang", "g"]).join(others, ["lang", "other"]).withColumns({"a": F.least("tile", "tile2"), "b": F.greatest("tile", "tile2")}).join(seen, ["lang", "a", "b"])
    pairs = pairs.select("lang", "g", F.lit("pair").alias("part"), "item", F.expr("value + IF(v > seen, (v - seen) * ((p - q) * (p - q) div q), 0)").alias("value"))
    best = partial.where("part = 'term'").select("lang", "g", "part", F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "g").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    both = pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
    return both.join(names, ["lang", "g"]).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(session.documents(spark, sf_dir))


_SHARE = f"1 + ({UNIT}::HUGEINT * ({{}} + 1)) // ({{}} + v)"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT r, lang, source, unnest(words) AS w FROM d)),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS n_group, sum(n) OVER (PARTITION BY lang) AS n_lang, sum(n) OVER (PARTITION BY lang, term) AS total,
  count(*) OVER (PARTITION BY lang, source) AS v FROM x),
p AS (SELECT lang, source, term, n, ({_SHARE.format("n", "n_group")})::BIGINT AS p, ({_SHARE.format("total", "n_lang")})::BIGINT AS q FROM s),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v
  ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
