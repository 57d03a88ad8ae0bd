"""Secret scans: known forms, and strings of high entropy in a sliding window.

Base kinds follow from a form: assignments, access keys and long hexadecimal runs.
Beyond them, maximal runs of token characters are candidates. Inside a candidate, each
character class has its own alphabet, window and least entropy; the counts of a window
come from those of the one before by one character in and one out, for all candidates
of a chunk at once. Windows over the bound join into spans of kind ``entropy``, unless
they lie inside a base span, run along the alphabet, or an allow-list knows them.

Edge cases: null and empty texts have no secrets. Texts of any length are scanned whole;
a long candidate is cut into segments that overlap by a window, so nothing is missed at
a cut. Rows are judged one by one, so repeated rows get equal spans and an empty table
an empty result. Other columns pass through; one named like a computed column is
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session
from .arrowtext import chunks, gather, releasing, text_buffers

DIGITS, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN = DIGITS + LOWER + UPPER + b"+/_.=-"
KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX, LEAST_CANDIDATE = 8, 16, 32, 20


class CharacterClass(NamedTuple):
    """Windows of ``window`` characters of the alphabet with at least ``bits`` of entropy each and the named numbers of some characters."""

    name: str
    alphabet: bytes
    window: int
    bits: float
    needs: tuple[tuple[bytes, int], ...]


CLASSES = (
    CharacterClass("hexadecimal", DIGITS + b"abcdefABCDEF", 24, 3.0, ((DIGITS, 4), (b"abcdefABCDEF", 4))),
    CharacterClass("lower", DIGITS + LOWER, 24, 3.6, ((DIGITS, 4), (LOWER, 4))),
    CharacterClass("base64", DIGITS + LOWER + UPPER + b"+/_-", 20, 3.9, ((DIGITS, 2), (LOWER, 2), (UPPER, 2))),
)
#: Candidates that hold one of these are no secrets: placeholders, digests of nothing, identifiers.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)",
    r"d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb924",
    r"(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])",
)
#: Entropy in whole units, so that sums are exact in any order.
SCALE = 1 << 20
#: Windows of one segment of a long candidate.
SEGMENT = 256


def table(alphabet: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(alphabet, np.uint8)] = True
    return out


_TOKEN, _HEX = table(TOKEN), table(DIGITS + b"abcdef")


def runs(inside: np.ndarray, offsets: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values of at least ``least``, none across an offset."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, inside[:-1]] & ~edge[:-1], np.r_[inside[1:], False] & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def spread(window: int) -> np.ndarray:
    """c log2 c for each count, in units of 1 / SCALE."""
    c = np.arange(window + 1)
    return np.rint(c * np.log2(np.maximum(c, 1)) * SCALE).astype(np.int64)


def window_sums(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, sum of c log2 c over its counts c) for the runs of ``codes`` (under 128) from starts to ends.

    All segments advance together: at each step one character enters each count and one
    leaves it.
    """
    n = ends - starts - window + 1
    parts = -(-n // SEGMENT)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    at, many = np.repeat(starts, parts) + k * SEGMENT, np.minimum(SEGMENT, np.repeat(n, parts) - k * SEGMENT)
    order = np.argsort(-many, kind="stable")
    at, many = at[order], many[order]
    weight = spread(window)
    counts, sums = np.zeros((len(at), 128), np.int16), np.zeros(len(at), np.int64)

    def change(rows: int, places: np.ndarray, by: int) -> None:
        where = np.arange(rows), codes[places]
        had = counts[where]
        counts[where] = had + by
        sums[:rows] += weight[had + by] - weight[had]

    for j in range(window):
        change(len(at), at + j, 1)
    found_at, found = [at], [sums.copy()]
    for j in range(1, int(many.max()) if len(many) else 0):
        rows = int(np.searchsorted(-many, -j, "left"))  # segments with more than j windows
        change(rows, at[:rows] + j - 1, -1)
        change(rows, at[:rows] + j + window - 1, 1)
        found_at.append(at[:rows] + j)
        found.append(sums[:rows].copy())
    return np.concatenate(found_at), np.concatenate(found)


def entropic(codes: np.ndarray, offsets: np.ndarray, classes: tuple[CharacterClass, ...] = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the joined windows of high entropy in the candidates between the offsets."""
    cover = np.zeros(len(codes) + 1, np.int64)
    for c in classes:
        starts, ends = runs(table(c.alphabet)[codes], offsets, c.window)
        if not len(starts):
            continue
        at, sums = window_sums(codes, starts, ends, c.window)
        good = sums <= round((np.log2(c.window) - c.bits) * c.window * SCALE)
        for some, least in c.needs:
            upto = np.r_[0, np.cumsum(table(some)[codes])]
            good &= upto[at + c.window] - upto[at] >= least
        np.add.at(cover, at[good], 1)
        np.add.at(cover, at[good] + c.window, -1)
    return runs(np.cumsum(cover[:-1]) > 0, offsets)


def keyword_matches(raw: bytes, lowered: bytes, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of assignments and access keys, leftmost first and without overlaps within a kind."""
    for kind, form, text, words in ((0, ASSIGN, lowered, KEYWORDS), (1, ACCESS, raw, (b"AKIA",))):
        places = []
        for word in words:
            p = text.find(word)
            while p >= 0:
                places.append(p)
                p = text.find(word, p + 1)
        done = 0
        for p in sorted(places):
            if p < done:
                continue
            m = form.match(raw, p, int(offsets[np.searchsorted(offsets, p, "right")]))
            if m is None:
                continue
            done = m.end()
            if (len(m[2]) >= LEAST_ASSIGNED) if kind == 0 else (done - p >= LEAST_ACCESS):
                yield kind, p, done


def scanned(data: np.ndarray, offsets: np.ndarray, allowed: list[re.Pattern]) -> np.ndarray:
    """(row, start, end, kind) of all spans of a chunk, in bytes of the chunk, by row, start and kind."""
    raw = data.tobytes()
    spans = [(s, e, k) for k, s, e in keyword_matches(raw, raw.lower(), offsets)]
    spans += [(s, e, 2) for s, e in zip(*(x.tolist() for x in runs(_HEX[data], offsets, LEAST_HEX)), strict=True)]
    starts, ends = runs(_TOKEN[data], offsets, LEAST_CANDIDATE)
    if len(starts):
        codes = gather(data, starts, ends - starts)
        bounds = np.r_[0, np.cumsum(ends - starts)]
        lo, hi = entropic(codes, bounds)
        near = np.r_[0, 0, np.cumsum(np.abs(np.diff(codes.astype(np.int16))) <= 1)]  # steps between neighbours of the alphabet
        calm = 2 * (near[hi] - near[lo + 1]) < hi - lo
        which = np.searchsorted(bounds, lo, "right") - 1
        known = np.array(sorted(spans), np.int64).reshape(-1, 3)
        reach = np.r_[-1, np.maximum.accumulate(known[:, 1])]  # the furthest end of the base spans before each
        for s, e, c, ok in zip((lo - bounds[which] + starts[which]).tolist(), (hi - bounds[which] + starts[which]).tolist(), which.tolist(), calm.tolist(), strict=True):
            if ok and reach[np.searchsorted(known[:, 0], s, "right")] < e:
                candidate = raw[starts[c] : ends[c]].decode()
                if not any(p.search(candidate) for p in allowed):
                    spans.append((s, e, 3))
    out = np.array(spans, np.int64).reshape(-1, 3)
    rows = np.searchsorted(offsets, out[:, 0], "right") - 1
    order = np.lexsort((out[:, 2], out[:, 0]))
    return np.c_[rows, out][order]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def span_lists(data: np.ndarray, offsets: np.ndarray, spans: np.ndarray) -> pa.Array:
    """One list of (kind, start, end) for each row, in code points of the row."""
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if len(spans) else np.zeros(1, np.int64)
    base = points[offsets[spans[:, 0]]]
    values = pa.StructArray.from_arrays([pa.array(np.array(KINDS, object)[spans[:, 3]], pa.string()), pa.array(points[spans[:, 1]] - base), pa.array(points[spans[:, 2]] - base)], fields=list(_SPAN))
    upto = np.searchsorted(spans[:, 0], np.arange(len(offsets)), "left")
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values)


def masked(data: np.ndarray, offsets: np.ndarray, spans: np.ndarray, mark: bytes) -> list[str]:
    """Each row's text with every joined span replaced by the mark."""
    raw = data.tobytes()
    out, upto = [], np.searchsorted(spans[:, 0], np.arange(len(offsets)), "left")
    for r in range(len(offsets) - 1):
        parts, done = [], int(offsets[r])
        for s, e in spans[upto[r] : upto[r + 1], 1:3].tolist():
            if e <= done:
                continue
            if s >= done and (s > done or not parts):
                parts += [raw[done:s], mark]
            done = e
        out.append(b"".join([*parts, raw[done : offsets[r + 1]]]).decode())
    return out


def with_secrets(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED, mark: str | None = None) -> DataFrame:
    """All columns plus ``secrets``, an array of (kind, start, end) in code points, end exclusive, by start and then kind.

    With ``mark``, also ``redacted``: the text with each span, or run of overlapping
    ones, replaced by the mark.
    """
    added = ["secrets", *["redacted"] * (mark is not None)]
    own = [f for f in docs.schema.fields if f.name.lower() not in added]
    names = [f.name for f in own]
    new = [T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("redacted", T.StringType())]
    schema = T.StructType([*own, *new[: len(added)]])

    @releasing
    def scan(batches) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(p) for p in allowed]
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            for lo, hi, some, at in chunks(data, offsets):
                spans = scanned(some, at, patterns)
                columns = [*(batch.column(n).slice(lo, hi - lo) for n in names), span_lists(some, at, spans)]
                if mark is not None:
                    columns.append(pa.array(masked(some, at, spans, mark.encode()), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.select(*(f"`{n}`" for n in names)).mapInArrow(scan, schema)


def listed(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_secrets(session.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    many = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(many(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
