"""Text of pages with a map back to the page: each run of text and the characters it came from.

The page is read once, token by token, in time that is linear in its length, which a fold
over a growing array of runs isn't; so this is a small step over Arrow batches. The text is
that of ``parsing.html_text``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import views as v
from ..registry import register
from .parsing import _TEXT, BLOCK_TAGS, ENTITIES

BLANKS = " \t\n\x0b\x0c\r"
INVISIBLE = "​‌‍⁠﻿­"
STRAIGHT = {"“": '"', "”": '"', "‘": "'", "’": "'"}
SPACES = BLANKS + " "
TOKENS = re.compile(
    rf"(?P<gone><(script|style)\b[^>]*>.*?</\2[{BLANKS}]*>|<!--.*?-->|<!doctype[^>]*>)|(?P<block><(?:{BLOCK_TAGS})\b[^>]*>)|(?P<tag><[^>]*>)"
    rf"|(?P<entity>&(?:{'|'.join(ENTITIES)});)|(?P<space>[{SPACES}]+)|(?P<hidden>[{INVISIBLE}]+)|(?P<text>[^<&{SPACES}{INVISIBLE}]+|[<&])",
    re.IGNORECASE | re.DOTALL | re.ASCII,
)
#: (start in the text, start in the page, length in the text, length in the page)
Run = tuple[int, int, int, int]


def mapped_text(html: str) -> tuple[str, list[Run]]:
    """The text and its runs. Between runs lies one blank or line end for all that was dropped there, or nothing."""
    out, runs, size, gap = [], [], 0, ""
    for m in TOKENS.finditer(html):
        kind, token = m.lastgroup, m.group()
        if kind == "entity":
            token = ENTITIES.get(token[1:-1], token)  # names are told by case
            if token in SPACES:
                kind = "space"
            elif token in INVISIBLE:
                kind = "hidden"
        if kind == "hidden":
            continue
        if kind in ("gone", "tag", "space", "block"):
            gap = "\n" if kind == "block" or gap == "\n" else " "
            continue
        if gap and runs:
            out.append(gap)
            size += 1
        gap = ""
        token = "".join(STRAIGHT.get(c, c) for c in token) if not token.isascii() else token
        raw = m.end() - m.start()
        last = runs[-1] if runs else None
        if last and raw == len(token) and last[2] == last[3] and last[0] + last[2] == size and last[1] + last[3] == m.start():
            runs[-1] = (last[0], last[1], last[2] + raw, last[3] + raw)
        else:
            runs.append((size, m.start(), len(token), raw))
        out.append(token)
        size += len(token)
    return "".join(out), runs


_RUNS = "array<struct<text_start: int, page_start: int, text_length: int, page_length: int>>"


#: Bytes of pages that are mapped before their rows are given out.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of the column, or of one longer row."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def html_map(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns plus ``text`` and ``runs``; places count from 0 in characters. A null page has null text and no runs."""
    names = [c for c in pages.columns if c not in ("text", "runs")]
    fields = pa.struct([(n, pa.int32()) for n in ("text_start", "page_start", "text_length", "page_length")])

    def read(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, html):
                texts, flat, ends = [], array("i"), array("i", [0])
                for page in batch.column(html):
                    text, found = (None, []) if page.as_py() is None else mapped_text(page.as_py())
                    texts.append(text)
                    for run in found:
                        flat.extend(run)
                    ends.append(len(flat) // 4)
                # Numbers, not objects: four columns of 32 bits, and where each page's runs end.
                columns = [pa.array(flat[k::4], pa.int32()) for k in range(4)]
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(fields)))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), runs], names=[*names, "text", "runs"])

    schema = pages.select(*names).limit(0).selectExpr("*", "cast(null as string) AS text", f"cast(null as {_RUNS}) AS runs").schema
    return pages.select(*names).mapInArrow(read, schema)


def faithful(text: Column, html: Column, runs: Column) -> Column:
    """Whether every run's characters are those of the page, straight quotes aside, or the character of its entity."""
    named = F.create_map(*(F.lit(x) for k, c in ENTITIES.items() for x in (f"&{k};", c)))
    plain = lambda c: F.translate(c, "".join(STRAIGHT), "".join(STRAIGHT.values()))

    def same(r):
        here = F.substring(text, r["text_start"] + 1, r["text_length"])
        raw = F.substring(html, r["page_start"] + 1, r["page_length"])
        return (here == plain(raw)) | (here == plain(F.coalesce(F.try_element_at(named, raw), F.lit(""))))

    return F.forall(runs, same)


def page_place(runs: Column, place: Column) -> Column:
    """Where a character of the text stands in the page; null between runs."""
    hit = F.get(F.filter(runs, lambda r: (r["text_start"] <= place) & (place < r["text_start"] + r["text_length"])), F.lit(0))
    return F.when(hit["text_length"] == hit["page_length"], hit["page_start"] + place - hit["text_start"]).otherwise(hit["page_start"])


def _mapped(spark, d) -> DataFrame:
    return html_map(v.table(spark, d, "pages").select("page_id", "html"))


register(
    "html_text_map",
    lambda spark, d: _mapped(spark, d).select("page_id", "text", faithful(F.col("text"), F.col("html"), F.col("runs")).alias("faithful"), F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["text_length"]).alias("mapped")),
    # Mapped are all characters but the single blanks and line ends that stand for what lies between words.
    f"WITH t AS (SELECT page_id, {_TEXT} AS text FROM pages) SELECT page_id, text, true AS faithful, CAST(length(text) - len(regexp_extract_all(text, '[ \\n]')) AS BIGINT) AS mapped FROM t",
)
register(
    "html_map_words",
    # The page around the first capitalised word of each text, through the map, must be that word.
    lambda spark, d: (lambda m: m.select("page_id", F.substring("html", page_place(F.col("runs"), F.regexp_instr("text", F.lit("[A-Z][a-z]+")) - 1) + 1, F.length(F.regexp_extract("text", "[A-Z][a-z]+", 0))).alias("word")))(_mapped(spark, d).where(F.col("text").rlike("[A-Z][a-z]+"))),
    f"WITH t AS (SELECT page_id, {_TEXT} AS text FROM pages) SELECT page_id, regexp_extract(text, '[A-Z][a-z]+') AS word FROM t WHERE regexp_matches(text, '[A-Z][a-z]+')",
)
