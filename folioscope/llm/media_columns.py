"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton finds every magic byte sequence in a cell in one pass; a
validator for each format then walks the structure at that place (chunk lengths and
checksums, size fields, markers) and gives the medium's true length, or rejects the
hit. A valid medium at byte 0 corrects the declared type; valid media further in are
carved (the first to start wins where they overlap).

``store_media`` writes a payload losslessly as 8-bit samples in one of four formats
(picked by a checksum of the payload, so equal payloads are stored alike), and
``payload_of`` reads the samples back from the carved bytes.

Edge cases: a null or empty cell has no medium; cells of any length are scanned
whole; equal cells give equal values; an empty table gives an empty result. Other
columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import session

#: Magic bytes and formats; fixed values of the formats' specifications.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "png",
    b"\xff\xd8\xff": "jpeg",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"BM": "bmp",
    b"RIFF": "wav",
    b"P5\n": "pgm",
    b"%PDF-": "pdf",
    b"\x1f\x8b\x08": "gzip",
    b"fLaC": "flac",
}
STORED = ("wav", "png", "bmp", "pgm")
WIDTH = 64


def _png(b: bytes, at: int) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return None


def _wav(b: bytes, at: int) -> int | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i, seen = at + 12, set()
    while i + 8 <= min(end, len(b)):
        kind, n = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        seen.add(kind)
        i += 8 + n + n % 2
    return end - at if i == end <= len(b) and {b"fmt ", b"data"} <= seen else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, _, offset, header, width, height, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    stride = (width * depth + 31) // 32 * 4
    ok = header == 40 and planes == 1 and depth in (1, 4, 8, 24, 32) and packing == 0 and width > 0 and size == offset + stride * abs(height) and at + size <= len(b)
    return size if ok else None


def _pgm(b: bytes, at: int) -> int | None:
    head = b[at : at + 40].split(b"\n", 3)
    try:
        (w, h), top = map(int, head[1].split()), int(head[2])
    except (ValueError, IndexError):
        return None
    n = len(head[0]) + len(head[1]) + len(head[2]) + 3 + w * h
    return n if len(head) == 4 and w > 0 and h > 0 and top == 255 and at + n <= len(b) else None


def _jpeg(b: bytes, at: int) -> int | None:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        marker, n = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        i += 2 + n
        if marker == 0xDA:
            end = b.find(b"\xff\xd9", i)
            return end + 2 - at if end > 0 else None
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 14:
        return None
    flags, i = b[at + 10], at + 13
    i += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 < len(b):
            local = b[i + 9]
            i += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def _pdf(b: bytes, at: int) -> int | None:
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else None


def _gzip(b: bytes, at: int) -> int | None:
    d, i = zlib.decompressobj(31), at
    try:
        while i < len(b) and not d.eof:
            d.decompress(b[i : i + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            i += 65536
    except zlib.error:
        return None
    return min(i, len(b)) - len(d.unused_data) - at if d.eof else None


def _flac(b: bytes, at: int) -> int | None:
    ok = len(b) >= at + 42 and b[at + 4] & 0x7F == 0 and int.from_bytes(b[at + 5 : at + 8], "big") == 34
    return len(b) - at if ok else None  # frames carry no total length


VALIDATORS = {"png": _png, "wav": _wav, "bmp": _bmp, "pgm": _pgm, "jpeg": _jpeg, "gif": _gif, "pdf": _pdf, "gzip": _gzip, "flac": _flac}


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        self.automaton.make_automaton()

    def media(self, cell: bytes) -> list[tuple[int, int, str]]:
        """(offset, length, format) of the valid media in the cell; none lies in another."""
        out, end = [], 0
        hits = sorted((at + 1 - n, kind) for at, (n, kind) in self.automaton.iter(cell.decode("latin-1")))
        for at, kind in hits:
            if at >= end and (n := VALIDATORS[kind](cell, at)):
                out.append((at, n, kind))
                end = at + n
        return out


def stored(payload: bytes, kind: str) -> bytes:
    """The payload, a multiple of 64 bytes, as 8-bit samples of a sound or grey image 64 wide."""
    n, rows = len(payload), len(payload) // WIDTH
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload
    if kind == "bmp":  # rows from the top: negative height
        palette = b"".join(bytes((g, g, g, 0)) for g in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, WIDTH, -rows, 1, 8, 0, n, 2835, 2835, 256, 256) + palette + payload
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, n, WIDTH))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 1)) + part(b"IEND", b"")


def payload_of(cell: bytes, at: int, n: int, kind: str) -> bytes:
    """The samples of a medium that ``stored`` wrote."""
    if kind == "wav":
        return cell[at + 44 : at + n]
    if kind == "bmp":
        return cell[at + struct.unpack_from("<I", cell, at + 10)[0] : at + n]
    if kind == "pgm":
        return cell[at : at + n].split(b"\n", 3)[3]
    i, parts = at + 8, []
    while i < at + n:
        size, name = struct.unpack_from(">I4s", cell, i)
        if name == b"IDAT":
            parts.append(cell[i + 8 : i + 8 + size])
        i += 12 + size
    lines = zlib.decompress(b"".join(parts))
    return b"".join(lines[i + 1 : i + 1 + WIDTH] for i in range(0, len(lines), WIDTH + 1))


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text as a medium; a third are declared as something else."""
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def store(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                sizes, declared, media = [], [], []
                for text in some.column("text"):
                    raw = (text.as_py() or "").encode()
                    payload = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
                    mark = zlib.crc32(payload)
                    kind = STORED[mark % len(STORED)]
                    sizes.append(len(raw))
                    declared.append(kind if mark % 3 else STORED[(mark + 1) % len(STORED)])
                    media.append(stored(payload, kind))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(declared), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind_of_id}, n_bytes long, declared string, media binary")


def sniffed(cells: DataFrame, media: str = "media", declared: str = "declared", payload: bool = False) -> DataFrame:
    """All columns, plus detected, corrected, parts (offset, length, format) and, if asked, payload.

    ``detected`` is the format of a valid medium at byte 0, else null; ``corrected``
    says that it differs from the declared one.
    """
    added = ["detected", "corrected", "parts", *["payload"] * payload]
    own = [f for f in cells.schema.fields if f.name not in added]
    names = [f.name for f in own]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["detected string, corrected boolean, parts array<struct<offset: bigint, length: bigint, format: string>>"] + ["payload binary"] * payload)
    part = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("format", pa.string())]))

    def sniff(batches) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                detected, corrected, parts, payloads = [], [], [], []
                for cell, said in zip(some.column(media), some.column(declared), strict=True):
                    cell = cell.as_py() or b""
                    found = sniffer.media(cell)
                    kind = found[0][2] if found and found[0][0] == 0 else None
                    detected.append(kind)
                    corrected.append(kind is not None and kind != said.as_py())
                    parts.append([{"offset": a, "length": n, "format": k} for a, n, k in found])
                    if payload:
                        payloads.append(payload_of(cell, *found[0]) if kind in STORED else None)
                columns = [*(some.column(c) for c in names), pa.array(detected, pa.string()), pa.array(corrected, pa.bool_()), pa.array(parts, part)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(payloads, pa.binary())] * payload], names=[*names, *added])

    return cells.select(*names).mapInArrow(sniff, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sniffed(store_media(session.documents(spark, sf_dir)), payload=True)
    kind = cells.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.select(["media", "payload", "declared", "detected", "corrected", "parts"]).to_pylist():
                p, m = row["payload"], row["media"]
                feature = f"{row['detected']};declared={row['declared']};corrected={str(row['corrected']).lower()};media={len(row['parts'])};mean={sum(p) / len(p):.4f}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    return cells.mapInArrow(digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
