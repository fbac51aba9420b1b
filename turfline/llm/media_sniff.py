"""Media columns: signature sniffing, validation and carving.

A stored blob is scanned once for all magic bytes with an Aho-Corasick automaton. A validator of each format then
confirms structure and lengths at the hit; confirmed hits give the true type, correct a wrong declared type and
bound embedded media, which can be carved out. Texts are stored losslessly as 8-bit mono PCM in RIFF/WAVE
containers, one sample a byte, and are read back through the same sniffing.

Null blobs and texts count as empty; an empty text is stored as 64 zero samples. Blobs without a confirmed signature
have the type application/octet-stream. Hits inside a confirmed medium are embedded media and are listed too.
Very long texts are stored whole, in batches of their own, up to the 4 GB of a container. Ties: of media that begin at
one place the longest is listed first. Repeated rows give repeated results. An empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_batches, texts_as_bytes

UNIT = 64
SAMPLE_RATE = 16_000
UNKNOWN = "application/octet-stream"


class Medium(NamedTuple):
    kind: str
    start: int
    end: int


def _wav(b: bytes, at: int) -> int | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        seen.add(b[pos : pos + 4])
        n = int.from_bytes(b[pos + 4 : pos + 8], "little")
        pos += 8 + n + (n & 1)
    return end if {b"fmt ", b"data"} <= seen and pos in (end, end + 1) else None


def _png(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, kind = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if first and (kind != b"IHDR" or n != 13) or pos + 12 + n > len(b):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != int.from_bytes(b[pos + 8 + n : pos + 12 + n], "big"):
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 13:
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(b):
            pos += 10 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 128 else 0) + 1
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        n = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if n < 2 or not 0xC0 <= mark <= 0xFE:
            return None
        pos += 2 + n
        if mark == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return pos + 2
                pos += 2
            return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return at + size if reserved == 0 and 54 <= offset < size and header in (40, 108, 124) and at + size <= len(b) else None


def _ogg(b: bytes, at: int) -> int | None:
    """Pages in sequence, from a first to a last one of one stream."""
    pos, number, serial = at, 0, None
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        flags, segments = b[pos + 5], b[pos + 26]
        own, sequence = b[pos + 14 : pos + 18], int.from_bytes(b[pos + 18 : pos + 22], "little")
        serial = own if serial is None else serial
        end = pos + 27 + segments + sum(b[pos + 27 : pos + 27 + segments])
        if own != serial or sequence != number or (number == 0) != bool(flags & 2) or end > len(b):
            return None
        if flags & 4:
            return end
        pos, number = end, number + 1
    return None


def _pdf(b: bytes, at: int) -> int | None:
    """To the first end mark whose cross-reference offset leads to a table or an object of this file."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    following = b.find(b"%PDF-", at + 5)
    limit = following if following > 0 else len(b)
    end = b.find(b"%%EOF", at, limit)
    while end > 0:
        tail = b[max(at, end - 40) : end].rpartition(b"startxref")[2].strip()
        if tail.isdigit():
            to = at + int(tail)
            if at < to < end and (b[to : to + 4] == b"xref" or b[to : to + 1].isdigit()):
                return end + 5
        end = b.find(b"%%EOF", end + 5, limit)
    return None


def _zip_from_end(b: bytes, at: int) -> int | None:
    """To the first end record whose directory lies where it says, seen from the first entry."""
    end = b.find(b"PK\5\6", at)
    while end > 0 and end + 22 <= len(b):
        size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
        if at + offset + size == end and b[at + offset : at + offset + 4] == b"PK\1\2" and end + 22 + comment <= len(b):
            return end + 22 + comment
        end = b.find(b"PK\5\6", end + 4)
    return None


def _zip(b: bytes, at: int) -> int | None:
    """Local entries by their lengths, then the directory's entries, then the end record that counts them."""
    pos, entries, listed = at, 0, 0
    while b[pos : pos + 4] == b"PK\3\4" and pos + 30 <= len(b):
        flags, (size,), (name, extra) = b[pos + 6], struct.unpack_from("<I", b, pos + 18), struct.unpack_from("<HH", b, pos + 26)
        if flags & 8 and not size:  # lengths follow the data: the directory, found from its end record, has them
            return _zip_from_end(b, at)
        pos, entries = pos + 30 + name + extra + size, entries + 1
    directory = pos
    while b[pos : pos + 4] == b"PK\1\2" and pos + 46 <= len(b):
        pos, listed = pos + 46 + sum(struct.unpack_from("<HHH", b, pos + 28)), listed + 1
    if b[pos : pos + 4] != b"PK\5\6" or pos + 22 > len(b) or entries != listed:
        return None
    count, size, offset, comment = struct.unpack_from("<HIIH", b, pos + 10)
    end = pos + 22 + comment
    return end if count == listed and size == pos - directory and at + offset == directory and end <= len(b) else None


# Magic bytes and types of the formats, with the validator of each.
SIGNATURES = (
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"OggS", "application/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
)

_machine: list = []


def _automaton():
    if not _machine:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for magic, kind, check in SIGNATURES:
            machine.add_word(magic.decode("latin-1"), (len(magic), kind, check))
        machine.make_automaton()
        _machine.append(machine)
    return _machine[0]


def sniff(blob: bytes) -> list[Medium]:
    """Confirmed media of a blob, in order of their start."""
    found = []
    for last, (n, kind, check) in _automaton().iter(blob.decode("latin-1")):
        start = last + 1 - n
        end = check(blob, start)
        if end is not None:
            found.append(Medium(kind, start, end))
    return sorted(found, key=lambda m: (m.start, -m.end, m.kind))


def true_type(media: list[Medium]) -> str:
    """The type of a blob is that of a medium that begins where it begins."""
    return media[0].kind if media and media[0].start == 0 else UNKNOWN


def carve(blob: bytes, media: list[Medium]) -> list[tuple[str, bytes]]:
    """Embedded media: all that do not span the blob from its start."""
    return [(m.kind, blob[m.start : m.end]) for m in media if m.start > 0]


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def to_wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """An 8-bit mono PCM container whose samples are the payload's bytes; of 2**32 bytes at most."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def from_wav(blob: bytes) -> tuple[dict, bytes]:
    """Format and samples, read from the container's chunks."""
    pos, form, samples = 12, {}, b""
    while pos + 8 <= len(blob):
        kind, n = blob[pos : pos + 4], int.from_bytes(blob[pos + 4 : pos + 8], "little")
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", blob, pos + 8)
            form = {"code": code, "channels": channels, "rate": rate, "bits": bits}
        elif kind == b"data":
            samples = blob[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    return form, samples


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media: every text in its container. The declared type is that of the text, not of the container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            texts = texts_as_bytes(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(["text/plain"] * len(texts)), pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())],
                ["doc_id", "n_bytes", "declared", "media"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, declared string, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """Of a table with doc_id, n_bytes, declared, media: corrected type, what is embedded, samples read back and features."""

    def feature(form: dict, samples: bytes, kind: str, declared: str, carved: list[tuple[str, bytes]]) -> str:
        x = np.frombuffer(samples, np.uint8)
        histogram = np.bincount(x, minlength=256)
        n, values = len(x), np.arange(256)
        total = int((histogram * values).sum())
        squares = int((histogram * values * values).sum())
        crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
        parts = [kind, f"was={declared}", f"{form['channels']}ch", f"{form['bits']}bit", f"{form['rate']}Hz", f"n={n}", f"sum={total}", f"squares={squares}", f"crossings={crossings}", f"peak={int(x.max())}"]
        listed = "+".join(f"{kind}:{len(part)}:{zlib.crc32(part):08x}" for kind, part in carved)
        return ";".join([*parts, f"carved={listed}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "media"):
            rows = []
            for blob, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                found = sniff(blob)
                kind = true_type(found)
                if kind != "audio/wav":
                    raise ValueError(f"a stored container reads as {kind}")
                form, samples = from_wav(blob)
                rows.append((kind, declared != kind, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(form, samples, kind, declared, carve(blob, found))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], NAMES)

    NAMES = ["doc_id", "n_bytes", "media_type", "corrected", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "doc_id long, n_bytes long, media_type string, corrected boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media, run, schema)


def store_and_inspect(docs: DataFrame) -> DataFrame:
    return inspect(store(docs))
