"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are mapped byte by byte to characters, encoded by the tokenizers library and decoded by reversing the byte
table over the concatenated tokens, so that a character split between tokens comes back whole. Offsets of tokens
are offsets in bytes.

Null texts count as empty and have no tokens. Very long texts are encoded whole, in batches of their own. Ties between
merges go to the lower rank, then to the left. Repeated rows give repeated results. An empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import byte_slices, map_batches, texts_as_str

_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        self.tokenizer = bpe.from_ranks(path, pattern)
        self.known = bpe.splits_like_pattern(self.tokenizer)
        self.token_bytes = {i: bpe.to_bytes(t) for t, i in self.tokenizer.get_vocab().items()}
        self.lengths = np.zeros(max(self.token_bytes, default=-1) + 1, np.int64)
        for i, b in self.token_bytes.items():
            self.lengths[i] = len(b)
        own = list(range(len(self.lengths)))  # an id is one number, however often the memo holds it
        self.memo = bpe.Memo(self.tokenizer, make=lambda tokens: tuple(own[t.id] for t in tokens))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, bpe.pre_tokens(text, self.tokenizer, self.known))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.zeros(0, kind), *arrays]))


#: Bytes of text that are encoded, and decoded again, at once: their ids take many times that room.
ENCODE_BYTES = 1 << 19
ENCODED = "doc_id long, n_bytes long, ids array<int>, ends array<long>"


def _encoding(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, limit=ENCODE_BYTES):
        ids = [np.array(c.encode(t), np.int32) for t in texts_as_str(batch)]
        ends = [np.cumsum(c.lengths[x]) for x in ids]
        n_bytes = np.array([x[-1] if len(x) else 0 for x in ends], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), _lists(ids, np.int32), _lists(ends, np.int64)], ["doc_id", "n_bytes", "ids", "ends"])


def _decoding(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # one text's ids at a time are Python's numbers, which take nine times the room of the column
        data = pa.array([c.decode(x.as_py() or []) for x in batch.column("ids")], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, "data"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_bytes, ids, ends: token ids and the byte offsets at which tokens end."""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda batches: _encoding(codec(path, pattern), batches), ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of a table with ids, null for none, and the decoded bytes as `data`."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("data", T.BinaryType())])
    return map_batches(encoded, lambda batches: _decoding(codec(path, pattern), batches), schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids, ends, ids_sha256, decoded_sha256, exact: what is encoded, and decoded again.

    Both ways run in one worker, which then holds one codec.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        yield from _decoding(c, _encoding(c, batches))

    back = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"{ENCODED}, data binary")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(
        "doc_id",
        "n_bytes",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        "ends",
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
        (F.octet_length("data") == F.col("n_bytes")).alias("exact"),
    )
