"""Token counts with overlap resynchronisation.

A text longer than CHUNK characters is encoded by the library in overlapping chunks, with the offsets of the tokens.
Within an overlap, the earlier and the later chunk are spliced where a token begins in both that also begins a pre-token
in both: from such a boundary on, the split of a text depends on nothing before it, so both chunks agree up to the end of
the earlier one, and no merge crosses it. The boundary must lie one character before the earlier chunk's end, as the
split looks one character ahead. Where an overlap has no common boundary, it is widened twofold, up to the whole earlier
chunk, and then that chunk is encoded anew, twice as long. Shorter texts are counted by pre-tokens through a memo.

Null texts count as empty and have no tokens. Strings of special tokens inside a text are handled as the library does
by default. Ties between merges are the library's. Repeated rows give repeated results. An empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe
from .common import byte_slices, map_batches, texts_as_str

CHUNK = 32_768
OVERLAP = 512
LIMIT = 512

_counters: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.chunk, self.overlap = chunk, overlap
        self.memo = bpe.Memo(self.tokenizer, make=len)
        self.known = bpe.splits_like_pattern(self.tokenizer)
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.special = [t.content for t in added] if plain else None  # None: texts go through the library whole
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special or [], key=len, reverse=True))))

    def count(self, text: str) -> int:
        """Tokens of a text as the library gives them: special strings stand alone, what is between them is encoded."""
        if self.special is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if len(text) > self.chunk:
            return self._spliced(text)
        return sum(map(self.memo.__getitem__, bpe.pre_tokens(text, self.tokenizer, self.known)))

    def _encoded(self, text: str, begin: int, end: int) -> tuple[list[int], list[bool]]:
        """Offsets in the text at which the tokens of a chunk begin, and whether a pre-token begins there too."""
        found = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        words = found.word_ids
        return [begin + a for a, _ in found.offsets], [k == 0 or words[k] != words[k - 1] for k in range(len(words))]

    def _spliced(self, text: str) -> int:
        total, begin, end = 0, 0, self.chunk
        at, starts = self._encoded(text, begin, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(begin, end - overlap)
                later = min(len(text), start + max(self.chunk, 2 * overlap))
                more, more_starts = self._encoded(text, start, later)
                # the later chunk begins inside a word perhaps: its own first boundary proves nothing, a common one does
                index = {p: k for k, (p, first) in enumerate(zip(more, more_starts, strict=True)) if first}
                common = next((k for k in range(len(at) - 1, -1, -1) if starts[k] and start < at[k] < end - 1 and at[k] in index), None)
                if common is not None:
                    keep = index[at[common]]
                    total += common
                    at, starts, begin, end = more[keep:], more_starts[keep:], at[common], later
                    break
                if start == begin:  # nothing to align in the whole chunk: encode it anew, twice as long
                    end = min(len(text), begin + 2 * (end - begin))
                    at, starts = self._encoded(text, begin, end)
                    break
                overlap *= 2
        return total + len(at)


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in byte_slices(batches):
            texts = texts_as_str(batch)
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
