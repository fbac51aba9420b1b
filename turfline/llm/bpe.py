"""What the byte-level BPE operators share: the byte table, pre-tokens and a memo of their tokens.

Byte-level BPE never merges across pre-tokens, so a text's tokens are those of its pre-tokens in turn. Each worker
keeps the tokens of the pre-tokens it has met in a memo of bounded size (which takes the place of the library's own
cache); what is new goes through the tokenizers library. Texts are split in Python by a pattern that equals PATTERN as
long as all characters lie below U+0250 or in general punctuation; other texts, and those of tokenizers with another
pattern, are split by the library itself.
"""

from __future__ import annotations

import base64
import json
import re

from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

MEMO = 200_000

# Fixed value: the pattern that SPLIT stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space, letters and numbers below U+0250, and in general punctuation, by Unicode's properties.
_S = r"\t-\r \x85\xa0 -     "
_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_FOREIGN = re.compile(r"[^\x00-ɏ -⁯]")


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(shown)))
    return table


BYTE_TO_CHAR = byte_table()
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}
_TRANSLATE = {b: c for b, c in BYTE_TO_CHAR.items() if chr(b) != c}


def to_chars(data: bytes) -> str:
    """One character for each byte, so that offsets in it are byte offsets."""
    return data.decode("latin-1").translate(_TRANSLATE)


def to_bytes(chars: str) -> bytes:
    return bytes(map(CHAR_TO_BYTE.__getitem__, chars))


def from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizer of the library from a file of ranks: ids are ranks, merges all pairs whose joint string has a rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    vocab = {to_chars(token): rank for token, rank in ranks.items()}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((to_chars(token[:cut]), to_chars(token[cut:])))
    tokenizer = Tokenizer(models.BPE(vocab, merges, ignore_merges=True, cache_capacity=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


def splits_like_pattern(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer splits by PATTERN: its own byte-level split, or a split by that very pattern."""
    form = json.loads(tokenizer.pre_tokenizer.__getstate__())
    parts = form["pretokenizers"] if form["type"] == "Sequence" else [form]
    names = [(p["type"], p.get("use_regex"), p.get("pattern", {}).get("Regex"), p.get("add_prefix_space")) for p in parts]
    return names in ([("ByteLevel", True, None, False)], [("Split", None, PATTERN, None), ("ByteLevel", False, None, False)])


def pre_tokens(text: str, tokenizer: Tokenizer, known: bool = True) -> list[str]:
    """The pre-tokens of a text, in order; joined they are the text. `known`: the tokenizer splits by PATTERN."""
    if known and (text.isascii() or not _FOREIGN.search(text)):
        return SPLIT.findall(text)
    # the library's offsets are in characters; a piece of a character's bytes does not occur before the merges
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Memo(dict):
    """Ids of pre-tokens; what is missing is encoded by the library's model over the byte characters."""

    def __init__(self, tokenizer: Tokenizer, make=lambda tokens: tuple(t.id for t in tokens), limit: int = MEMO) -> None:
        self.tokenizer, self.make, self.limit = tokenizer, make, limit
        self._tokenize = tokenizer.model.tokenize

    def __missing__(self, word: str):
        value = self.make(self._tokenize(to_chars(word.encode())))
        if len(word) <= 64:  # longer ones hardly come again
            if len(self) >= self.limit:  # forget all rather than grow without bound
                self.clear()
            self[word] = value
        return value
