"""Exact token ids and counts with a bounded memo of text pieces.

Both tokenizers split a text before they merge bytes, and neither lets a merge cross certain spaces.
So a text can be cut at those spaces, and each distinct piece needs encoding once per worker:

* byte-level BPE: a space between two characters that are not white space always starts a token;
* word BPE: white space is dropped, so any space or line feed separates.

Texts where a cut could matter (runs of white space, NUL) are encoded whole. The memo is emptied when
it holds ``MEMO`` pieces, which bounds memory and changes no result.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

MEMO = 400_000
#: The split pattern of the byte-level vocabulary (fixed value, from its description).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = re.compile(r"\s |\s\s| \s|\x00|^\s|\s$")


class _Ids(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode

    def raw(self, text: str) -> bytes:
        a = array("I", self.encode(text, allowed_special="all"))
        return a.tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        found = self[piece] = self.raw(piece)
        return found


@lru_cache(maxsize=2)
def byte_ids(ranks_path: str, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)):
    """A function text -> ids as bytes, equal to the library's ids for the same vocabulary with its
    special strings recognised inside texts, as that library does by default."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    memo = _Ids(tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=dict(special)))

    def ids(text: str) -> bytes:
        if _UNSAFE.search(text):
            return memo.raw(text)
        return b"".join(map(memo.__getitem__, text.replace(" ", "\x00 ").split("\x00")))

    return ids


class _Counts(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self[""] = 0

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
            self[""] = 0
        found = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return found


@lru_cache(maxsize=2)
def word_counts(tokenizer_path: str):
    """A function text -> number of tokens of a tokenizer that drops white space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    memo = _Counts(tokenizer)
    return lambda text: sum(map(memo.__getitem__, text.replace("\n", " ").split(" ")))
