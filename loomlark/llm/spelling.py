"""A spelling model for operator 5: the probability of a word without a symbol of its own, from its letters.

Letters are 64 classes of bytes (a-z each its own); the model gives each letter, or the end of the word, from the two letters
before it, with counts of the corpus smoothed towards shorter contexts. A word's *shape* is a class of its last two
letters. The mass of all words of a shape is computed exactly from the expected visits of each pair of letters, so that
p(word | shape) adds up to 1 over all words.
"""

from __future__ import annotations

import numpy as np

LETTERS, SHAPES, SMOOTH = 64, 512, 4.0
_CODE = np.array([27 + b % 37 for b in range(256)], np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[10] = 0  # words are joined by line feeds, which no word holds: the end of a word
_POSSIBLE = np.array([b not in b" \t\n\x0b\x0c\r" and not 65 <= b <= 90 for b in range(256)])
_SIZE = np.bincount(_CODE[_POSSIBLE], minlength=LETTERS)
_SHAPE = (np.arange(LETTERS**2) // LETTERS * 41 + np.arange(LETTERS**2) % LETTERS) % SHAPES


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of all words and their ends: the triple of the two letters before and this one, as one number, and the bytes; and where
    words end."""
    line = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    code = _CODE[line]
    triple = code.copy()
    triple[1:] += code[:-1] << 6
    triple[2:] += np.where(code[1:-1] == 0, 0, code[:-2] << 12)  # a word's first letter has none before it
    return triple, line, np.flatnonzero(code == 0)


def counts(words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words that occur ``n`` times: how often each triple of letters, and each shape, occurs."""
    triple, _, ends = letters(words)
    return np.bincount(triple, np.repeat(n, np.diff(ends, prepend=-1)), LETTERS**3), np.bincount(_SHAPE[triple[ends] >> 6], n, SHAPES)


class Spelling:
    """From the counts of triples; ``own``: words that are no concern of it."""

    def __init__(self, triples: np.ndarray, own: list[bytes]):
        c = triples.reshape((LETTERS,) * 3)
        one = c.sum((0, 1)) + 1
        two = c.sum(0) + SMOOTH * one / one.sum()
        two /= two.sum(1, keepdims=True)
        p = c + SMOOTH * two
        p[0, 0, 0] = 0  # no word is empty
        p /= p.sum(2, keepdims=True)
        now, visits = np.zeros((LETTERS, LETTERS)), np.zeros((LETTERS, LETTERS))
        now[0, 0] = 1.0
        while now.sum() > 1e-12:
            now = np.einsum("xy,xyz->yz", now, p)
            now[:, 0] = 0
            visits += now
        self.ends = visits * p[:, :, 0]
        with np.errstate(divide="ignore"):
            self.log_p, self.log_byte = np.log(p).ravel(), -np.log(np.maximum(_SIZE, 1))[_CODE]
        self.log_byte[10] = 0.0
        mass = np.bincount(_SHAPE, self.ends.ravel(), SHAPES)
        if own:
            shape, log_p = self._read(own)
            mass -= np.bincount(shape, np.exp(log_p), SHAPES)
        self.log_mass = np.log(np.maximum(mass, 1e-300))

    def _read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        triple, line, ends = letters(words)
        log_p = np.add.reduceat(self.log_p[triple] + self.log_byte[line], np.concatenate(([0], ends[:-1] + 1)))
        return _SHAPE[triple[ends] >> 6], log_p

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shapes and log p(word | shape)."""
        shape, log_p = self._read(words)
        return shape, log_p - self.log_mass[shape]
