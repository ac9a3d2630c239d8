"""The window network of operator 5, in numpy: it predicts a symbol from ``SIDE`` symbols on either side.

A table of vectors per neighbour position is summed and squashed; the output is a softmax in two levels, a group and a
symbol within the group, so that a step costs two rows of 64 logits and not 4096. Symbols stand in order of frequency, and both
levels start from the symbols' own frequencies, so that an untrained network is a unigram model.
"""

from __future__ import annotations

import numpy as np

SIDE, WIDTH = 2, 16  # of the hidden units, the last is always 1 and carries the biases
GROUPS, EACH = 64, 64
SYMBOLS = GROUPS * EACH  # 12 bits: a symbol and its four neighbours fit in one 64-bit key
BLOCK = 1 << 14
_SHAPES = ((2 * SIDE, SYMBOLS, WIDTH), (WIDTH, GROUPS), (GROUPS, WIDTH, EACH))
_ENDS = np.cumsum([np.prod(s) for s in _SHAPES])


def start(frequency: np.ndarray, seed: int = 3) -> np.ndarray:
    """Parameters as one vector, from a positive frequency of each symbol."""
    rng = np.random.default_rng(seed)
    theta = (rng.standard_normal(_ENDS[-1]) * 0.05).astype(np.float32)
    tables, first, second = parts(theta)
    tables *= 2
    both = frequency.reshape(GROUPS, EACH)
    whole = both.sum(1)
    first[-1] = np.log(whole / whole.sum())
    second[:, -1] = np.log(both / whole[:, None])
    return theta


def parts(theta: np.ndarray) -> list[np.ndarray]:
    """Views: the tables, the first and the second level."""
    return [x.reshape(s) for x, s in zip(np.split(theta, _ENDS[:-1]), _SHAPES)]


def windows(ids: np.ndarray, lengths: np.ndarray, edge: int) -> np.ndarray:
    """The neighbours (2 * SIDE, n) of each symbol of texts that stand one after another."""
    at = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(lengths)), lengths))
    padded = np.full(len(ids) + SIDE * (len(lengths) + 1), edge, ids.dtype)
    padded[at] = ids
    return np.stack([padded[at + k] for k in range(-SIDE, SIDE + 1) if k])


def _hidden(tables: np.ndarray, near: np.ndarray) -> np.ndarray:
    h = tables[0][near[0]]
    for k in range(1, 2 * SIDE):
        h += tables[k][near[k]]
    np.tanh(h, out=h)
    h[:, -1] = 1
    return h


def _shares(h: np.ndarray, out: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits (less the largest unless they can't overflow), their exponentials, and the sums of these."""
    z = h @ out
    if not bounded:
        z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], e.dtype)


def _bounded(first: np.ndarray, second: np.ndarray) -> bool:
    """The hidden units lie within 1, so sums of absolute weights bound the logits."""
    return bool(max(np.abs(first).sum(0).max(), np.abs(second).sum(1).max()) < 80)


def log_probability(theta: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each target given its neighbours, in blocks that fit the processor's cache."""
    tables, first, second = parts(theta)
    bounded = _bounded(first, second)
    found = np.empty(len(target), np.float64)
    for s in range(0, len(target), BLOCK):
        group, own = target[s : s + BLOCK] // EACH, target[s : s + BLOCK] % EACH
        order = np.argsort(group, kind="stable")  # radix sort, as symbols have 16 bits
        group, own = group[order], own[order]
        h = _hidden(tables, near[:, s : s + BLOCK][:, order])
        z, _, total = _shares(h, first, bounded)
        held = z[np.arange(len(group)), group] - np.log(total)
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in range(GROUPS):
            a, b = ends[g], ends[g + 1]
            if a < b:
                z, _, total = _shares(h[a:b], second[g], bounded)
                held[a:b] += z[np.arange(b - a), own[a:b]] - np.log(total)
        found[s + order] = held
    return found


def step(theta: np.ndarray, memory: np.ndarray, near: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step on the mean of the windows, in place. A table's gradient is summed over runs of equal neighbours in sorted order."""
    (tables, first, second), (m_tables, m_first, m_second) = parts(theta), parts(memory)
    bounded, n = _bounded(first, second), len(target)
    order = np.argsort(target // EACH, kind="stable")
    near, target = near[:, order], target[order]
    group, own = target // EACH, target % EACH
    h = _hidden(tables, near)
    _, e, total = _shares(h, first, bounded)
    e *= (1 / (n * total))[:, None]
    e[np.arange(n), group] -= 1 / n
    back, g_first, g_second = e @ first.T, h.T @ e, np.zeros_like(second)
    ends = np.searchsorted(group, np.arange(GROUPS + 1))
    for g in range(GROUPS):
        a, b = ends[g], ends[g + 1]
        if a < b:
            _, e, total = _shares(h[a:b], second[g], bounded)
            e *= (1 / (n * total))[:, None]
            e[np.arange(b - a), own[a:b]] -= 1 / n
            back[a:b] += e @ second[g].T
            g_second[g] = h[a:b].T @ e
    back *= 1 - h * h
    _move(first, m_first, g_first, rate)
    _move(second, m_second, g_second, rate)
    for k in range(2 * SIDE):
        order = np.argsort(near[k], kind="stable")
        row = near[k][order]
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        grad = np.zeros_like(tables[k])
        grad[row[at]] = np.add.reduceat(back[order], at, axis=0)
        _move(tables[k], m_tables[k], grad, rate)


def _move(p: np.ndarray, memory: np.ndarray, grad: np.ndarray, rate: float) -> None:
    memory += grad * grad
    grad *= rate
    grad /= np.sqrt(memory)
    p -= grad


def trained(theta: np.ndarray, near: np.ndarray, target: np.ndarray, rate: float, batch: int, least: float = 1e-6) -> np.ndarray:
    """``theta`` after one pass over the windows, in order."""
    theta, memory = theta.copy(), np.full_like(theta, least)
    for s in range(0, len(target), batch):
        step(theta, memory, near[:, s : s + batch], target[s : s + batch], rate)
    return theta
