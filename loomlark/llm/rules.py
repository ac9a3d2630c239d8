"""Operator 9, quality rules with line sequence labelling by a linear-chain conditional random field.

Base rules count words, symbols, repeated lines and repeated three-word windows over the whole text. For the texts
that pass them, a two-state chain labels each line content or boilerplate: Viterbi decoding of a conditional
random field over line features. A document is kept if its content lines hold at least ``share`` of its words.

Lines have no labels of their own. They start from weak ones: all lines of a document labelled bad are boilerplate, and so are those of
a good one that repeat an earlier line or hold a cue of boilerplate. A field without transitions is fit and labels each line of its sample
by itself; the chain is fit to these lines, labels them anew, and so on, ``ROUNDS`` times; where the new lines contradict their document's label (the share of content of a good one must reach
``share``, that of a bad one must not), the document keeps its weak ones. So transitions between content and boilerplate within a
document are learnt, while documents hold the labels together.

Plan: the field is fit by gradient ascent on at most ``SAMPLE`` labelled documents, chosen by hash, and in that order until they have
``LINES`` lines with words (documented bounds). Long documents are cut into chains of ``CHAIN`` lines for the fit, and all their lines take
part. The sample's ids are broadcast, as the bound holds at any size. Labelling is one narrow pass over whole texts, with one
document in memory.

Cases: null text has no words and is not kept; without labels of both kinds every line counts as content; of several labelled
documents with one id, one is fit on; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlark.llm.shared import bounded_batches, text_or_empty, written

SAMPLE, LINES, CHAIN, ROUNDS = 4000, 1_000_000, 64, 2
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_BOILER = re.compile(r"(?i)\b(?:all rights reserved|copyright|cookies?|subscribe|sign in|log in|terms of|privacy policy|licen[sc]ed?|click here|read more)\b|©")
N_FEATURES = 12
_REPEATED, _CUE = 7, 9  # features that mark a line as boilerplate to begin with


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeat = 0
    if n >= 4:
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
        if n >= 1 << 21:  # else the key of a window fits 63 bits
            pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1].astype(np.int64)
            key = pair[:-1] * n + ids[2:]
        else:
            key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            twice = np.zeros(n + 2, bool)
            for hit in (order[1:][same], order[:-1][same]):
                for k in range(3):
                    twice[hit + k] = True
            repeat = int(twice.sum())
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and number of words of each line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        letters = sum(map(len, words))
        symbols = sum(map(line.count, SYMBOLS)) / n
        rows.append((1.0, sum(map(str.isupper, words)) / n, min(1.0, symbols), symbols > 0.2, min(1.0, line.count("!") / n), 1 - len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, line in seen, n < 4, bool(_BOILER.search(line)), min(2.0, letters / n / 8), words[-1][-1] in ".!?:;"))
        seen.add(line)
        sizes.append(n)
    return np.array(rows, float).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


@dataclass
class Field:
    """``weight``: feature x state; ``step``: state x next state. State 1 is boilerplate."""

    weight: np.ndarray
    step: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states; of equal ones, content."""
        emit = (x @ self.weight).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = emit[0]
        back = []
        for e0, e1 in emit[1:]:
            stay, turn = a + s00, b + s10
            go, hold = a + s01, b + s11
            back.append((turn > stay, hold > go))
            a, b = max(stay, turn) + e0, max(go, hold) + e1
        state = int(b > a)
        states = [state]
        for move in reversed(back):
            state = int(move[state])
            states.append(state)
        return np.array(states[::-1])


def fit_field(chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3, transitions: bool = True, start: Field | None = None) -> Field:
    """Maximum likelihood of a linear-chain field, from (features, states) of chains of lines, by gradient ascent (Adam) from ``start``,
    forward-backward over all chains at once. Without ``transitions`` each line stands alone."""
    field = Field(start.weight.copy(), start.step.copy()) if start else Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    length = CHAIN if transitions else 1
    chains = [(x[s : s + length], y[s : s + length]) for x, y in chains for s in range(0, len(x), length)]
    if not chains or len(np.unique(np.concatenate([y for _, y in chains]))) < 2:
        return Field(np.eye(N_FEATURES, 2) * [1.0, 0.0], np.zeros((2, 2)))
    chains.sort(key=lambda c: -len(c[0]))
    n = np.array([len(x) for x, _ in chains])
    T = n[0]
    X, Y = np.zeros((T, len(chains), N_FEATURES)), np.zeros((T, len(chains)), int)
    for k, (x, y) in enumerate(chains):
        X[: len(x), k], Y[: len(x), k] = x, y
    live = [int((n > t).sum()) for t in range(T)]  # chains stand by length, so those with a line t come first
    total = n.sum()
    eye = np.eye(2)
    want_w = np.zeros((N_FEATURES, 2))
    want_s = np.zeros((2, 2))
    for t in range(T):
        want_w += X[t, : live[t]].T @ eye[Y[t, : live[t]]]
        if t:
            want_s += eye[Y[t - 1, : live[t]]].T @ eye[Y[t, : live[t]]]
    theta = [field.weight, field.step]
    m, v = [0 * p for p in theta], [0 * p for p in theta]
    for i in range(1, steps + 1):
        emit = X @ field.weight
        f, z = np.zeros((T, len(chains), 2)), np.zeros((T, len(chains)))
        trans = np.exp(field.step)
        for t in range(T):  # forward, scaled
            e = np.exp(emit[t, : live[t]] - emit[t, : live[t]].max(1, keepdims=True))
            g = e if not t else (f[t - 1, : live[t]] @ trans) * e
            z[t, : live[t]] = g.sum(1)
            f[t, : live[t]] = g / z[t, : live[t], None]
        got_w, got_s = np.zeros_like(want_w), np.zeros_like(want_s)
        b = np.ones((len(chains), 2))
        for t in range(T - 1, -1, -1):  # backward
            k = live[t]
            p = f[t, :k] * b[:k]
            p /= p.sum(1, keepdims=True)
            got_w += X[t, :k].T @ p
            if t:
                e = np.exp(emit[t, :k] - emit[t, :k].max(1, keepdims=True)) * b[:k]
                pair = f[t - 1, :k, :, None] * trans * e[:, None, :]
                got_s += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                new = e @ trans.T
                b[:k] = new / new.sum(1, keepdims=True)
        for p, want, got, a, c in list(zip(theta, (want_w, want_s), (got_w, got_s), m, v))[: 1 + transitions]:
            grad = (want - got) / total - decay * p
            a *= 0.9
            a += 0.1 * grad
            c *= 0.99
            c += 0.01 * grad * grad
            p += rate * (a / (1 - 0.9**i)) / (np.sqrt(c / (1 - 0.99**i)) + 1e-8)
    return field


def content_share(states: np.ndarray, sizes: np.ndarray) -> float:
    """The share of the words that stand in lines of content."""
    return float(sizes[states == 0].sum() / sizes.sum()) if len(sizes) else 0.0


def fit_documents(docs: list[tuple[np.ndarray, np.ndarray, int]], share: float = 0.5, rounds: int = ROUNDS) -> Field:
    """The field from (features, words of each line, whether labelled bad) of documents."""
    weak = [np.ones(len(x), int) if bad else ((x[:, _REPEATED] > 0) | (x[:, _CUE] > 0)).astype(int) for x, _, bad in docs]
    weak = [y if bad or content_share(y, n) >= share else np.zeros(len(y), int) for y, (_, n, bad) in zip(weak, docs)]
    if len({bad for _, _, bad in docs}) < 2:
        return fit_field([])
    field = fit_field([(x, y) for (x, _, _), y in zip(docs, weak)], transitions=False)
    for _ in range(rounds):
        found = [field.viterbi(x) for x, _, _ in docs]
        found = [y if (content_share(y, n) < share) == bool(bad) else w for y, w, (_, n, bad) in zip(found, weak, docs)]
        field = fit_field([(x, y) for (x, _, _), y in zip(docs, found)], steps=60, start=field)
    return field


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, most_lines: int = LINES) -> Field:
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where(F.col("_key").isNotNull() & F.col("_y").isin(0, 1))
    known = known.orderBy(F.xxhash64("_key"), "_key", "_y").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(F.col("text")).alias("text")).join(F.broadcast(known), "_key").select(F.xxhash64("_key").alias("_at"), "_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.column_stack(line_features(t.as_py())).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["at", "y", "x"])

    # one row for each label, however often its id repeats in ``docs``
    got = written(rows.mapInArrow(run, "at long, y int, x binary").where(F.octet_length("x") > 0).groupBy("at", "y").agg(F.min("x").alias("x")), "lines")
    before = F.sum(F.octet_length("x")).over(Window.orderBy("at", "y").rowsBetween(Window.unboundedPreceding, -1))
    found = []
    for r in got.withColumn("_before", before).where(F.coalesce("_before", F.lit(0)) < most_lines * 8 * (N_FEATURES + 1)).orderBy("at", "y").collect():
        x = np.frombuffer(r["x"]).reshape(-1, N_FEATURES + 1)
        found.append((x[:, :N_FEATURES], x[:, N_FEATURES].astype(np.int64), 1 - r["y"]))
    return fit_documents(found)


def judge(docs: DataFrame, field: Field, key: str = "doc_id", share: float = 0.5, with_lines: bool = False) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share;
    ``with_lines`` adds the states of the lines that have words (1: boilerplate)."""
    bounded_batches(docs.sparkSession)
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names[1:6]) + ", base_failed boolean, kept boolean, content_share double" + ", line_states array<int>" * with_lines
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.int32())][: 8 + with_lines]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item in batch.column(1):
                text = item.as_py()
                own = counts(text)
                failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
                x, sizes = line_features(text)
                states = field.viterbi(x) if len(x) else np.zeros(0, int)
                content = content_share(states, sizes)
                out.append((*own, failed, not failed and content >= share, content, states.tolist()))
            columns = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*names, "line_states"][: 9 + with_lines])

    return docs.select(key, text_or_empty(F.col("text")).alias("text")).mapInArrow(run, schema)
