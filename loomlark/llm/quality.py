"""Operator 10, quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Each text becomes a short vector of statistics. Random Fourier features approximate a Gaussian kernel over
them; ridge regression on these features is solved from normal equations that partitions sum; the raw scores
are calibrated by isotonic regression on rows kept out of the fit.

Plan: the model is fit on at most ``SAMPLE`` labelled rows (documented bound, chosen by hash), whose ids are broadcast
because that bound holds at any size. Scoring is one narrow pass over whole texts.

Cases: null and empty texts get the statistics of a text without words and a score like any other; without labels of
both kinds every score is the share of label 1 among those known, or 0.5 without any; a document with several labels uses
each; of several documents with one id, the one with the smallest statistics is fit on; null labels are ignored; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomlark.llm.shared import bounded_batches, text_or_empty, unused, written

SAMPLE = 20_000
_SYMBOLS = re.compile(r"[#*$%&|<>\\{}\[\]=_~^]")
_STOPS = re.compile(r"[.!?…]+(?=\s|$)")
N_STATS = 18


def statistics(text: str) -> list[float]:
    """``N_STATS`` numbers that do not grow with the text, but for logarithms."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0, float(chars > 0)] + [0.0] * (N_STATS - 2)
    letters = sum(map(len, words))
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    short = sum(1 for w in words if len(w) <= 3)
    long = sum(1 for w in words if len(w) >= 18)
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    alpha = sum(map(str.isalpha, words))
    digits = sum(map(text.count, "0123456789"))
    symbols = len(_SYMBOLS.findall(text))
    return [
        np.log1p(n),
        1.0,
        letters / n,
        upper / n,
        title / n,
        alpha / n,
        short / n,
        long / n,
        min(2.0, symbols / n),
        min(2.0, text.count("!") / n),
        min(2.0, (text.count(",") + text.count(";")) / n),
        min(2.0, len(_STOPS.findall(text)) / n),
        digits / letters,
        distinct / n,
        np.log(distinct) / np.log(n) if n > 1 else 1.0,
        again / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    ]


def with_statistics(docs: DataFrame, key: str) -> DataFrame:
    """key, text, ... -> the other columns and ``stats``."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", stats array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(found, pa.list_(pa.float64()))], [*rest, "stats"])

    return docs.select(*rest, text_or_empty(F.col("text")).alias("text")).mapInArrow(run, schema)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, number, sum of scores
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        blocks.append([y, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y0, n0, s0 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y0, blocks[-1][1] + n0, blocks[-1][2] + s0]
    return np.array([s / n for _, n, s in blocks]), np.array([(y + 0.5) / (n + 1) for y, n, _ in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    wave: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        z = np.cos(x @ self.wave + self.phase) * np.sqrt(2 / self.wave.shape[1])
        return np.concatenate((z, np.ones((len(x), 1))), 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        # a thousandth of the raw score keeps the order within calibrated steps
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def held_out(key: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id leaves none."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, waves: int = 400, width: float = 4.0, ridge: float = 0.3, seed: int = 11) -> Model:
    """A model from ``labels`` (key, label 0/1); rows of ``held_out`` must have been taken away."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y")).where(F.col("_key").isNotNull() & F.col("_y").isin(0.0, 1.0))
    known = known.orderBy(F.xxhash64("_key"), "_key", "_y").limit(sample)
    train = docs.select(F.col(key).alias("_key"), "text").join(F.broadcast(known), "_key").select("_key", "_y", "text")
    # one row for each label, so that an id that repeats in ``docs`` brings no more rows than its labels
    train = written(with_statistics(train, "_key").groupBy("_key", "_y").agg(F.min("stats").alias("stats")), "statistics")
    moments = train.agg(F.count("*").alias("n"), F.sum("_y").alias("ones"), *[f(F.col("stats")[k]).alias(f"{name}{k}") for k in range(N_STATS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(N_STATS)])
    scale = np.array([moments[f"s{k}"] or 1.0 for k in range(N_STATS)])
    model = Model(mean, np.maximum(scale, 1e-6), rng.standard_normal((N_STATS, waves)) / width, rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), (np.zeros(1), np.zeros(1)))
    n, ones = moments["n"], moments["ones"] or 0.0
    if n < 10 or not 0 < ones < n:
        model.constant = ones / n if n else 0.5
        return model
    calibrating = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(5)) == 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((waves + 1, waves + 1)), np.zeros(waves + 1)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist()))
                gram += z.T @ z
                right += z.T @ np.asarray(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], ["gram", "right"])

    # the sample's bound also bounds the number of partition sums that meet on the driver
    parts = train.where(~calibrating).select("stats", "_y").coalesce(8).mapInArrow(sums, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(p["gram"]) for p in parts).reshape(waves + 1, waves + 1)
    right = sum(np.frombuffer(p["right"]) for p in parts)
    model.weight = np.linalg.solve(gram + ridge * np.eye(waves + 1), right)
    kept = train.where(calibrating).select("stats", "_y").collect() or train.select("stats", "_y").collect()
    model.knots = isotonic(model.raw(np.array([r["stats"] for r in kept])), np.array([r["_y"] for r in kept]))
    return model


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with its columns as they are and ``out``, a name that they don't have."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.score(np.array([statistics(t.as_py() or "") for t in batch.column(at)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """key, held_out, score, predicted. Labels of held-out rows are not read."""
    model = fit(docs, labels.where(~held_out(F.col(key))), key, **how)
    return scored(docs.select(key, "text"), model).select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", least: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, columns as they are."""
    model = fit(docs, labels.where(~held_out(F.col(key))), key, **how)
    name = unused(docs, "__score")
    return scored(docs, model, name).where(F.col(name) >= least).drop(name)
