"""Operator 5, language-model scoring by masked pseudo-likelihood.

A bidirectional window network (``network``), written and trained in numpy, predicts each token from the tokens on either side. A
document's score is the sum of the conditional log-probabilities of its tokens, each masked in turn.

Tokens are words. The most frequent ``OWN`` words of the corpus have a symbol each; any other word has the symbol of its shape, its last
two letters, and its own probability within that from a spelling model (``spelling``). So each word of any text has a probability
of its own: p(symbol | both sides) times p(word | symbol).

What is seen elsewhere in the corpus counts as well. For each window (four neighbour symbols) that occurs more than once, the network's p is
the lower order of an absolute discount: of the n words seen in it, *without the masked token itself*, w holds n(w), and
p(w | window) = (max(n(w) - D, 0) + D * kinds * p_network(w)) / n. A window that occurs once has the network's p alone. These
counts are of all windows of all texts and grow with the corpus. In them a word without a symbol goes by a digest of 16 bits, and its
p(word | symbol) is kept to 1/128 nat.

Plan: words are counted, texts are turned into symbols once and written in pages of about ``PAGE`` tokens. For training, texts are dealt by a
digest of their symbols into blocks of about ``TOKENS``, copies once; each block trains from the same start, in two rounds that
step over alternate windows, and the blocks' networks are averaged through a tree of partition sums. Blocks depend on the texts alone, so
the model is the same however a table is partitioned. For the windows, each page asks, in one blob of sorted distinct keys for each
bucket of keys, how often they occur; a window that holds a third of all tokens costs one key a page. A bucket answers
each page for windows that occur elsewhere. No task holds more than a page, a block or a bucket.

Cases: null and empty texts have no tokens and score 0; a missing neighbour is the edge symbol; repeated rows are scored each
and count each as windows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, repeat
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlark.llm import network
from loomlark.llm.shared import bounded_batches, discard, text_or_empty, written
from loomlark.llm.spelling import LETTERS, SHAPES, Spelling, counts as spelled_counts

OWN = network.SYMBOLS - SHAPES - 1
PAGE, TOKENS, BUCKET = 1 << 20, 1 << 20, 1 << 21
DISCOUNT = 0.5
_SYMBOL_BITS, _NAME_BITS, _UNIT = 12, 16, 128


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts. Counts are summed in tasks first, in memos of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out():
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for t in batch.column(0):
                held.update(t.as_buffer().to_pybytes().lower().split())
            if len(held) > 150_000:
                yield out()
        if held:
            yield out()

    return docs.select(text_or_empty(F.col("text")).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, as sorted and small numbers then compress well, compressed."""
    raw = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: pa.Buffer, *kinds: type, n: int | None = None) -> list[np.ndarray]:
    """What ``_pack`` took: arrays of these types and of one length, after ``n`` leading bytes that are returned first, if given."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd")
    raw, head = (raw[n:], [np.frombuffer(raw[:n], np.uint8)]) if n is not None else (raw, [])
    many, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, head
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, many * size, at).reshape(size, many).T).view(kind).ravel())
        at += many * size
    return out


class Vocabulary:
    """Symbols in order of frequency: the edge of a text, the own words, the shapes."""

    def __init__(self, own: list[tuple[bytes, int]], triples: np.ndarray, shapes: np.ndarray):
        words = [w for w, _ in own]
        n = np.full(network.SYMBOLS, 0.5)
        n[1 : 1 + len(own)] += [k for _, k in own]
        n[1 + OWN :] += shapes
        order = np.argsort(-n, kind="stable")
        place = np.empty(network.SYMBOLS, np.uint16)
        place[order] = np.arange(network.SYMBOLS)
        self.frequency, self.edge, self.shapes = n[order], int(place[0]), place[1 + OWN :]
        self.own = {w: int(place[k + 1]) for k, w in enumerate(words)}
        self.spelling = Spelling(triples, words)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, log p(word | symbol), and names: of an own word its symbol, of any other a digest."""
        own = np.fromiter(map(self.own.get, words, repeat(-1)), np.int64, len(words))
        shape, log_p = self.spelling.read(words)
        digest = np.fromiter(map(crc32, words), np.int64, len(words)) % ((1 << _NAME_BITS) - network.SYMBOLS) + network.SYMBOLS
        return np.where(own >= 0, own, self.shapes[shape]).astype(np.uint16), np.where(own >= 0, 0.0, log_p), np.where(own >= 0, own, digest).astype(np.uint16)


class Coder(dict):
    """A task's memo of what ``Vocabulary.read`` gave: word -> the number of the token that brought it. It starts anew beyond ``most`` words."""

    def __init__(self, vocabulary: Vocabulary, most: int = 250_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.held = (np.empty(0, np.uint16), np.empty(0), np.empty(0, np.uint16))
        self.place = np.empty(0, np.int32)  # token's number -> its word's place in ``held``

    def read(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        if len(self) > self.most:
            self._begin()
        base = len(self.place)
        at = np.fromiter(map(self.setdefault, words, count(base)), np.int64, len(words))
        first = np.flatnonzero(at == np.arange(base, base + len(words)))
        self.place = np.concatenate((self.place, np.zeros(len(words), np.int32)))
        if len(first):
            self.place[base + first] = len(self.held[0]) + np.arange(len(first))
            self.held = tuple(map(np.concatenate, zip(self.held, self.vocabulary.read([words[k] for k in first.tolist()]))))
        return tuple(x[self.place[at]] for x in self.held)


def vocabulary_of(words: DataFrame) -> Vocabulary:
    """From a written table of words with counts. What is collected are the own words and sums for each triple of letters and each shape."""
    own = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(OWN).collect()]
    known = {w for w, _ in own}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3 + SHAPES)
        for batch in batches:
            rest = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in known]
            if rest:
                total += np.concatenate(spelled_counts([w for w, _ in rest], np.array([n for _, n in rest])))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    total = np.zeros(LETTERS**3 + SHAPES)
    for r in words.select("word", "n").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        total[r["k"]] = r["n"]
    return Vocabulary(own, total[: LETTERS**3], total[LETTERS**3 :])


def pages(docs: DataFrame, vocabulary: Vocabulary, key: str) -> DataFrame:
    """keys, tokens, lengths (int32), words (float64: each text's sum of log p(word | symbol)), and packed, of each token, ids (symbols), names
    and costs (-log p(word | symbol) in 128ths), all uint16: a page a row."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, tokens = Coder(vocabulary), [], 0

        def out():
            keys = pa.concat_arrays([h[0] for h in held])
            blobs = [np.concatenate([h[k] for h in held]) for k in range(1, 6)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([len(blobs[2])]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs[:2]), *(pa.array([_pack(x)], pa.binary()) for x in blobs[2:])], ["keys", "tokens", "lengths", "words", "ids", "names", "costs"])

        for batch in batches:
            texts = [t.as_buffer().to_pybytes().lower().split() for t in batch.column(1)]
            lengths = np.array([len(t) for t in texts], np.int32)
            ids, logs, names = coder.read(list(chain.from_iterable(texts)))
            ends = np.cumsum(lengths, dtype=np.int64)
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            costs = np.minimum(np.round(-logs * _UNIT), 0xFFFF).astype(np.uint16)
            held.append((batch.column(0), lengths, sums[ends] - sums[ends - lengths], ids, names, costs))
            tokens += len(ids)
            if tokens >= PAGE:
                yield out()
                held, tokens = [], 0
        if sum(len(h[0]) for h in held):
            yield out()

    return docs.select(key, text_or_empty(F.col("text")).alias("text")).mapInArrow(run, f"keys array<{kind.simpleString()}>, tokens long, lengths binary, words binary, ids binary, names binary, costs binary")


def _arrays(lengths: pa.Scalar, *tokens: pa.Scalar) -> tuple[np.ndarray, ...]:
    return np.frombuffer(lengths.as_buffer(), np.int32), *(_unpack(x.as_buffer(), np.uint16)[0] for x in tokens)


def blocks(rows: DataFrame, tokens: int) -> DataFrame:
    """shard, lengths, ids: the distinct texts of pages in blocks that depend on the texts alone."""
    shards = max(1, ceil(tokens / TOKENS))
    spark = rows.sparkSession
    parts = min(shards, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        sent: set[bytes] = set()  # a text with many copies leaves a task once or so
        for batch in batches:
            for scalars in zip(batch.column(0), batch.column(1)):
                own = {}
                lengths, ids = _arrays(*scalars)
                ends, raw = 2 * np.cumsum(lengths, dtype=np.int64), ids.tobytes()
                for a, b in zip(chain((0,), ends[:-1].tolist()), ends.tolist()):
                    if a < b:
                        own.setdefault(xxh3_128_digest(raw[a:b]), raw[a:b])
                new = own.keys() - sent
                yield pa.RecordBatch.from_arrays([pa.array([own[d] for d in sorted(new)], pa.binary())], ["ids"])
                sent = new if len(sent) > 1_000_000 else sent | new

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def out():
            lengths = np.array([len(x) // 2 for x in held], np.int32)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([lengths.tobytes()], pa.binary()), pa.array([_pack(np.frombuffer(b"".join(held), np.uint16))], pa.binary())], ["shard", "lengths", "ids"])

        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != shard and held:
                    yield out()
                    held = []
                shard, x = s, x.as_buffer().to_pybytes()
                if not held or held[-1] != x:
                    held.append(x)
        if held:
            yield out()

    found = rows.select("lengths", "ids").mapInArrow(texts, "ids binary").select(F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"), "ids")
    return found.repartition(parts, "shard").sortWithinPartitions("shard", "ids").mapInArrow(join, "shard int, lengths binary, ids binary")


def _average(rows: DataFrame, fan: int = 8) -> np.ndarray | None:
    """Weighted mean of networks (weight double, theta binary of float64) through levels of partition sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, 0.0
        for batch in batches:
            for w, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                weight, total = weight + w, total + np.frombuffer(t.as_buffer()) * w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).tobytes()], pa.binary())], ["weight", "theta"])

    n = rows.count()
    while n > fan:
        n = ceil(n / fan)
        rows = written(rows.repartition(n).mapInArrow(add, "weight double, theta binary"), "networks")
    got = rows.collect()
    weight = sum(r["weight"] for r in got)
    return sum(np.frombuffer(r["theta"]) * (r["weight"] / weight) for r in got).astype(np.float32) if got else None


def fit(rows: DataFrame, vocabulary: Vocabulary, rounds: int = 2, rate: float = 0.4, batch_size: int = 8192) -> np.ndarray:
    """The averaged network of written blocks. Every window is stepped over in one of the rounds; a block takes 64 steps a round at least."""
    theta, edge = network.start(vocabulary.frequency), vocabulary.edge
    for r in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], theta=theta, r=r) -> Iterator[pa.RecordBatch]:
            weight, total = 0.0, 0.0
            for batch in batches:
                for scalars in zip(batch.column(0), batch.column(1)):
                    lengths, ids = _arrays(*scalars)
                    near, mine = network.windows(ids, lengths, edge)[:, r::rounds], ids[r::rounds]
                    size = max(256, min(batch_size, len(mine) // 64))
                    weight, total = weight + len(ids), total + network.trained(theta, near, mine, rate, size).astype(np.float64) * len(ids)
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).tobytes()], pa.binary())], ["weight", "theta"])

        found = written(rows.select("lengths", "ids").mapInArrow(run, "weight double, theta binary"), "networks")
        mean = _average(found)
        theta = theta if mean is None else mean
        discard(found)
    return theta


def _window_bits(bits: int) -> int:
    """How many bits name a window within one of ``2 ** bits`` buckets: the fewer, the more buckets."""
    return min(32, 64 - _NAME_BITS - bits)


def window_keys(ids: np.ndarray, names: np.ndarray, lengths: np.ndarray, edge: int, bits: int) -> np.ndarray:
    """One number for each token: a digest of its neighbours, of which the first ``bits`` name the bucket and the others the window within it,
    then the token's name."""
    near = network.windows(ids, lengths, edge).astype(np.uint64)
    key = near[0]
    for other in near[1:]:
        key = key << np.uint64(_SYMBOL_BITS) | other
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        key = key * np.uint64(odd)
        key ^= key >> np.uint64(32)
    return key >> np.uint64(64 - bits - _window_bits(bits)) << np.uint64(_NAME_BITS) | names


def asked(rows: DataFrame, edge: int, bits: int) -> DataFrame:
    """page, bucket, request: the distinct keys of each page's windows with how often they occur in it."""
    shift = np.uint64(_window_bits(bits) + _NAME_BITS)
    inside = np.uint64((1 << _window_bits(bits)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, *scalars in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3))):
                lengths, ids, names = _arrays(*scalars)
                keys, n = np.unique(window_keys(ids, names, lengths, edge, bits), return_counts=True)
                buckets = keys >> shift  # in order, as the keys are
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), buckets[1:] != buckets[:-1])))
                window, name, n = (keys >> np.uint64(_NAME_BITS) & inside).astype(np.uint32), keys.astype(np.uint16), n.astype(np.uint32)
                blobs = [_pack(window[a:b], name[a:b], n[a:b]) for a, b in zip(first, np.append(first[1:], len(keys)))]
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(first), pa.int64()), pa.array(buckets[first].astype(np.int32)), pa.array(blobs, pa.binary())], ["page", "bucket", "request"])

    return rows.select("page", "lengths", "ids", "names").mapInArrow(run, "page long, bucket int, request binary")


def answered(requests: DataFrame) -> DataFrame:
    """page, bucket, answer: which of the keys' windows occur more than once in the corpus, and for these the occurrences of the key, of its
    window, and the number of words seen in that."""

    def reply(held: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[list[int], list[bytes]]:
        every = np.sort(np.concatenate([k for _, k, _ in held]))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        keys, n = every[first], np.diff(first, append=len(every))
        for _, own, times in held:
            often = times > 1
            n[np.searchsorted(keys, own[often])] += times[often] - 1
        window = keys >> np.uint64(_NAME_BITS)
        first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        kinds, whole = np.diff(first, append=len(keys)), np.add.reduceat(n, first)
        run = np.repeat(np.arange(len(first)), kinds)
        pages, answers = [], []
        for page, own, _ in held:
            at = np.searchsorted(keys, own)
            again = whole[run[at]] > 1
            if again.any():
                at = at[again]
                pages.append(page)
                answers.append(_pack(np.packbits(again), *(x.astype(np.uint32) for x in (n[at], whole[run[at]], kinds[run[at]]))))
        return pages, answers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def out():
            pages, answers = reply(held)
            return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array([bucket] * len(pages), pa.int32()), pa.array(answers, pa.binary())], ["page", "bucket", "answer"])

        for batch in batches:
            for page, b, request in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2)):
                if b != bucket and held:
                    yield out()
                    held = []
                bucket = b
                window, name, times = _unpack(request.as_buffer(), np.uint32, np.uint16, np.uint32)
                held.append((page, window.astype(np.uint64) << np.uint64(_NAME_BITS) | name, times.astype(np.int64)))
        if held:
            yield out()

    return requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "page long, bucket int, answer binary")


def with_memory(log_p: np.ndarray, keys: np.ndarray, answers: list[tuple[int, pa.Buffer]], bits: int) -> np.ndarray:
    """Log-probabilities of words with what the corpus holds elsewhere, each token's own occurrence taken off."""
    own, inverse = np.unique(keys, return_inverse=True)
    shift = np.uint64(_window_bits(bits) + _NAME_BITS)
    n, whole, kinds = (np.zeros(len(own), np.uint32) for _ in range(3))
    for bucket, raw in answers:
        a, b = np.searchsorted(own, [np.uint64(bucket) << shift, np.uint64(bucket + 1) << shift])
        mask, *found = _unpack(raw, np.uint32, np.uint32, np.uint32, n=(b - a + 7) // 8)
        at = a + np.flatnonzero(np.unpackbits(mask, count=b - a))
        n[at], whole[at], kinds[at] = found
    at = np.flatnonzero(whole[inverse] > 1)
    n, whole, kinds = (x[inverse[at]].astype(float) for x in (n, whole, kinds))
    log_p = log_p.copy()
    log_p[at] = np.log((np.maximum(n - 1 - DISCOUNT, 0) + DISCOUNT * (kinds - (n == 1)) * np.exp(log_p[at])) / (whole - 1))
    return log_p


@dataclass
class Model:
    vocabulary: Vocabulary
    theta: np.ndarray


def _scored(rows: DataFrame, model: Model, key: str, bits: int = 0) -> DataFrame:
    """key, n_tokens, log_likelihood, mean_log_probability from pages; ``answers`` where they have them."""
    theta, edge = model.theta, model.vocabulary.edge
    remembered = "answers" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = _arrays(batch.column(1)[i], batch.column(2)[i])
                log_p = network.log_probability(theta, network.windows(ids, lengths, edge), ids)
                answers = [(a["bucket"].as_py(), a["answer"].as_buffer()) for a in batch.column(6)[i].values or []] if remembered else []
                if answers:
                    _, names, costs = _arrays(*(batch.column(k)[i] for k in (1, 4, 5)))
                    word = log_p - costs / _UNIT
                    log_p += with_memory(word, window_keys(ids, names, lengths, edge, bits), answers, bits) - word
                ends, sums = np.cumsum(lengths, dtype=np.int64), np.concatenate(([0.0], np.cumsum(log_p)))
                total = sums[ends] - sums[ends - lengths] + np.frombuffer(batch.column(3)[i].as_buffer())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(lengths.astype(np.int64)), pa.array(np.minimum(np.where(lengths > 0, total, 0.0), 0.0))], [key, "n_tokens", "log_likelihood"])

    kind = rows.schema["keys"].dataType.elementType.simpleString()
    found = rows.select("keys", "lengths", "ids", "words", *(["names", "costs", "answers"] if remembered else [])).mapInArrow(run, f"`{key}` {kind}, n_tokens long, log_likelihood double")
    return found.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def _learnt(docs: DataFrame, key: str, **how) -> tuple[Model, DataFrame, int]:
    """The model of a corpus, its written pages with a number each, and how many tokens they hold."""
    bounded_batches(docs.sparkSession)
    words = written(count_words(docs), "words")
    vocabulary = vocabulary_of(words)
    discard(words)
    rows = written(pages(docs, vocabulary, key).withColumn("page", F.monotonically_increasing_id()), "pages")
    tokens = rows.agg(F.sum("tokens")).first()[0] or 0
    dealt = written(blocks(rows, tokens), "blocks")
    theta = fit(dealt, vocabulary, **how)
    discard(dealt)
    return Model(vocabulary, theta), rows, tokens


def train(docs: DataFrame, **how) -> Model:
    """The model of ``docs``; ``how``: rounds, rate, batch_size."""
    return _learnt(docs.select("text", F.lit(0).alias("_key")), "_key", **how)[0]


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, log_likelihood (the sum), mean_log_probability (null without tokens) of any texts, by the network alone."""
    bounded_batches(docs.sparkSession)
    return _scored(pages(docs, model.vocabulary, key), model, key)


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """As ``score``, of a corpus by its own model: each token by the network and by what the rest of the corpus holds in its window."""
    model, rows, tokens = _learnt(docs, key, **how)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    bits = max(ceil(tokens / BUCKET), 2 * cores).bit_length()
    answers = written(answered(asked(rows, model.vocabulary.edge, bits)), "answers")
    answers = answers.groupBy(F.col("page").alias("_page")).agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return _scored(rows.join(answers, F.col("page") == F.col("_page"), "left"), model, key, bits)
