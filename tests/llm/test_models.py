"""Near duplicates, chat, search, line labels, classifier and language model."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from loomlark.llm import ann, chat, network, pseudo, quality, rules, simhash, spelling
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(docs, odd):
    for table in (docs, odd):
        source = table.select("doc_id", "text").collect()
        fps = [fingerprint(r.text) for r in source]
        roots = classes(fps)
        least = {}
        for r, c in zip(source, roots):
            least[c] = min((x for x in (least.get(c), r.doc_id) if x is not None), default=None)
        want = Counter((r.doc_id, f, least[c]) for r, f, c in zip(source, fps, roots))
        got = simhash.near_duplicates(table).collect()
        assert Counter((r.doc_id, r.fp % 2**64, r.component) for r in got) == want
        kept = simhash.keep_one(table)
        assert kept.columns == table.columns and kept.count() == len(set(roots))
        assert Counter(fingerprint(r.text) for r in kept.collect()).most_common(1)[0][1] == 1


def test_links_equal_brute_force_on_dense_and_sparse_groups(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 300)]
    for center in rng.integers(0, 2**63, 4):
        for _ in range(150):
            f = int(center)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    for start in rng.integers(0, 2**63, 3):  # chains of four bits a step
        f = int(start)
        for _ in range(20):
            for b in rng.choice(64, 4, replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    roots = classes(fps)
    groups = {}
    for f, c in zip(signed, roots):
        groups.setdefault(c, set()).add(f)
    for axes in (None, 9, 10):  # more axes, the same links
        label = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), axes)).collect()
        got = {r.node: r.label for r in label}
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in got if got[n] == c) for c in set(got.values())}


def test_axes_follow_the_number_of_fingerprints():
    assert [simhash.axes_for(n) for n in (0, 10**8, 10**9, 5 * 10**9)] == [8, 8, 9, 10] and len(simhash._grids(8)) == 70
    for axes in (8, 9, 11):
        whole = 0
        for _, mask in simhash._grids(axes):
            whole |= int(mask)
        assert whole == 2**64 - 1


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 1000)).astype(np.uint64)
    b[:500] = a[:500] ^ np.uint64(0b1011)
    count = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)) for k in range(32)], 1).astype(int)
    want = np.abs(count(a) - count(b)).sum(1)
    got = simhash.manhattan(simhash.embed(a), simhash.embed(b))
    assert (got == want).all() and (got <= np.bitwise_count(a ^ b)).all()


def test_chat_round_trip_and_order(spark, sf):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[\\INST]", "<s", "", "a\n", "[", "[/", "\\\\<s>", "[ROLE]x[/ROLE]y[/TURN]"]
    for role in ("user", "assistant", "system", "", "tool [/ROLE]", "\\"):
        for text in hard:
            whole = "".join(t for t, _ in chat.TEMPLATE.segments(role, text)) * 2
            assert [(r, t) for r, t, _ in chat.TEMPLATE.read(whole)] == [(role, text)] * 2
    rows = [(None, 0, "user", "x"), (1, 0, "user", None), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, None, "n"), (2, None, "assistant", "first"), (2, 0, "user", "b"), (2, 0, "user", "a"), (3, 1, "assistant", "B"), (3, 0, "user", "A"), *[(4, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(3000)]]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    for source in (table, spark.read.parquet(f"{sf}/conversations.parquet")):
        by = {}
        for r in sorted(source.collect(), key=lambda r: (-1 if r.turn is None else r.turn, r.role or "", r.text or "")):
            by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
        got = {r.conv_id: r for r in chat.digests(chat.format_turns(source)).collect()}
        assert set(got) == set(by)
        for c, turns in by.items():
            said = "".join(t for r, t in turns if r == "assistant")
            assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    flags = {r.conv_id: r.in_order for r in chat.digests(chat.format_turns(table)).collect()}
    assert flags == {None: True, 1: False, 2: False, 3: True, 4: True}
    assert chat.digests(chat.format_turns(table.limit(0))).count() == 0


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    index = ann.Index(codes)
    for q in codes[:20]:
        distance = np.bitwise_count(codes ^ q).sum(1)
        for most in (0, 3, 4, 7, 11, 15, 32):
            assert index.within(q, most).tolist() == np.flatnonzero(distance <= most).tolist()


def clustered(n, rng, spread=0.25):
    x = rng.standard_normal((60, 64))[rng.integers(0, 60, n)] + spread * rng.standard_normal((n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_index_compares_few_codes_where_vectors_cluster():
    rng = np.random.default_rng(8)
    x = clustered(6000, rng)
    norm = np.linalg.norm(x, axis=1).max()
    projection = ann.fit(x[:2000], norm)
    most = ann.radius(x[:2000], norm, projection, 20, 0.97)
    index, codes = ann.Index(ann.codes(ann._lifted(x, norm), projection)), ann._query_codes(x[:100], projection)
    hits = 0
    for k in range(100):
        near = index.within(codes[k], most)
        score = x @ x[k]
        score[k] = -np.inf
        hits += len(set(near.tolist()) & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 2000 and index.compared < 0.3 * 100 * len(x)


def test_recall_beyond_the_sample_with_unequal_lengths(spark):
    rng = np.random.default_rng(9)
    for x in (rng.standard_normal((12_000, 24)) * rng.uniform(0.2, 3, (12_000, 1)), clustered(12_000, rng) * rng.uniform(0.5, 2, (12_000, 1))):
        table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(table, every=200, sample_rows=2000, shard_rows=3000).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, 12_000, 200):
            score = x @ x[q]
            score[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
        assert hits >= 0.9 * 20 * 60


def test_equal_scores_across_shards(spark):
    table = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(500)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.search(table, every=250, shard_rows=7).collect()))
    assert [r[2] for r in got if r[0] == 0] == list(range(1, 21)) and [r[2] for r in got if r[0] == 250] == list(range(20))


def test_neighbours(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    X = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = X @ X[q]
        s[q] = -9
        best = np.lexsort((ids, -s))[:20]
        found = got[ids[q]]
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - X[q] @ X[ids.tolist().index(f[1])]) < 1e-12 for f in found)
        hits, total = hits + len({f[1] for f in found} & set(ids[best].tolist())), total + 20
    assert hits / total >= 0.9


def test_many_shards_and_blocks_lose_no_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = sorted(map(tuple, ann.search(table, every=3, bits=64, cover=1.0, shard_rows=10_000, block_rows=10_000).collect()))
        many = sorted(map(tuple, ann.search(table, every=3, bits=64, cover=1.0, shard_rows=60, block_rows=20).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r[:3] for r in one] == [r[:3] for r in many] and len(many) == 20 * table.where("vec_id % 3 = 0").count()


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0]), (160, []), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [-1.0, -1.0]), (0, [1.0, 0.0]), (None, [0.5, 0.5])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, row string")
    got = ann.search(table).collect()
    assert {r.query_id for r in got} == {0, 20}
    zero = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0)
    assert len(zero) == 12 and zero[:4] == [(1, 1, 3.0), (1, 1, 3.0), (2, 2, 3.0), (2, 2, 3.0)] and zero[4][1:] == (0, 1.0)
    assert ann.search(table.limit(0)).count() == 0 and ann.search(table.where("vec_id = 20")).count() == 0


def line_counts(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(marked)


def test_quality_rules(docs, labels, odd, none):
    field = rules.train(docs, labels)
    for table in (docs, odd):
        got = rules.judge(table, field).collect()
        want = Counter((r.doc_id, *line_counts(r.text or "")) for r in table.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert rules.judge(none, rules.train(none, labels)).count() == 0
    assert rules.judge(docs, rules.train(docs, labels.limit(0))).where("not base_failed and not kept").count() == 0


def test_lines_judge_documents_that_were_not_fit_on(spark, sf):
    big = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    more = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    apart = quality.held_out(F.col("doc_id"))
    kept = rules.judge(big, rules.train(big, more.where(~apart))).join(more.where(apart), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in kept if r.quality == 1) and sum(r.kept for r in kept if r.quality == 0) <= 0.1 * len(kept)


def test_long_and_repeated_documents_are_fit_on(spark, labels):
    good = "\n".join(f"The river of the north runs by the old town {k}." for k in range(3000))
    bad = "\n".join(f"Buy $$$ NOW!!! {k} ###" for k in range(3000))
    table = spark.createDataFrame([(1, good), (2, bad), *[(1, good)] * 3], "doc_id long, text string")
    own = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(table, rules.train(table, own), with_lines=True).collect()}
    assert got[1].content_share > 0.9 and got[2].content_share < 0.1 and len(got[1].line_states) == 3000
    only = rules.train(table, own, most_lines=1)  # the bound ends the sample after its first document
    assert (only.weight[0] == [1.0, 0.0]).all()


def test_lines_within_a_document_differ(spark):
    text = [f"A quiet sentence about the hills and rivers number {k}." for k in range(12)]
    junk = [f"### BUY {k} $$$ NOW !!!" for k in range(12)]
    rows = [(k, "\n".join(text[:8] + junk[:4]), 1) for k in range(40)] + [(100 + k, "\n".join(junk), 0) for k in range(40)]
    x = [(*rules.line_features(t), 1 - y) for _, t, y in rows]
    states = rules.fit_documents(x).viterbi(x[0][0])
    assert states[:8].sum() == 0 and states[8:].all()


def test_viterbi_and_gradient():
    rng = np.random.default_rng(4)
    field = rules.Field(rng.standard_normal((rules.N_FEATURES, 2)), rng.standard_normal((2, 2)))
    for _ in range(20):
        x = rng.standard_normal((6, rules.N_FEATURES))
        best = max(range(64), key=lambda s: sum((x[t] @ field.weight)[s >> t & 1] for t in range(6)) + sum(field.step[s >> t & 1, s >> (t + 1) & 1] for t in range(5)))
        assert field.viterbi(x).tolist() == [best >> t & 1 for t in range(6)]
    x = [(np.eye(rules.N_FEATURES)[[k % 3] * 4], k % 3 == 0) for k in range(30)]
    learned = rules.fit_field([(a, np.full(4, int(b))) for a, b in x])
    assert all(set(learned.viterbi(a).tolist()) == {int(b)} for a, b in x)


def test_field_gradient_is_that_of_the_likelihood():
    """At the maximum, expected and observed counts agree but for the decay: so no small step raises the regularised likelihood."""
    rng = np.random.default_rng(6)
    chains = [(rng.standard_normal((5, rules.N_FEATURES)), rng.integers(0, 2, 5)) for _ in range(12)]

    def likelihood(w, s, decay=1e-3):
        total = 0.0
        for x, y in chains:
            scores = [sum((x[t] @ w)[p >> t & 1] for t in range(5)) + sum(s[p >> t & 1, p >> (t + 1) & 1] for t in range(4)) for p in range(32)]
            own = sum(int(v) << t for t, v in enumerate(y))
            total += scores[own] - np.logaddexp.reduce(scores)
        return total / 60 - decay / 2 * ((w**2).sum() + (s**2).sum())

    field = rules.fit_field(chains, steps=3000, rate=0.02)
    best = likelihood(field.weight, field.step)
    for _ in range(20):
        assert likelihood(field.weight + 0.02 * rng.standard_normal(field.weight.shape), field.step + 0.02 * rng.standard_normal((2, 2))) < best + 1e-6


def test_quality_classifier(spark, sf, labels, odd, none):
    big = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    more = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    rows = quality.classify(big, more).join(more, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    flipped = more.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    same = lambda t: sorted((r.doc_id, r.score) for r in quality.classify(big.limit(100), t).collect())
    assert same(more) == same(flipped)
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)


def test_ridge_equals_a_direct_solution(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    more = docs.unionByName(docs.limit(50)).repartition(7)  # repeated rows, other partitions
    model = quality.fit(docs, labels, waves=60)
    again = quality.fit(more, labels, waves=60)
    assert np.allclose(model.weight, again.weight, atol=1e-6)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(5)) == 0).alias("kept_out")).collect()
    stats = np.array([quality.statistics(r.text or "") for r in rows])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.maximum(stats.std(0), 1e-6) + (stats.std(0) == 0))
    use = np.array([not r.kept_out for r in rows])
    z = model.features(stats)
    y = np.array([float(r.quality) for r in rows])
    direct = np.linalg.solve(z[use].T @ z[use] + 0.3 * np.eye(61), z[use].T @ y[use])
    assert np.allclose(model.weight, direct, atol=1e-6)
    x, k = (stats - model.mean) / model.scale, rng_pairs(len(rows))
    near = np.exp(-((np.clip(x[k[0]], -4, 4) - np.clip(x[k[1]], -4, 4)) ** 2).sum(1) / 32)  # the Gaussian kernel of width 4
    wide = quality.fit(docs, labels, waves=4000).features(stats)[:, :-1]
    assert np.abs((wide[k[0]] * wide[k[1]]).sum(1) - near).max() < 0.12


def rng_pairs(n):
    return np.random.default_rng(1).integers(0, n, (2, 200))


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(y) > 0).all() and len(x) == 3 and x[1] == 2.5


def test_spelling_is_a_distribution():
    words = [w.encode() for w in "a an the they river rivers über naïve x1 x2 don't café".split()]
    n = np.arange(1, len(words) + 1)
    triples, shapes = spelling.counts(words, n)
    assert triples.sum() == sum((len(w) + 1) * k for w, k in zip(words, n)) and shapes.sum() == n.sum()
    model = spelling.Spelling(triples, words[:3])
    assert abs(model.ends.sum() - 1) < 1e-9
    shape, log_p = model._read(words)
    for w, s, p in zip(words, shape, log_p):  # letter by letter
        x = y = 0
        total = 0.0
        for b in [*w, 10]:
            z = int(spelling._CODE[b])
            total += model.log_p[(x * 64 + y) * 64 + z] + model.log_byte[b]
            x, y = (y, z) if z else (x, y)
        assert math.isclose(total, p) and s == spelling._SHAPE[x * 64 + y]
    # all words of a shape: its mass is that of the pairs of letters that end there, less the own words
    mass = np.bincount(spelling._SHAPE, model.ends.ravel(), spelling.SHAPES)
    own, p = model._read(words[:3])
    assert np.allclose(np.exp(model.log_mass), np.maximum(mass - np.bincount(own, np.exp(p), spelling.SHAPES), 1e-300))


def windows_of(ids, edge):
    return [tuple(int(ids[j]) if 0 <= j < len(ids) else edge for j in (i - 2, i - 1, i + 1, i + 2)) for i in range(len(ids))]


def plain_log_p(theta, near, target):
    tables, first, second = network.parts(theta.astype(np.float64))
    h = np.tanh(sum(tables[k][v] for k, v in enumerate(near)))
    h[-1] = 1
    soft = lambda z: z - np.logaddexp.reduce(z)
    return soft(h @ first)[target // 64] + soft(h @ second[target // 64])[target % 64]


def test_pseudo_likelihood_equals_brute_force(spark, docs, odd, none):
    from pyspark.sql import DataFrame

    some = docs.select("doc_id", "text").limit(60)
    table = some.unionByName(some.limit(8)).unionByName(odd.select("doc_id", "text").where("doc_id <> 6"))
    rows = table.collect()
    table = spark.createDataFrame(rows, table.schema)
    model = pseudo.train(table)
    texts = [(r.text or "").encode().lower().split() for r in rows]
    read = [model.vocabulary.read(t) if t else (np.empty(0, int),) * 3 for t in texts]
    seen, whole = Counter(), Counter()
    kinds = {}
    for ids, _, names in read:
        for near, name in zip(windows_of(ids, model.vocabulary.edge), names.tolist()):
            seen[near, name] += 1
            whole[near] += 1
            kinds.setdefault(near, set()).add(name)
    want, alone = [], []
    for r, (ids, logs, names) in zip(rows, read):
        total = net = 0.0
        for i, near in enumerate(windows_of(ids, model.vocabulary.edge)):
            p = plain_log_p(model.theta, near, int(ids[i])) + logs[i]
            net += p
            n, of = seen[near, int(names[i])], whole[near]
            if of > 1:
                p = math.log((max(n - 1.5, 0) + 0.5 * (len(kinds[near]) - (n == 1)) * math.exp(p)) / (of - 1))
            total += p
        want.append((r.doc_id, len(ids), total))
        alone.append((r.doc_id, len(ids), net))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    for frame, expected in ((pseudo.pseudo_likelihood(table), want), (pseudo.score(table, model), alone)):
        assert isinstance(frame, DataFrame)
        got = order([(r.doc_id, r.n_tokens, r.log_likelihood) for r in frame.collect()])
        for a, b in zip(got, order(expected), strict=True):
            assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=2e-3, abs_tol=2e-2)
    got = pseudo.pseudo_likelihood(odd).collect()
    assert len(got) == odd.count() and all(r.log_likelihood <= 0 and (r.n_tokens > 0 or (r.log_likelihood == 0 and r.mean_log_probability is None)) for r in got)
    assert pseudo.pseudo_likelihood(none).count() == 0


def test_scores_do_not_depend_on_partitions(spark, docs):
    scores = []
    for n in (1, 8, 64):
        rows = pseudo.pseudo_likelihood(docs.repartition(n)).collect()
        scores.append({r.doc_id: r.log_likelihood for r in rows})
    for other in scores[1:]:
        assert all(math.isclose(scores[0][k], other[k], rel_tol=1e-5, abs_tol=1e-4) for k in scores[0])


def test_many_blocks_pages_and_buckets_agree_with_few(spark, docs, monkeypatch):
    few = {r.doc_id: r.log_likelihood for r in pseudo.pseudo_likelihood(docs.repartition(3)).collect()}
    monkeypatch.setattr(pseudo, "PAGE", 3000)
    monkeypatch.setattr(pseudo, "BUCKET", 1000)
    many = {r.doc_id: r.log_likelihood for r in pseudo.pseudo_likelihood(docs.repartition(3)).collect()}
    assert all(math.isclose(few[k], many[k], rel_tol=1e-5, abs_tol=1e-4) for k in few)


def test_model_beats_word_frequencies_on_texts_it_has_not_seen(spark, sf):
    big = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").dropDuplicates(["text"])
    model = pseudo.train(big.where("doc_id % 5 <> 0"))
    rest = big.where("doc_id % 5 = 0")
    untrained = pseudo.Model(model.vocabulary, network.start(model.vocabulary.frequency))
    mean = lambda m: (lambda r: r[0] / r[1])(pseudo.score(rest, m).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first())
    vocabulary, frequency = model.vocabulary, np.log(model.vocabulary.frequency / model.vocabulary.frequency.sum())
    words = [w for r in rest.collect() for w in (r.text or "").encode().lower().split()]
    ids, logs, _ = vocabulary.read(words)
    unigram = (frequency[ids] + logs).mean()
    assert abs(mean(untrained) - unigram) < 0.1 and mean(model) > unigram + 0.3


def test_copies_and_real_words_score_above(spark, docs):
    n = Counter(w for r in docs.collect() for w in (r.text or "").lower().split())
    real, rare = n.most_common(400)[-1][0], [w for w, k in n.items() if k == 1][:40]
    made = " ".join(rare)
    more = spark.createDataFrame([(-1, f"{real} of the {real}"), (-2, "qzxkvj of the qzxkvj"), (-3, made), (-4, made), (-5, " ".join(reversed(rare)))], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_probability for r in pseudo.pseudo_likelihood(docs.select("doc_id", "text").unionByName(more)).where("doc_id < 0").collect()}
    assert got[-2] < got[-1] - 1 and math.isclose(got[-3], got[-4], rel_tol=1e-6) and got[-3] > got[-5] + 5


def test_network_gradient_and_windows():
    rng = np.random.default_rng(5)
    theta = network.start(rng.uniform(1, 9, network.SYMBOLS)).astype(np.float64)
    target = rng.integers(0, 300, 60).astype(np.uint16)
    near = rng.integers(0, 300, (4, 60)).astype(np.uint16)
    loss = lambda p: -network.log_probability(p, near, target).mean()
    assert all(math.isclose(network.log_probability(theta, near, target)[i], plain_log_p(theta, near[:, i], int(target[i])), rel_tol=1e-9) for i in range(60))
    moved, memory = theta.copy(), np.zeros_like(theta)
    with np.errstate(all="ignore"):
        network.step(moved, memory, near, target, 0.0)
    used = np.flatnonzero(memory > 1e-10)
    for k in rng.choice(used, 40, replace=False):
        d = np.zeros_like(theta)
        d[k] = 1e-5
        assert math.isclose(((loss(theta + d) - loss(theta - d)) / 2e-5) ** 2, memory[k], rel_tol=1e-2, abs_tol=1e-9)
    got = network.windows(np.array([5, 6, 7, 8], np.uint16), np.array([3, 0, 1]), 9)
    assert got.T.tolist() == [[9, 9, 6, 7], [9, 5, 7, 9], [5, 6, 9, 9], [9, 9, 9, 9]]


@pytest.mark.parametrize("name", ["near_duplicates", "keep_one"])
def test_no_documents(none, name):
    assert getattr(simhash, name)(none).count() == 0
