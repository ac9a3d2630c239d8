"""Packing, mixing, secrets and counts against plain Python over the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from loomlark.llm import counts, mixing, packing, secrets, tokens
from loomlark.llm.shared import word_count
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


TRICKY = ["", " ", "a", " a b", "a  b", "a \n b", "don't I'LL", "x<|endoftext|>y <|endoftext|> z", "naïve café zwölf", "1234 5678", "\x1c \x1d", "日本語 テスト", "tab\tx", "end ", "\x00 a", "a b", "ΣΑΣ İ", "🙂 🙂"]


def test_memoised_ids_and_counts_equal_the_library():
    encode = tokens.byte_ids(RANKS)
    for text, want in zip(TRICKY, ids_of(TRICKY)):
        assert np.frombuffer(encode(text), "<u4").tolist() == want, text
    count, library = tokens.word_counts(WORDS), Tokenizer.from_file(WORDS)
    for text in [*TRICKY, "a\x1cb", "<|startoftext|>a<|endoftext|>", "A<|ENDOFTEXT|>"]:
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_ids_equal_the_library_on_random_strings():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encode = tokens.byte_ids(RANKS)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = st.sampled_from([" ", "  ", "\n", "\t", "'s", "'LL", "<|endoftext|>", "\x00", "\x1c", "é", "ſ", "日", "٣", "🙂", "\u200d", "\u0301", "\xa0", "word", "Word", "12", "!?"])

    @settings(max_examples=1500, deadline=None, database=None)
    @given(st.one_of(st.text(max_size=60), st.lists(parts, max_size=20).map("".join)))
    def same(text):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    same()


def check_pieces(rows, source, limit=2048):
    texts = [r.text or "" for r in source]
    want = Counter()
    for r, ids in zip(source, ids_of(texts)):
        ids = [*ids, 0]
        for k, (s, n) in enumerate(packing.cut(len(ids), limit)):
            assert n <= limit and (k == 0 or n == limit)
            want[r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limit
    return len(by), sum(r.length for r in rows)


def test_packing_round_trip(docs, odd):
    for table in (docs, odd):
        rows = packing.pack(packing.pieces(table, RANKS)).collect()
        used, total = check_pieces(rows, table.select("doc_id", "text").collect())
        assert used <= math.ceil(total / 2048) * 1.01 + 1


def test_packing_keeps_every_capacity_and_matches_exhaustive_choice():
    rng = np.random.default_rng(0)
    for rule in ("norm", "dot"):
        lengths = rng.integers(1, 90, 300).tolist()
        capacity, weights = (100, 4, 5000), (1.0, 0.1, 0.2)
        placed = packing.best_fit([min(n, 70) for n in lengths], capacity, weights, rule)
        bins = []  # the same choice over all bins
        for n in sorted((min(n, 70) for n in lengths), reverse=True):
            best = None
            for b, (t, d, a) in enumerate(bins):
                if t >= n and d >= 1 and a >= n * n:
                    score = weights[0] * ((t - n) / 100) ** 2 + weights[1] * ((d - 1) / 4) ** 2 + weights[2] * ((a - n * n) / 5000) ** 2 if rule == "norm" else -(weights[0] * n * t / 1e4 + weights[1] * d / 16 + weights[2] * n * n * a / 25e6)
                    if best is None or score < best[0]:
                        best = (score, b)
            if best is None:
                bins.append((100 - n, 3, 5000 - n * n))
            else:
                t, d, a = bins[best[1]]
                bins[best[1]] = (t - n, d - 1, a - n * n)
        per = {}
        for n, (b, _) in zip(lengths, placed):
            per.setdefault(b, []).append(min(n, 70))
        assert all(sum(p) <= 100 and len(p) <= 4 and sum(x * x for x in p) <= 5000 for p in per.values())
        assert len(per) == len(bins)


def test_packing_ids_reassemble(docs):
    rows = packing.pieces(docs.limit(20), RANKS, with_ids=True).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by.setdefault(r.doc_id, []).extend(r.ids)
    source = docs.limit(20).collect()
    assert [by[r.doc_id] for r in source] == [[*i, 0] for i in ids_of([r.text for r in source])]


def water(sizes, weights, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing(docs, odd):
    for table in (docs, odd):
        sized = table.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        rows, again = mixing.copies(sized, "doc_id").collect(), mixing.copies(sized, "doc_id").collect()
        assert Counter(rows) == Counter(again)
        source = table.collect()
        assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in source)
        sizes = Counter()
        for r in rows:
            sizes[r.source] += r.size
        want, taken, largest = water(dict(sizes), (3, 1, 2)), Counter(), Counter()
        for r in rows:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.copies <= 2
            taken[r.source] += r.copies * r.size
            largest[r.source] = max(largest[r.source], r.size)
        assert all(abs(taken[s] - want[s]) <= 1.01 * largest[s] for s in sizes)


def test_mix_emits_whole_rows(odd):
    out = mixing.mix(odd, copy="n").collect()
    assert out[0].__fields__[-1] == "n" and set(odd.columns) <= set(out[0].__fields__)
    assert max(Counter((r.doc_id, r.text, r.n) for r in out).values()) <= 2  # the repeated row stands twice


def test_mix_counts_rows_with_repeated_and_null_keys_on_their_own(spark):
    rows = [(k % 7 if kind == "repeated" else None, f"{source}{k} " + "word " * (k % 5), source) for source, n in (("a", 100), ("b", 100), ("c", 100)) for kind in ("repeated", "null") for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = mixing.copies(table.select("doc_id", "source", word_count(F.col("text")).alias("size")), "doc_id").collect()
    assert {r.copies for r in counted} >= {0, 1, 2} and any(r.target < r.source_size for r in counted)
    target, taken = {r.source: r.target for r in counted}, Counter()
    out = mixing.mix(table).collect()
    for r in out:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= 1.01 * 5 for s in target)
    size = lambda r: len(r.text.split())
    assert Counter((r.doc_id, r.source, size(r)) for r in out) == sum((Counter({(r.doc_id, r.source, r.size): r.copies}) for r in counted), Counter())


def spans_of(text):
    rules = ((r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))
    found = [(m.start(), k, m.end()) for k, (p, least, g) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


SECRETS = ["token=secret: abcdefghijklmnop", "PASSWD:'aaaaaaaaaaaa'", "é🙂 api-key apikey=abcdef012345", "AKIAAKIAAKIAAKIAAK AKIA12", "0123456789abcdef0 g0123456789abcde", "secret  :  \"x\" token = aaaaaaaaaaa token==aaaaaaaaaaa", "$0 \\ token=abcdefghijkl", "ſecret=abcdefghijklmn tokenK=", ""]


def test_secrets(spark, docs, odd):
    more = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS)], "doc_id long, text string")
    for table in (docs, odd, more):
        want = Counter((r.doc_id, spans_of(r.text or "")) for r in table.collect())
        got = secrets.scan(table).select("doc_id", secrets.shown(F.col("spans")).alias("s"), "digest").collect()
        assert Counter((r.doc_id, r.s) for r in got) == want
    assert {bytes(r.digest) for r in got} == {hashlib.sha256(t.encode()).digest() for t in SECRETS}


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    table = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    secrets.scan(table("token=abcdefghijkl", "x", "x"), ledger_path=path).collect()
    assert spark.read.parquet(path).count() == 2
    found = secrets.scan(table("x", "token=abcdefghijkl", "y", "y"), ledger_path=path)
    assert spark.read.parquet(path).count() == 3 and found.count() == 4 and found.where(F.size("spans") > 0).count() == 1


def test_redaction_leaves_no_secret(odd):
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = out.where("doc_id in (7, 10)").collect()
    assert all("[SECRET]" in r.text and spans_of(r.text) == "" and r.n_chars == len(r.text) for r in rows)
    same = Counter((r.doc_id, r.text) for r in odd.where("doc_id not in (7, 10)").collect())
    assert Counter((r.doc_id, r.text) for r in out.where("doc_id not in (7, 10)").collect()) == same


def test_counts_and_cache(spark, docs, odd, tmp_path):
    library = Tokenizer.from_file(WORDS)
    for table in (docs, odd):
        source = table.select("doc_id", "text").collect()
        want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in source)
        got = counts.count_tokens(table, WORDS).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)
    path = f"file://{tmp_path}/cache"
    table = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    counts.count_tokens(table("a b", "a  b ", "c"), WORDS, cache_path=path).collect()
    assert spark.read.parquet(path).count() == 2
    assert counts.count_tokens(table("c", "d"), WORDS, cache_path=path).count() == 2 and spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("run", [lambda t: packing.pack(packing.pieces(t, RANKS)), lambda t: mixing.copies(t.select("doc_id", "source", F.lit(1).alias("size")), "doc_id"), mixing.mix, secrets.scan, secrets.redact, lambda t: counts.count_tokens(t, WORDS)])
def test_empty_tables(none, run):
    assert run(none).count() == 0
