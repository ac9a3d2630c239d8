"""The corpus pipeline on a small table, stage by stage, and on odd rows."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from loomlark.llm import mixing, quality, secrets, simhash
from tokenizers import Tokenizer


def test_stages(spark, sf, docs, labels):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scans", "mixing_sources", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None
    steps, held = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, sf)
        held = spark.createDataFrame(out.collect(), out.schema)
        steps.append(held)
    first, second, third, fourth, fifth = steps[1:]
    accepted = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in first.collect()} == accepted
    roots = {r.component for r in simhash.near_duplicates(first).collect()}
    assert {r.doc_id for r in second.collect()} == roots
    assert third.count() == second.count() and secrets.scan(third).where("size(spans) > 0").count() == 0
    taken = Counter({r.doc_id: r.copies for r in mixing.copies(third.select("doc_id", "source", mixing.word_count(third.text).alias("size")), "doc_id").collect() if r.copies})
    assert Counter(r.doc_id for r in fourth.collect()) == taken
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in fourth.collect())
    assert fifth.agg({"length": "sum"}).first()[0] == want
    for table in steps[1:5]:
        assert table.columns == docs.columns


def test_odd_rows_and_empty_tables(spark, sf, odd, none):
    for table in (odd, none):
        held = table
        for _, stage in corpus_pipeline.STAGES[1:]:  # the classifier may reject every odd row
            out = stage(spark, held, sf)
            held = spark.createDataFrame(out.collect(), out.schema)
        assert (held.count() == 0) == (table.count() == 0)
        assert corpus_pipeline.classify(spark, table, sf).columns == table.columns
