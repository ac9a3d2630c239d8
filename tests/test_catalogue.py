"""Every registered query of the reference's operators against DuckDB on the same tables."""

import math
import re
from datetime import date, datetime

import duckdb
import pytest

from loomlark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return format(float(x), ".9g")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, date) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_duckdb(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = df.collect()
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert sorted(tuple(value(r[c]) for c in order) for r in got) == sorted(tuple(value(r[names.index(c)]) for c in order) for r in result.fetchall())


def test_entry_needs_neither_the_llm_folder_nor_the_pipeline(monkeypatch):
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def without(name, *a, **k):
        if re.match(r"loomlark\.llm|corpus_pipeline", name):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", without)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLE)


def test_nothing_else_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "loomlark.llm" not in p.read_text(), p
