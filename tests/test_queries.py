"""Every query against its reference SQL on the smallest tables."""

import math
import os
import sys
from collections import Counter

import duckdb
import pytest

from conftest import DATA, ROOT

sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402

FOLDER = f"{DATA}/sf0.001"
CORE = {k: q for m in entry._modules() if not m.__name__.startswith("wetlens.llm") for k, q in m.QUERIES.items()}
SQL = entry.oracle_sql()


def rows(names, data):
    def same(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v

    at = [names.index(c) for c in sorted(names)]
    return Counter(tuple(map(str, (same(r[i]) for i in at))) for r in data)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, FOLDER)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", ["agg_features36", "jn_patch_semi", "p4_found", "p4_tile", "p5_found", "roi_merge_windows"])
def test_query_with_generated_code(spark, duck, name):
    """The other tests run without whole-stage code generation."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    try:
        df = CORE[name](spark, FOLDER)
        cur = duck.execute(SQL[name])
        assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_entry(spark):
    assert entry.entry(spark).columns == ["row_a", "row_b"]


def test_sql_names_queries():
    assert set(SQL) <= set(entry.queries())


def test_nothing_outside_imports_the_llm_part():
    for p in (ROOT / "wetlens").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "wetlens.llm" not in p.read_text(encoding="utf-8"), p
