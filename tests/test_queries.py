import glob
import os

import duckdb
import pytest

from paperloom.plans import registry


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for p in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, tiny, duck, name):
    df = registry.QUERIES[name](spark, tiny)
    result = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([norm(r[columns.index(c)]) for c in sorted(columns)]) for r in result.fetchall())
    assert sorted(repr([norm(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0


def test_core_needs_no_subpackage():
    source = "".join(open(p).read() for p in glob.glob("paperloom/**/*.py", recursive=True) if "/llm/" not in p)
    assert "paperloom.llm" not in source
