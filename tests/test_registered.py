"""Registered queries against their SQL on the smallest tables, and the driver's contract without optional parts."""

import re
import subprocess
import sys
import textwrap
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from factorspark import queries, queries_eval, queries_prep, queries_sources  # noqa: F401

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.astype(object).itertuples(index=False):
        out.append(tuple("~" if pd.isna(v) else round(float(v), 5) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, str(SF)).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 * max(1, abs(u))), (x, y)


@pytest.mark.parametrize(
    ("thin", "end"),
    [
        ("year(l_shipdate) = 1995", "2002-01-01"),  # a first year of zeros: a fold whose training ratio is NaN
        ("year(l_shipdate) = 1998", "2002-01-01"),  # a test of NaN
        ("year(l_shipdate) = 1995", "2001-04-01"),  # and a last year of one return: an infinite ratio
        ("false", "1996-04-01"),  # a single fold
        ("true", "2002-01-01"),  # nothing but zeros
        ("false", "1995-02-01"),  # no return at all
    ],
)
def test_rolling_gate_keeps_years_without_spread(spark, tmp_path, thin, end):
    """Suppliers that sell little are not in the universe: the book is empty then, and its return zero."""
    c = duckdb.connect()
    for name, path in (("lineitem", SF / "lineitem.parquet"), ("supplier", SF / "supplier.parquet")):
        c.sql(f"CREATE VIEW {name}0 AS SELECT * FROM '{path}'")
    c.sql(f"CREATE TABLE lineitem AS SELECT * REPLACE (CASE WHEN {thin} THEN 1 ELSE l_quantity END AS l_quantity) FROM lineitem0 WHERE l_shipdate < DATE '{end}'")
    c.sql("CREATE TABLE supplier AS SELECT * FROM supplier0")
    for name in ("lineitem", "supplier"):
        c.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got, want = queries.QUERIES["rolling_gate"](spark, str(tmp_path)).toPandas(), c.sql(queries.SQL["rolling_gate"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_contract_without_the_optional_subpackage(tmp_path):
    """The entry module imports and the library's own queries are there when the text operators and the pipeline are gone."""
    code = f"""
        import shutil, sys
        shutil.copytree({str(ROOT)!r}, {str(tmp_path / 'r')!r}, ignore=shutil.ignore_patterns('.git'))
        shutil.rmtree({str(tmp_path / 'r/factorspark/llm')!r}, ignore_errors=True)
        import os
        os.path.exists({str(tmp_path / 'r/corpus_pipeline.py')!r}) and os.remove({str(tmp_path / 'r/corpus_pipeline.py')!r})
        sys.path.insert(0, {str(tmp_path / 'r')!r})
        import __spark_entry__ as e
        names = set(e.queries())
        assert 'expr_flagship' in names and not any(n.startswith('op') for n in names) and 'pipeline' not in names
        assert set(e.oracle_sql()) <= names
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert done.returncode == 0, done.stderr


def test_a_missing_dependency_is_no_absent_subpackage(monkeypatch):
    import __spark_entry__ as entry

    def lacking(name):
        raise ModuleNotFoundError("No module named 'tiktoken'", name="tiktoken")

    monkeypatch.setattr(entry, "import_module", lacking)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("factorspark.llm.queries")

    def absent(name):
        raise ModuleNotFoundError("No module named 'factorspark.llm'", name="factorspark.llm")

    monkeypatch.setattr(entry, "import_module", absent)
    assert entry._optional("factorspark.llm.queries") is None


def test_library_does_not_import_the_text_operators():
    for p in (ROOT / "factorspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
