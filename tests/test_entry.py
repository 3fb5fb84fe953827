"""The driver's contract."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from stratum import raw_queries  # noqa: F401
from stratum.queries import QUERIES, SQL

ROOT, SMALL = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns == ["portfolio", "date", "ret_excess_vw", "ret_excess_ew", "ret_excess_vw_capped"]


def test_queries_and_sql_have_the_same_names():
    assert set(SQL) <= set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plain(value):
    return "" if value is None or value != value else str(value).removesuffix(" 00:00:00").removesuffix(".0")


@pytest.mark.parametrize("name", ["returns_annual", "breakpoints_smooth", "lag_window_drop_na", "join_lagged", "rolling_deviation_quarter", "rolling_betas_two", "fama_macbeth_newey_west", "trace_clean", "summary_detail", "crsp_monthly_v1_raw", "crsp_daily_v1", "fisd_bonds", "ols_large_means", "rolling_betas_long", "breakpoints_whole", "french_factors", "stock_prices", "factor_library", "trace_clean_older", "crsp_monthly_older", "compustat_annual"])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    mine = sorted([plain(r[c]) for c in columns] for r in got.collect())
    assert mine == sorted([plain(v) for v in r] for r in want.fetchall())


def test_all_but_the_text_operators_work_without_them(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL)), "[]"]


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "stratum").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text())
