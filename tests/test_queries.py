"""Every registered query of the library against its SQL, and rules that all of them keep."""

import re

import pytest
from compare import DATA, of_duckdb, of_spark

import __spark_entry__
from kilnwork.queries import registry

WITHOUT_SQL = {"a22_distinct_counts_approx", "c1_chunk"}


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert of_spark(df) == of_duckdb(registry.ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert name in WITHOUT_SQL
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "build_id" in df.columns


def test_registry_is_complete():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_python_runs_only_where_it_must(spark):
    python = {"w10_log_violations", "c1_chunk", "c1_chunk_totals", "c12_reassemble", "s7_archive_logs", "t6_node_states", "t6_node_states_resumed", "t7_build_states", "t9_live_ema", "t10_rate_limit"}
    for name in [n for n in registry.QUERIES if not n.startswith("g")]:
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert bool(re.search("Python|Pandas|Arrow", plan)) == (name in python), name


def test_entry_needs_no_session_to_import():
    """Queries can be listed before a session exists."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=repo, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
