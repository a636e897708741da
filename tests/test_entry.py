"""The driver contract in __spark_entry__.py."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_runs_with_stable_schema(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0
    assert {"series", "week_ending", "price", "coverage", "price_lag1"} <= set(a.columns)


def test_oracle_keys_are_queries_and_documented():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    for name, fn in q.items():
        assert callable(fn) and (fn.__doc__ or "").strip(), name
    for name, sql in o.items():
        assert sql.lstrip().upper().startswith(("SELECT", "WITH")), name


def test_no_duplicate_output_columns(spark):
    from furrow.plans.registry import all_queries
    for name, q in all_queries().items():
        cols = [c for c, _ in q.columns]
        assert len(cols) == len(set(cols)), name


def test_entry_loaded_by_path_elsewhere_reaches_python_workers(tmp_path):
    """A fresh interpreter in an empty folder; the query runs Python on the workers."""
    import subprocess
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('entry_by_path', {os.path.abspath(E.__file__)!r})\n"
        "m = importlib.util.module_from_spec(spec)\n"
        "spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')\n"
        "         .config('spark.sql.shuffle.partitions', '4').getOrCreate())\n"
        f"print('ROWS', m.queries()['ols1_backtest'](spark, {E.SMOKE_DIR!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in said.stdout, said.stderr[-2000:]


def test_entry_works_without_the_document_operators(tmp_path):
    """A copy of the repository without corpus_pipeline.py and the llm folders."""
    import shutil
    import subprocess
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "furrow"), tmp_path / "furrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(E.__file__, tmp_path)
    code = ("import __spark_entry__ as E, json\n"
            "print(json.dumps([sorted(E.queries()), sorted(E.oracle_sql())]))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    import json
    queries, oracles = json.loads(said.stdout.strip().splitlines()[-1])
    from furrow.plans.registry import oracle_queries, spark_queries
    assert queries == sorted(spark_queries()) and oracles == sorted(oracle_queries())
