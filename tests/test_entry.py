from __future__ import annotations

import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "id", "rank", "score", "lang", "n_chars"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_of_the_library_does_not_need_the_llm_folders(tmp_path):
    """A copy of the repository without both folders still gives all other queries and their SQL."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=tmp_path, env=env).stdout.split()
    assert int(out[0]) > 200 and int(out[1]) > 190 and out[2] == "False"


def test_modules_import():
    for name in ("operators.chunking", "operators.stats", "sources.files", "streaming.events"):
        importlib.import_module(f"sparkloom.{name}")
