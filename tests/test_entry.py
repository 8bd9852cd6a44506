"""The entry works without the corpus folders."""

import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as entry
names = entry.queries()
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.entry(spark).count() > 0
"""


def test_entry_without_the_corpus_folders(tmp_path):
    for keep_pipeline in (True, False):
        top = tmp_path / str(keep_pipeline)
        shutil.copytree(TOP / "codegraph", top / "codegraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copytree(TOP / "jobs", top / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
        shutil.copy(TOP / "__spark_entry__.py", top)
        if keep_pipeline and (TOP / "corpus_pipeline.py").exists():
            shutil.copy(TOP / "corpus_pipeline.py", top)
        code = CODE if keep_pipeline else CODE.split("from pyspark")[0]
        done = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYTHONPATH": str(top)})
        assert done.returncode == 0, done.stderr[-3000:]
