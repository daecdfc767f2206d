"""The package runs where it is neither installed nor in the working folder."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_with_python_workers_run_from_another_folder(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import __spark_entry__
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r} + "/shared").getOrCreate()
        print("ROWS", __spark_entry__.queries()["optimize_all"](spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 60" in done.stdout, done.stderr[-2000:]
