"""The whole build in a session with Spark's defaults, without this package's settings."""

import subprocess
import sys
import textwrap
from pathlib import Path


def test_build_in_a_default_session(tmp_path):
    code = f"""
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", {str(tmp_path)!r})
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
        import __spark_entry__ as contract
        for name in ("cluster_report", "find_similar", "best_label_match"):
            rows = contract.queries()[name](spark, "/root/testdata/sf0.001").collect()
            assert rows, name
    """
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(code)], cwd=root, capture_output=True, text=True, timeout=600
    )
    assert done.returncode == 0, done.stderr[-3000:]
