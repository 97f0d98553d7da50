"""Batch functions must run where the package is not importable."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("autocovariance", "nodal_planes", "ellipsoid_distance", "toeplitz_chi2", "dense_block_chi2", "theory_covariance", "spectrogram",
             "kernel_density_grid", "nearest_statistics_posterior", "score_vector", "least_squares_linear", "least_squares_iterative", "perturbed_layers_smooth"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_queries_run_from_another_folder_with_a_plain_session(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
