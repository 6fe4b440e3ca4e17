"""Workers that have no copy of the package: task-side functions travel by value."""

import os
import subprocess
import sys
from pathlib import Path

JOB = """
import sys
sys.path.append({repo!r})
from pyspark.sql import functions as F
from tessera.core import session
from tessera.operators import components, difftest
spark = session("workers", "2", **{{"spark.sql.shuffle.partitions": "2"}})
rows = [("a", "x", f"i{{i}}", f"g{{i % 3}}", float(i * i % 7)) for i in range(30)]
long = spark.createDataFrame(rows, "phenotype string, feature string, image string, level string, value double").withColumn("channel", F.lit("c"))
r = difftest.differential(long, ["channel"]).first()
assert r["test"] == "kruskal" and 0 < r["p_value"] <= 1, r
px = spark.range(64).select(F.lit(0).alias("image"), F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), (F.col("id") % 5).cast("double").alias("q"))
got = components.label(px.where("q > 1"), ["image"]).agg(F.countDistinct("label")).first()[0]
assert got >= 1
print("DONE")
"""


def test_functions_reach_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    job = tmp_path / "job.py"
    job.write_text(JOB.format(repo=str(Path(__file__).resolve().parents[1])))
    out = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "DONE" in out.stdout, out.stderr[-3000:]
