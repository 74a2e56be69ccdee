"""Stages are made again if and only if what they are made of changes, in any session."""

import os
import subprocess
import sys

import pytest
from helixlake.plans.stages import Stages, content, file_states, fingerprint
from pyspark.sql import functions as F

OTHER = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from helixlake.plans.stages import Stages
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
reads = spark.read.parquet(sys.argv[1])
rows = spark.createDataFrame([(2, {"k": 1.5}), (1, None)], "a int, m map<string, double>")
stage = Stages(spark, sys.argv[2])
made = []
one = stage("one", lambda: (made.append("one"), reads.where("v > 1"))[1], (reads.where("v > 1").withColumn("w", F.col("v") + 1), rows, 21, "x"))
two = stage("two", lambda: (made.append("two"), one.select("v"))[1], (one,))
print("MADE", ",".join(made), two.count())
"""


def run_stages(spark, data, folder, rows, setting=21):
    reads, made = spark.read.parquet(data), []
    stage = Stages(spark, folder)
    one = stage("one", lambda: (made.append("one"), reads.where("v > 1"))[1], (reads.where("v > 1").withColumn("w", F.col("v") + 1), rows, setting, "x"))
    two = stage("two", lambda: (made.append("two"), one.select("v"))[1], (one,))
    return made, sorted(r["v"] for r in two.collect())


def test_changed_inputs_are_made_again(spark, tmp_path):
    data, folder = str(tmp_path / "reads"), str(tmp_path / "run")
    rows = spark.createDataFrame([(1, None), (2, {"k": 1.5})], "a int, m map<string, double>")
    spark.range(5).select(F.col("id").alias("v")).coalesce(1).write.parquet(data)
    assert run_stages(spark, data, folder, rows) == (["one", "two"], [2, 3, 4])
    assert run_stages(spark, data, folder, rows.repartition(3)) == ([], [2, 3, 4])
    assert run_stages(spark, data, folder, rows, 31) == (["one", "two"], [2, 3, 4])
    assert run_stages(spark, data, folder, rows.where("a = 1"))[0] == ["one", "two"]
    spark.range(7).select(F.col("id").alias("v")).coalesce(1).write.mode("overwrite").parquet(data)  # at the same path
    assert run_stages(spark, data, folder, rows) == (["one", "two"], [2, 3, 4, 5, 6])
    assert run_stages(spark, data, folder, rows) == ([], [2, 3, 4, 5, 6])
    spark.range(7, 9).select(F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(data)
    assert run_stages(spark, data, folder, rows)[1] == [2, 3, 4, 5, 6, 7, 8]
    names = [p.name for p in (tmp_path / "run").iterdir()]
    assert not any(n.startswith(".making") for n in names) and sum(n.startswith("one-") for n in names) == 5
    assert all((p / "manifest.json").exists() for p in (tmp_path / "run").iterdir())


def test_another_session_reads_what_is_there(spark, tmp_path):
    data, folder = str(tmp_path / "reads"), str(tmp_path / "run")
    spark.range(5).select(F.col("id").alias("v")).coalesce(1).write.parquet(data)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    rows = spark.createDataFrame([(1, None), (2, {"k": 1.5})], "a int, m map<string, double>")
    assert run_stages(spark, data, folder, rows)[0] == ["one", "two"]
    got = subprocess.run([sys.executable, "-c", OTHER, data, folder], env=env, capture_output=True, text=True, timeout=300)
    assert "MADE  3" in got.stdout, got.stdout + got.stderr[-2000:]
    spark.range(6).select(F.col("id").alias("v")).coalesce(1).write.mode("overwrite").parquet(data)
    got = subprocess.run([sys.executable, "-c", OTHER, data, folder], env=env, capture_output=True, text=True, timeout=300)
    assert "MADE one,two 4" in got.stdout, got.stdout + got.stderr[-2000:]
    assert run_stages(spark, data, folder, rows) == ([], [2, 3, 4, 5])


def test_a_failed_stage_leaves_nothing(spark, tmp_path):
    stage = Stages(spark, str(tmp_path / "run"))
    with pytest.raises(Exception, match="broken"):
        stage("one", lambda: spark.range(3).select(F.raise_error(F.lit("broken")).alias("x").cast("string")))
    assert stage("one", lambda: spark.range(3)).count() == 3
    assert stage("one", lambda: 1 / 0).count() == 3


def test_fingerprints(spark, tmp_path):
    """Plans over files by their text and files; rows and Python functions by content."""
    spark.range(10).write.parquet(str(tmp_path / "a"))
    spark.range(10).write.parquet(str(tmp_path / "b"))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert fingerprint(read("a")) == fingerprint(read("a")) != fingerprint(read("b"))
    assert fingerprint(read("a").where("id > 1")) != fingerprint(read("a").where("id > 2"))
    assert fingerprint(read("a").select(F.col("id").alias("x"))) != fingerprint(read("a"))
    plus = lambda n: F.udf(lambda x: x + n, "long")
    same = [fingerprint(read(n).select(plus(1)("id").alias("y"))) for n in "ab"]
    assert same[0] == same[1] != fingerprint(read("a").select(plus(2)("id").alias("y")))
    assert content(spark.range(4).repartition(3)) == content(spark.range(4)) != content(spark.range(5))
    assert content(spark.createDataFrame([(1,), (1,)], "a int")) != content(spark.createDataFrame([(1,)], "a int"))
    assert [s[1] > 0 for s in file_states(spark, read("a").inputFiles())]
