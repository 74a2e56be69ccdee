"""Tables stored in buckets by a key, which join on that key without being shuffled again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from .profile import put_text


def _name(path: str) -> str:
    return f"stored_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = 64, dealt: bool = False) -> DataFrame:
    """df as Parquet files, one for each bucket of the key and sorted by it; returns the stored table.

    The rows are shuffled here, once, as all later joins would ask for; not if they are
    dealt over as many partitions by the key already.  How the table lies is written beside it, so that any session can open it.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    (df if dealt else df.repartition(buckets, key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path))
    columns = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    put_text(spark, f"{path}_layout/layout.json", json.dumps({"key": key, "buckets": buckets, "columns": columns}))
    return spark.table(_name(path))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_buckets() stored at a path, known to this session from now on."""
    how = spark.read.json(f"{path}_layout").first()
    escaped = path.replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")  # the files stay: only what the session knows of them goes
    spark.sql(f"CREATE TABLE {_name(path)} ({how['columns']}) USING parquet CLUSTERED BY ({how['key']}) SORTED BY ({how['key']}) INTO {how['buckets']} BUCKETS LOCATION '{escaped}'")
    return spark.table(_name(path))
