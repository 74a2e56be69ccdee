"""Sketches and annotation counts that grow with folders, with Structured Streaming.

What has been seen lives in Spark's state store, by key, so a batch looks up the keys
that it holds and never reads what earlier batches wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dna import hashed, kmers, threshold
from ..operators.mapping import K_OFFSET, mapping_from_tsv

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keeps state on the executors' disks, and writes changes alone to the checkpoint.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB, whose size memory does not bound."""
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, CHANGES)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(CHANGES, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def running_sketch(spark: SparkSession, folder: str, table: str, checkpoint: str, k: int = 21, scaled: int = 1000) -> StreamingQuery:
    """A query that adds the sketch of new lines (one read each) to a Parquet table of (h).

    A hash is sampled before it is looked up, and written once, when it is first seen.  The
    files of a batch that runs again after a failure replace those of its first attempt.
    """
    lines = spark.readStream.text(folder).select(F.col("value").alias("seq"))
    found = kmers(lines, "seq", k, []).select(hashed(F.col("kmer")).alias("h")).where(F.col("h") < threshold(scaled))
    with _state_on_disk(spark):
        return found.dropDuplicates(["h"]).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_annotation(spark: SparkSession, folder: str, nodes: DataFrame, table: str, checkpoint: str, offset: int = K_OFFSET, line: Column | None = None) -> StreamingQuery:
    """A query that counts the reads of families over new lines of a mapping, tab-separated as in mapping_from_tsv().

    Each batch writes the families that it changed, with their counts so far, to a
    partition of its own, which a second attempt replaces; annotation_so_far() has the
    last counts of each.  Families that nodes (nid, length) do not have are passed over.
    """
    lines = spark.readStream.text(folder)
    hits = mapping_from_tsv(lines, F.col("value") if line is None else line).where("mapped").select("family", "hits")
    known = hits.join(nodes.select(F.col("nid").cast("string").alias("family"), "length"), "family")
    counts = known.groupBy("family").agg(F.count("*").alias("read_count"), F.sum("hits").alias("kmer_count"), F.sum((F.col("hits") + offset) / F.col("length")).alias("weight"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    with _state_on_disk(spark):
        return counts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def annotation_so_far(spark: SparkSession, table: str) -> DataFrame:
    """family, read_count, kmer_count and weight as running_annotation() last wrote them."""
    rows = spark.read.parquet(table)
    values = ["read_count", "kmer_count", "weight"]
    return rows.groupBy("family").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("family", *[f"v.{c}" for c in values])


def compacted(spark: SparkSession, table: str) -> None:
    """Replaces the partitions of running_annotation() with one; to be run between its batches.

    It takes the number of the last batch, so a batch that runs again still comes after it.
    """
    last = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    if last is None:
        return
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    whole, root = f"{table}/_compacted", jvm.org.apache.hadoop.fs.Path(table)
    annotation_so_far(spark, table).write.mode("overwrite").parquet(whole)
    fs = root.getFileSystem(conf)
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
    at = jvm.org.apache.hadoop.fs.Path(f"{table}/batch={last}")
    fs.delete(at, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(whole), at)  # until the others go, they only repeat what is older
    for path in old:
        if path.getName() != at.getName():
            fs.delete(path, True)
