"""Tables that are kept or ranked on the way: cut lineage, running sums, ranks and exact quantiles."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of groups that may be broadcast: one row for each group and range partition.
BROADCAST_RANGES = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; in local mode, one of our own where none is set."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not have:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(have)
        return context._jsc.sc().getCheckpointDir().get()
    return have


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, until released()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Deletes tables of kept() that nothing will read again."""
    for df in tables:
        if df is not None and (path := vars(df).pop("_kept_at", None)):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Whether Spark deletes the shuffles of a query when it has ended, and not when its plan is collected.
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files; their plans are not to be run again."""
    before = spark.conf.get(DELETE_SHUFFLES, None)
    spark.conf.set(DELETE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DELETE_SHUFFLES) if before is None else spark.conf.set(DELETE_SHUFFLES, before)


def shuffled(df: DataFrame) -> DataFrame:
    """df, for joins that may not broadcast it: a table of files is taken for as small as they are, however many rows they hold."""
    return df.hint("merge")


def once(df: DataFrame) -> DataFrame:
    """df, kept() if reading it means more than a scan of files with a projection or filter."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter") and node.children().size() == 1:
        node = node.children().apply(0)
    return df if node.nodeName() == "LogicalRelation" else kept(df)


def running(df: DataFrame, by: str, weight, out: str) -> DataFrame:
    """df with `out`: the sum of a weight over all rows up to this one in the order of a unique column.

    Range partitions are summed in parallel; only their totals, one row each, meet.
    """
    spread = df.repartitionByRange(by).withColumn("_p", F.spark_partition_id())
    local = kept(spread.withColumn(out, F.sum(weight).over(W.partitionBy("_p").orderBy(by))))
    totals = local.groupBy("_p").agg(F.max(out).alias("_n"))
    before = totals.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_p").withColumn(out, F.col(out) + F.col("_before")).drop("_p", "_before")


def ranked(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with place, a row's place from 0 in its group by a column, and n, the rows of the group.

    Rows are sorted by range partitions, so a large group lies in many of them; only
    counts meet, one for each group and partition.
    """
    sorted_ = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    placed = kept(sorted_.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_at")))
    counts = placed.groupBy(group, "_p").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(W.partitionBy(group).orderBy("_p")) - F.col("_rows")
    ranges = kept(counts.select(group, "_p", "_first", before.alias("_before"), F.sum("_rows").over(W.partitionBy(group)).alias("n")))
    few = ranges.count() <= BROADCAST_RANGES
    told = placed.join(F.broadcast(ranges) if few else ranges, [group, "_p"])
    out = kept(told.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "n"))
    released(placed, ranges)
    return out


def quantiles(df: DataFrame, column: str, places: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; None for a table without values.

    Values are counted first and the counts are summed by range, so neither a frequent
    value nor the number of distinct ones meets in one task.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("_c"))
    rows = running(counted, "v", F.col("_c"), "_upto")
    n = rows.agg(F.max("_upto")).first()[0]
    if not n:
        return [None] * len(places)
    spots = [p * (n - 1) for p in places]
    ranks = sorted({int(s) for s in spots} | {min(n - 1, int(s) + 1) for s in spots})
    found = rows.agg(*[F.min(F.when(F.col("_upto") > r, F.col("v"))) for r in ranks]).first()
    at = dict(zip(ranks, map(float, found), strict=True))
    return [at[int(s)] + (s - int(s)) * (at[min(n - 1, int(s) + 1)] - at[int(s)]) for s in spots]


def grouped_quantiles(df: DataFrame, group: str, column: str, places: dict[str, float]) -> DataFrame:
    """quantiles() of each group: the group and a column for each place, by name."""
    rows = ranked(df.where(F.col(column).isNotNull()).select(group, F.col(column).cast("double").alias("v")), group, "v")
    spot = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    low = lambda p: F.floor(spot(p))
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("v")))
    found = rows.groupBy(group).agg(F.max("n").alias("n"), *[x for c, p in places.items() for x in (at(low(p)).alias(f"{c}_a"), at(F.least(F.col("n") - 1, low(p) + 1)).alias(f"{c}_b"))])
    return found.select(group, *[(F.col(f"{c}_a") + (spot(p) - low(p)) * (F.col(f"{c}_b") - F.col(f"{c}_a"))).alias(c) for c, p in places.items()])
