"""Sequence dumps of gene families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_family(genes: DataFrame, gene: str, family: str, order: str) -> DataFrame:
    """One family for each gene: the last by `order` where a gene has several."""
    return genes.groupBy(gene).agg(F.max_by(family, order).alias(family))


def family_records(sequences: DataFrame) -> DataFrame:
    """One FASTA record for each distinct sequence of a family."""
    rows = sequences.select("family", "sequence").distinct()
    return rows.select(F.concat(F.lit(">"), F.col("family").cast("string"), F.lit("\n"), F.col("sequence")).alias("record"))


def genes_of_partition(genes: DataFrame, nodes: DataFrame, partition: str) -> DataFrame:
    own = nodes.where(F.col("partition").startswith(partition)).select(F.col("nid").alias("family"))
    return genes.join(own, "family", "left_semi")


def representatives(genes: DataFrame, nodes: DataFrame, partition: str) -> DataFrame:
    """The first gene of each family of a partition."""
    return genes_of_partition(genes, nodes, partition).groupBy("family").agg(F.min("gene").alias("gene"))


def write_fasta(records: DataFrame, path: str, compress: bool = False, split: str | None = None) -> None:
    """Records as text; with `split`, a folder for each value of that column."""
    out = records.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    (out.partitionBy(split) if split else out).text(path)
