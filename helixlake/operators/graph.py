"""Gene-family graphs: nodes, presence of strains, edges, and coverage of partitions and strains.

nodes: nid, partition (P, S or C), weight, length, ...; presence: nid, strain;
edges: src, dst with src < dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import kept, released

PARTITIONS = ("P", "S", "C")


def family_nodes(families: DataFrame) -> DataFrame:
    """nid, partition and length of gene families (family, partition, protein): a protein stands for three bases a letter."""
    return families.select(F.col("family").alias("nid"), F.upper(F.substring("partition", 1, 1)).alias("partition"), (F.length("protein") * 3).alias("length"))


def load_graph(nodes: DataFrame, edges: DataFrame, presence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables as a graph: node ids once each, edges in canonical order between known nodes, presence of known nodes.

    Nodes without a weight have none yet: weight, read_count and kmer_count are 0.
    """
    zero = {"weight": F.lit(0.0), "read_count": F.lit(0).cast("bigint"), "kmer_count": F.lit(0).cast("bigint")}
    known = nodes.dropDuplicates(["nid"]).withColumns({c: F.coalesce(c, v) if c in nodes.columns else v for c, v in zero.items()})
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    return known, subgraph(known, ends, F.lit(True))[1], presence.select("nid", "strain").distinct().join(known.select("nid"), "nid", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that meet a predicate and the edges with both ends among them."""
    kept = nodes.where(keep)
    ids = kept.select("nid")
    within = edges.join(ids.withColumnRenamed("nid", "src"), "src", "left_semi").join(ids.withColumnRenamed("nid", "dst"), "dst", "left_semi")
    return kept, within.select("src", "dst")


def set_values(nodes: DataFrame, column: str, changes: DataFrame, add: bool = False) -> DataFrame:
    """nodes with new values (nid, value) of a column, or with the values added."""
    delta = changes.select("nid", F.col("value").alias("_v"))
    old = F.col(column)
    new = old + F.coalesce("_v", F.lit(0)) if add else F.coalesce("_v", old)
    return nodes.join(delta, "nid", "left").withColumn(column, new).drop("_v")


def adjacency(genes: DataFrame, contig: str, family: str, order: list[str]) -> DataFrame:
    """Edges between families of neighbouring genes, in canonical order, once each."""
    following = F.lead(family).over(W.partitionBy(contig).orderBy(*order))
    pairs = genes.select(F.col(family).alias("a"), following.alias("b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(nid, other) in both directions."""
    return edges.select(F.col("src").alias("nid"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("nid"), F.col("src").alias("other")))


def partition_coverage(nodes: DataFrame) -> DataFrame:
    """Covered nodes of each partition as a share of all nodes, and of the partition's own nodes."""
    rows = []
    for p in PARTITIONS:
        hit = F.count_if((F.col("partition") == p) & (F.col("weight") > 0))
        rows += [F.coalesce(hit / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias(f"{p}_coverage"), (hit / F.nullif(F.count_if(F.col("partition") == p), F.lit(0))).alias(f"{p}_fraction")]
    return nodes.agg(*rows)


def per_strain(nodes: DataFrame, presence: DataFrame, measure: Column, name: str, digits: int = 4) -> DataFrame:
    """strain, class and the rounded mean of a measure, for the classes all, P, S, C and SC (not P).

    One pass: each row stands for all classes that its node belongs to.
    """
    part = F.col("partition")
    classes = F.array_compact(F.array(F.lit("all"), part, F.when(part != "P", F.lit("SC"))))
    rows = presence.join(nodes, "nid").select("strain", F.explode(classes).alias("class"), measure.cast("double").alias("_m"))
    return rows.groupBy("strain", "class").agg(F.round(F.avg("_m"), digits).alias(name))


def coverage_per_strain(nodes: DataFrame, presence: DataFrame) -> DataFrame:
    return per_strain(nodes, presence, (F.col("weight") > 0).cast("int"), "coverage")


def genome_coverage(nodes: DataFrame, presence: DataFrame) -> DataFrame:
    """Nodes and covered nodes of each strain by partition, with ratios; null where a partition is absent."""
    rows = presence.join(nodes, "nid")
    n = {p: F.count_if(F.col("partition") == p) for p in PARTITIONS}
    c = {p: F.count_if((F.col("partition") == p) & (F.col("weight") > 0)) for p in PARTITIONS}
    counts = rows.groupBy("strain").agg(*[n[p].alias(f"nb_{p}") for p in PARTITIONS], *[c[p].alias(f"cov_{p}") for p in PARTITIONS])
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    total = lambda kind: sum((F.col(f"{kind}_{p}") for p in PARTITIONS[1:]), F.col(f"{kind}_P"))
    return counts.withColumns({f"r_{p}": ratio(F.col(f"cov_{p}"), F.col(f"nb_{p}")) for p in PARTITIONS} | {"r": ratio(total("cov"), total("nb"))})


def nodes_per_strain(nodes: DataFrame, presence: DataFrame) -> DataFrame:
    rows = presence.join(nodes.select("nid", "partition"), "nid").groupBy("strain")
    return rows.agg(*[F.count_if(F.col("partition") == p).alias(p) for p in PARTITIONS], F.count("*").alias("sum"))


def persistent_mean(nodes: DataFrame) -> DataFrame:
    return nodes.where("partition = 'P'").agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("mean_weight"))


def specific_nodes(nodes: DataFrame, presence: DataFrame, strain, avoid: list) -> DataFrame:
    """Nodes that a strain has and none of the strains to avoid."""
    own = presence.where(F.col("strain") == strain).select("nid")
    others = presence.where(F.col("strain").isin(avoid)).select("nid")
    return nodes.join(own, "nid", "left_semi").join(others, "nid", "left_anti")


def connected(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reached over pairs (a, b).

    Each node has a parent, itself at first.  In a round a node hears of the grandparents
    of its neighbours; it, and its parent, take the least that is known, and its own
    grandparent becomes its parent.  So paths shorten by doubling, and the number of
    rounds follows the logarithm of the longest path.
    """
    both = kept(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = kept(nodes.select("node", F.col("node").alias("up")))
    while True:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("top"))
        grown = state.join(above, "up").select("node", "up", "top")
        heard = both.join(grown.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("low"))
        told = kept(grown.join(heard, "node", "left").select("node", "up", F.least("top", "low").alias("low")))
        hooks = told.groupBy(F.col("up").alias("node")).agg(F.min("low").alias("hook"))
        new = kept(told.join(hooks, "node", "left").select("node", "up", F.least("up", "low", "hook").alias("new")))
        changed = new.where("new < up").limit(1).count()
        released(state, told)
        if not changed:
            released(both)
            return new.select("node", F.col("up").alias("component"))
        state = kept(new.select("node", F.col("new").alias("up")))
        released(new)
