"""The four-node toy graph and its coverages."""

import pytest
from helixlake.operators import graph as G
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def toy(spark):
    nodes = spark.createDataFrame([("n0", "P", 2.0), ("n1", "P", 0.0), ("n2", "S", 1.0), ("n3", "C", 0.0)], "nid string, partition string, weight double")
    presence = spark.createDataFrame([("n0", "A"), ("n1", "A"), ("n1", "B"), ("n2", "B"), ("n3", "B")], "nid string, strain string")
    edges = spark.createDataFrame([("n0", "n1"), ("n1", "n2"), ("n2", "n3")], "src string, dst string")
    return nodes, presence, edges


def test_filters_and_subgraph(toy):
    nodes, _, edges = toy
    assert [nodes.where(F.col("partition") == p).count() for p in "PSC"] == [2, 1, 1]
    kept, within = G.subgraph(nodes, edges, F.col("partition") != "C")
    assert kept.count() == 3 and {tuple(r) for r in within.collect()} == {("n0", "n1"), ("n1", "n2")}


def test_partition_coverage_divides_by_all_nodes(toy, spark):
    nodes, *_ = toy
    row = G.partition_coverage(nodes).first()
    assert (row["P_coverage"], row["S_coverage"], row["C_coverage"]) == (0.25, 0.25, 0.0)
    assert row["P_fraction"] == 0.5
    more = G.set_values(nodes, "weight", spark.createDataFrame([("n3", 5.0)], "nid string, value double"))
    assert G.partition_coverage(more).first()["C_coverage"] == 0.25
    added = G.set_values(nodes, "weight", spark.createDataFrame([("n1", 3.0)], "nid string, value double"), add=True)
    assert G.partition_coverage(added).first()["P_coverage"] == 0.5
    assert G.partition_coverage(nodes.where("false")).first()["P_coverage"] == 0.0


def test_per_strain_measures(toy):
    nodes, presence, _ = toy
    got = {(r["strain"], r["class"]): r["coverage"] for r in G.coverage_per_strain(nodes, presence).collect()}
    assert got["A", "all"] == 0.5 and got["B", "all"] == 0.3333 and got["B", "SC"] == 0.5 and ("A", "S") not in got
    row = {r["strain"]: r for r in G.genome_coverage(nodes, presence).collect()}
    assert row["A"]["nb_P"] == 2 and row["A"]["cov_P"] == 1 and row["A"]["r_S"] is None
    assert {r["strain"]: r["sum"] for r in G.nodes_per_strain(nodes, presence).collect()} == {"A": 2, "B": 3}
    assert G.persistent_mean(nodes).first()[0] == 1.0
    assert [r["nid"] for r in G.specific_nodes(nodes, presence, "B", ["A"]).orderBy("nid").collect()] == ["n2", "n3"]


def test_adjacency_and_components(spark):
    genes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (1, 4, "a"), (2, 1, "c")], "contig int, pos int, fam string")
    assert [tuple(r) for r in G.adjacency(genes, "contig", "fam", ["pos"]).collect()] == [("a", "b")]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r["node"]: r["component"] for r in G.connected(pairs, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
