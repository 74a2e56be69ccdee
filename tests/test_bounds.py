"""Weights and fences that meet a bound exactly, whatever the order of rows."""

import random

import pytest
from helixlake.operators import assign as A
from helixlake.operators import mapping as R
from helixlake.operators import mixture as M
from pyspark.sql import functions as F


def test_weights_are_one_quotient(spark):
    rng = random.Random(2)
    nodes = [(i, 30 * rng.randint(1, 50)) for i in range(300)]
    hits = [(i, rng.randint(1, 50)) for i, _ in nodes for _ in range(12)]
    mapping, graph = spark.createDataFrame(hits, "family long, hits long"), spark.createDataFrame(nodes, "nid long, length long")
    total = {i: sum(h + 21 for f, h in hits if f == i) for i, _ in nodes}
    for rows in (mapping, mapping.orderBy(F.desc("hits"))):
        assert {r["nid"]: r["weight"] for r in R.annotate(rows, graph).collect()} == {i: total[i] / length for i, length in nodes}


def test_family_at_the_reassignment_bound(spark):
    """A weight of one half, from reads whose quotients do not sum to it in any order, is at the bound and not beyond."""
    length = 270
    mapping = spark.createDataFrame([(9, h) for h in (18, 7, 47)], "family long, hits long")
    nodes = R.annotate(mapping, spark.createDataFrame([(9, length), (1, 30)], "nid long, length long"))
    assert nodes.where("nid = 9").first()["weight"] == 0.5
    carried, abundance = spark.createDataFrame([(1, 3)], "nid long, component long"), spark.createDataFrame([(3, 1.0)], "component long, a double")
    edges = spark.createDataFrame([(1, 9)], "src long, dst long")
    assert [tuple(r) for r in A.reassigned(nodes, edges, carried, abundance).collect()] == [(3, 9, 0.5, "reassigned")]


@pytest.mark.parametrize("more, stays", [(0.9, True), (0.900001, False)])
def test_depth_at_the_fence(spark, more, stays):
    """0.3 + 3 * (0.3 - 0.1) is less than 0.9 as it is rounded."""
    rows = [(i, y) for i, y in enumerate([0.1, 0.1, 0.1, 0.2, 0.2, 0.2, 0.3, 0.3, more, 0.0])]
    depth = spark.createDataFrame(rows, "fam long, y double")
    want = sorted(r for r in rows if stays or r[1] != more)
    assert sorted(map(tuple, M.fence(depth).collect())) == want
    grouped = M.grouped_fence(depth.withColumn("g", F.lit("a")), "g")
    assert sorted((r["fam"], r["y"]) for r in grouped.collect()) == want
