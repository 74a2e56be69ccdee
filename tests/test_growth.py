"""Tables that grow with families and strains are shuffled to others, and strains far from a sample do not change its profile."""

import glob
import os
import random

import pytest
from helixlake.operators import mapping as R
from helixlake.operators import mixture as M
from helixlake.operators import solve as S
from helixlake.plans import profile as P
from helixlake.plans import testmap as T
from pyspark.sql import functions as F

from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_not_broadcast(spark):
    """A small file may hold millions of parts."""
    assert "Broadcast" not in plan(T.bare_nodes(spark, SMALL))


def test_strains_are_not_broadcast(spark):
    """Strains and their groups are joined to presence by a shuffle, however small their files are."""
    presence = spark.createDataFrame([(f, s) for s in range(6) for f in range(3 * s, 3 * s + 9)], "fam long, strain long")
    grouped, members = M.collapse(presence)
    assert "BroadcastHashJoin" not in plan(grouped) and "SortMergeJoin" in plan(grouped)
    assert members.count() == 6


def far_away(spark, n):
    """Three planted strains with five families each, and n families without depth of strains that no read has met."""
    planted = [(10 * s + i, s) for s in (1, 2, 3) for i in range(5)]
    far = spark.range(n).select((F.col("id") + 1000).alias("fam"), (F.col("id") % 40 + 100).alias("strain"))
    depth = spark.createDataFrame([(f, {1: 5.0, 2: 3.0, 3: 1.0}[s]) for f, s in planted], "fam long, y double")
    presence = spark.createDataFrame(planted, "fam long, strain long").unionByName(far)
    return presence, depth.unionByName(far.select("fam", F.lit(0.0).alias("y")))


def test_far_strains_do_not_stop_the_selection(spark):
    presence, depth = far_away(spark, 40_000)
    found, _ = P.select(presence, depth, {})
    assert dict(zip(found.labels, found.x.round(6).tolist(), strict=True)) == {1: 5.0, 2: 3.0, 3: 1.0}


def test_unmoved_error_is_that_of_families_out_of_reach(spark):
    presence, depth = far_away(spark, 60)
    presence = presence.unionByName(spark.createDataFrame([(11, 100), (7, 1)], "fam long, strain long"))  # strain 100 has a covered family now; 7 is near
    depth = depth.unionByName(spark.createDataFrame([(7, 0.0), (8, 0.0)], "fam long, y double"))  # 8 has no strain
    assert {r["fam"] for r in M.out_of_reach(presence, depth).collect()} == {1000 + i for i in range(60) if i % 40}
    folds = depth.withColumn("fold", F.col("fam") % 2)
    got = {r["fold"]: r["unmoved"] for r in M.unmoved_error(presence, folds, 0.03).collect()}
    fams = [r["fam"] for r in depth.collect()]
    want = {f: 0.06 * sum(x >= 1000 and x % 40 != 0 and x % 2 == f for x in fams) / sum(x % 2 == f for x in fams) for f in (0, 1)}
    assert {f: round(x, 9) for f, x in got.items()} == {f: round(x, 9) for f, x in want.items()}


def test_gain_is_relative_to_what_may_be_lowered():
    errors = [[10.2, 10.2], [10.1, 10.1]]
    assert S.stop_paired(errors, 0.02) == 0
    assert S.stop_paired(errors, 0.02, 10.0) == 1


@pytest.mark.parametrize("k", [21, 33])
def test_labels_by_turns(spark, monkeypatch, k):
    """Each k-mer has one turn, whose shuffle is deleted; the spans are those of all k-mers at once."""
    rng = random.Random(9)
    core = "".join(rng.choice("ACGT") for _ in range(900))
    rows = [("abc"[i % 3], core[60 * i :] + "".join(rng.choice("ACGTN") for _ in range(200))) for i in range(8)] + [("d", None)]
    df = spark.createDataFrame(rows, "label string, seq string").repartition(3)
    whole = {}
    for r in R.kmer_labels(df, "seq", "label", k).collect():
        whole.setdefault(r["label"], []).append(r["h"])
    want = sorted((x, len(h), min(h), max(h)) for x, h in whole.items())
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in folder if os.path.isdir(d))
    turns, step = [], R.distinct_kmers
    monkeypatch.setattr(R, "distinct_kmers", lambda *a: turns.append(a[-2:]) or step(*a))
    monkeypatch.setattr(R, "LETTERS_A_TURN", 1000)
    before = files()
    got = R.label_spans(df, "seq", "label", k, 6500)
    assert turns == ([(i, 7) for i in range(7)] if k <= 31 else [])
    assert files() <= before
    assert sorted(map(tuple, got.collect())) == want
