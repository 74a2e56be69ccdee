"""A planted two-strain profile end to end, collapse, fence and reconciliation."""

import json
import tomllib

import numpy as np
from helixlake.operators import assign as A
from helixlake.operators import mixture as M
from helixlake.operators.tables import quantiles
from helixlake.plans import profile as P


def graph(spark):
    rows, presence = [], []
    for i in range(10):
        rows.append((f"a{i}", "S", 4.0)); presence.append((f"a{i}", "A"))  # noqa: E702
        rows.append((f"b{i}", "S", 6.0)); presence.append((f"b{i}", "B"))  # noqa: E702
        rows.append((f"k{i}", "P", 10.0)); presence += [(f"k{i}", s) for s in "ABC"]  # noqa: E702
    for i in range(5):
        rows.append((f"c{i}", "C", 0.0)); presence.append((f"c{i}", "C"))  # noqa: E702
    nodes = spark.createDataFrame(rows, "nid string, partition string, weight double")
    return nodes, spark.createDataFrame([], "src string, dst string"), spark.createDataFrame(presence, "nid string, strain string")


def test_two_strains(spark, tmp_path):
    found = P.profile(*graph(spark))
    ra = dict(zip(found.selection.labels, found.selection.ra, strict=True))
    assert set(ra) == {"A", "B"} and abs(sum(ra.values()) - 1) < 1e-9 and ra["B"] > ra["A"]
    assert {r["status"] for r in found.genes.collect()} <= {"observed", "reassigned", "imputed"}
    P.write_profile(found, str(tmp_path / "out"), "s__Foo")
    data = json.loads((tmp_path / "out/profile.json").read_text())
    assert data["k"] == 2 and {c["anchor"] for c in data["components"]} == {"A", "B"}
    page = (tmp_path / "out/report.html").read_text()
    assert page.count("<table>") == 2 and "2 strains" in page and "kept" in page
    told = tomllib.loads((tmp_path / "out/run.toml").read_text())
    assert told["species"] == "s__Foo" and told["profile"]["k_max"] == 12
    lines = (tmp_path / "out/selection.tsv").read_text().splitlines()
    assert len(lines) == 1 + len(found.selection.steps) and lines[-1].endswith("cv_paired")


def test_leave_one_out_and_own_steps(spark):
    """A strain that is held out leaves its private families to the others; selector and assigner may be replaced."""
    held = P.profile(*graph(spark), exclude=["B"])
    assert "B" not in held.selection.labels and "A" in held.selection.labels
    mine = {r["family"] for r in held.genes.where("status = 'reassigned'").collect()}
    assert mine <= {f"b{i}" for i in range(10)}
    seen = []

    def chooser(presence, depth, priority, options):
        seen.append(priority)
        return P.select(presence.where("strain = 'A'"), depth, priority, options)

    def assigner(nodes, edges, presence, members, abundance, least, most):
        return A.observed(nodes, A.carriers(presence, members), abundance)

    own = P.profile(*graph(spark), selector=chooser, assigner=assigner)
    assert own.selection.labels == ["A"] and seen == [{"A": 10, "B": 10, "C": 0}]
    assert {r["status"] for r in own.genes.collect()} == {"observed"}


def test_nothing_mapped(spark):
    nodes, edges, presence = graph(spark)
    found = P.profile(nodes.selectExpr("nid", "partition", "0.0D as weight"), edges, presence)
    assert found.selection.labels == [] and found.genes is None


def test_collapse(spark):
    like = spark.createDataFrame([(f, s) for f in range(3) for s in "AB"] + [(9, "C")], "fam int, strain string")
    grouped, members = M.collapse(like)
    assert {r["strain"]: r["component"] for r in members.collect()} == {"A": "A", "B": "A", "C": "C"}
    assert grouped.count() == 4


def test_fence_and_folds(spark):
    depth = spark.createDataFrame([(i, float(1 + i % 3)) for i in range(40)] + [(98, 1000.0), (99, 0.0)], "fam int, y double")
    kept = {r["fam"] for r in M.fence(depth).collect()}
    assert 98 not in kept and 99 in kept and len(kept) == 41
    folds = M.seeded_folds(M.ordered(M.fence(depth))).orderBy("fam_ord").toPandas()
    want = np.random.default_rng(0).integers(0, 5, size=41).tolist()
    assert folds["fam"].is_monotonic_increasing and folds["fold"].tolist() == want
    for block in (1, 7, 41):
        assert M.seeded_folds(M.ordered(M.fence(depth)), block=block).orderBy("fam_ord").toPandas()["fold"].tolist() == want


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 4, 301) / 2, rng.normal(size=64), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "y double").repartition(3)
        assert np.allclose(quantiles(df, "y", [0.0, 0.25, 0.5, 0.9, 1.0]), np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert quantiles(df.where("false"), "y", [0.5]) == [None]


def test_gram_is_the_sum_of_its_folds(spark):
    presence = spark.createDataFrame([(f, s) for f in range(20) for s in range(4) if (f * 7 + s * 3) % 5 < 3], "fam int, strain int")
    folds = spark.createDataFrame([(f, f % 3, float(f)) for f in range(20)], "fam int, fold int, y double")
    total = {(r["s"], r["t"]): r["g"] for r in M.gram(presence).collect()}
    parts: dict = {}
    for r in M.fold_moments(presence, folds).collect():
        parts[r["s"], r["t"]] = parts.get((r["s"], r["t"]), 0) + r["g"]
    assert parts == total


def test_orphans_go_to_the_best_subset(spark):
    nodes = spark.createDataFrame([("o", 8.1), ("far", 100.0), ("x", 5.0)], "nid string, weight double")
    presence = spark.createDataFrame([("x", "A"), ("o", "Z"), ("far", "Z")], "nid string, strain string")
    members = spark.createDataFrame([(s, s) for s in "ABC"], "strain string, component string")
    amount = spark.createDataFrame([("A", 5.0), ("B", 3.0), ("C", 1.0)], "component string, a double")
    edges = spark.createDataFrame([("o", "x")], "src string, dst string")
    got = {(r["component"], r["family"]): round(r["abundance"], 4) for r in A.assign(nodes, edges, presence, members, amount).where("status = 'reassigned'").collect()}
    assert got == {("A", "o"): 5.0625, ("B", "o"): 3.0375}
