"""Parts that no registered query exercises: loading graphs, dumps of the gather, folders of banks, profiles of other options, plans of fetching."""

import pytest
from helixlake.operators import graph as G
from helixlake.operators import mapping as R
from helixlake.plans import profile as P
from helixlake.plans import run
from helixlake.sources import catalog, discover
from pyspark.sql import functions as F


def test_families_become_nodes(spark):
    fams = spark.createDataFrame([("f1", "persistent", "MKV"), ("f2", "shell", ""), ("f3", "Cloud", "M" * 50)], "family string, partition string, protein string")
    assert sorted(map(tuple, G.family_nodes(fams).collect())) == [("f1", "P", 9), ("f2", "S", 0), ("f3", "C", 150)]


def test_a_stored_graph_is_loaded(spark):
    nodes = spark.createDataFrame([("a", "P", 3, 2.5), ("a", "P", 3, 2.5), ("b", "S", 4, None), ("c", "C", 5, 0.0)], "nid string, partition string, length int, weight double")
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("c", "x"), ("b", "c")], "src string, dst string")
    presence = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("x", "s1"), ("c", "s2")], "nid string, strain string")
    known, ends, own = G.load_graph(nodes, edges, presence)
    assert sorted((r["nid"], r["weight"], r["read_count"], r["kmer_count"]) for r in known.collect()) == [("a", 2.5, 0, 0), ("b", 0.0, 0, 0), ("c", 0.0, 0, 0)]
    assert sorted(map(tuple, ends.collect())) == [("a", "b"), ("b", "c")] and sorted(map(tuple, own.collect())) == [("a", "s1"), ("c", "s2")]


def test_gather_is_written(spark, tmp_path):
    rows = [("sample", 2, "s@b", 0.25, 0.5, 10), ("sample", 1, "s@a", 0.5, 1.0, 20)]
    P.write_gather(spark.createDataFrame(rows, "query string, round int, name string, f_query double, f_match double, shared long").coalesce(1), str(tmp_path / "g.tsv"))
    (part,) = (tmp_path / "g.tsv").glob("part-*")
    assert part.read_text().splitlines() == ["name\tf_query\tf_match\tcum_f_query", "s@a\t0.5\t1.0\t0.5", "s@b\t0.25\t0.5\t0.75"]


def test_bank_folder_and_lists(spark, tmp_path):
    for p in ("one/a.fa", "one/b.fna.gz", "two/c.gbff", "two/notes.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted((r["pangenome"], r["path"].rpartition("/")[2]) for r in discover.bank_folder(spark, str(tmp_path)).collect()) == [("one", "a.fa"), ("one", "b.fna.gz"), ("two", "c.gbff")]
    assert sorted(r["length"] for r in discover.listed(spark, str(tmp_path)).collect()) == [1, 1, 1]
    (tmp_path / "list").write_text(f"{tmp_path}/one/a.fa\n\n{tmp_path}/two/c.gbff\nfile://{tmp_path}/one/b.fna.gz\n")
    assert discover.file_of_files(spark, str(tmp_path / "list")).count() == 3
    for bad in ("one/x.fa", "three/a.fa"):
        (tmp_path / "list").write_text(f"{tmp_path}/one/a.fa\n{tmp_path}/{bad}\n")
        with pytest.raises(FileNotFoundError):
            discover.file_of_files(spark, str(tmp_path / "list"))


def test_refit_with_other_options(spark):
    nodes = [("s", f"f{i}", "P" if i < 4 else "S", 6.0 if i < 6 else 2.0) for i in range(10)] + [("z", "f0", "P", 1.0)]
    presence = [("s", f"f{i}", "A") for i in range(6)] + [("s", f"f{i}", "B") for i in range(4, 10)] + [("z", "f0", "A")]
    told = spark.createDataFrame(nodes, "species string, nid string, partition string, weight double")
    edges = spark.createDataFrame([("s", "f0", "f1")], "species string, src string, dst string")
    own = spark.createDataFrame(presence, "species string, nid string, strain string")
    one = run.refit(told, edges, own, "s", P.Options(k_max=1, refine=False))
    assert one.selection.labels == ["A"] and one.selection.x[0] == pytest.approx(6.0)


def test_fetching(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    wanted = make([(x,) for x in "abcd"], "label string")
    plan = catalog.fetch_plan(wanted, make([("a",), ("a",), ("z",)], "label string"))
    assert {r["label"]: r["action"] for r in plan.collect()} == {"a": "present", "b": "fetch", "c": "fetch", "d": "fetch"}
    tried = make([("b", 1, "timeout"), ("b", 2, None), ("c", 1, None), ("c", 2, "gone"), ("q", 1, None)], "label string, attempt int, error string")
    told = catalog.outcomes(plan, tried)
    assert sorted(map(tuple, told.collect())) == [("a", "present", None), ("b", "fetched", None), ("c", "failed", "gone"), ("d", "pending", None)]
    assert tuple(catalog.tally(told).first()) == (1, 1, 1, 1)
    assert {r["action"] for r in catalog.fetch_plan(wanted, make([("a",)], "label string"), force=True).collect()} == {"fetch"}


def test_mapping_is_written_and_read(spark):
    reads = spark.createDataFrame([(0, "r0"), (1, "r1"), (2, "r2")], "index long, read string")
    best = R.mapped(spark.createDataFrame([("r0", "f2", 9, 10), ("r0", "f1", 5, 10), ("r2", "f1", 5, 10)], "read string, label string, hits long, n_kmers long"))
    lines = lambda *a: [r["value"] for r in R.mapping_lines(reads, best, *a).orderBy("index").collect()]
    assert lines() == ["0\tr0\t<f2>:9\t<f1>:5", "1\tr1", "2\tr2\t<f1>:5"]
    assert lines("labels") == ["0\tr0\t<f2>\t<f1>", "1\tr1", "2\tr2\t<f1>"]
    assert lines("matches", True)[:2] == ['{"index":0,"read":"r0","labels":[{"label":"f2","hits":9},{"label":"f1","hits":5}]}', '{"index":1,"read":"r1","labels":[]}']
    assert lines("labels", True)[2] == '{"index":2,"read":"r2","labels":["f1"]}'
    back = R.mapping_from_tsv(R.mapping_lines(reads, best), F.col("value"), ("index",))
    assert sorted(map(tuple, back.collect())) == [(0, True, "f2", 9), (1, False, None, None), (2, True, "f1", 5)]
    with pytest.raises(ValueError):
        R.mapping_lines(reads, best, "other")
