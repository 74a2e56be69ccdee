"""A sample with two planted strains, from reads to a profile; settings and helpers."""

import random

import pytest
from helixlake import config, support
from helixlake.plans import run


def test_reads_to_profile(spark, tmp_path):
    rng = random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    fams = {f"f{i}": dna(200) for i in range(24)}
    strains = {"A": [*range(0, 8), *range(16, 24)], "B": [*range(8, 24)], "C": [*range(20, 24)]}
    presence = [("s1", f"f{i}", s) for s, own in strains.items() for i in own]
    reads = [(n, s) for n, s in enumerate(fams[f"f{i}"][a : a + 100] for s, copies in (("A", 2), ("B", 4)) for i in strains[s] for _ in range(copies) for a in (0, 50, 100))]
    genomes = [("s1@" + s, "s1", "".join(fams[f"f{i}"] for i in own)) for s, own in strains.items()] + [("s2@x", "s2", dna(3000))]
    make = spark.createDataFrame
    folder = str(tmp_path / "bank")
    run.index_bank(make(genomes, "name string, species string, sequence string"), folder, scaled=5)
    bank = spark.read.parquet(f"{folder}/genomes")
    assert spark.read.parquet(f"{folder}/pangenomes").select("species").distinct().count() == 2
    stored = run.open_bank(spark, folder)
    assert (stored.k, stored.scaled, stored.n) == (21, 5, 0)
    own = stored.search_genome("s1@A", mode="containment").collect()
    assert (own[0]["name"], own[0]["score"]) == ("s1@A", 1.0) and [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
    whole = stored.search_sequences(make([("q", genomes[1][2])], "query string, sequence string"), "pangenome", "containment", 0.5).collect()
    assert [(r["query"], r["name"], r["score"]) for r in whole] == [("q", "s1", 1.0)]
    nodes = make([("s1", f, "P" if int(f[1:]) >= 16 else "S", 200) for f in fams], "species string, nid string, partition string, length int")
    edges = make([("s1", f"f{i}", f"f{i + 1}") for i in range(23)], "species string, src string, dst string")
    args = (
        make(reads, "read long, sequence string"), bank, make([("s1", f, s) for f, s in fams.items()], "species string, family string, sequence string"),
        nodes, edges, make(presence, "species string, nid string, strain string"), str(tmp_path / "run"),
    )
    found = run.profile_sample(*args, scaled=5)
    assert set(found) == {"s1"}
    ra = dict(zip(found["s1"].selection.labels, found["s1"].selection.ra, strict=True))
    assert set(ra) == {"A", "B"} and abs(ra["B"] - 2 / 3) < 0.05
    again = run.profile_sample(*args, scaled=5)
    assert again["s1"].selection.labels == found["s1"].selection.labels
    assert len(list((tmp_path / "run").glob("mapping-*"))) == 1
    assert run.profile_sample(*args, species=["s1", "s1"], scaled=5)["s1"].selection.labels == found["s1"].selection.labels


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text("[profile]\nk_max = 5\n")
    out, origin = config.load([("file", config.read(tmp_path / "a.toml")), ("environment", config.from_environment(environ={"HELIXLAKE_PROFILE_CV_FOLDS": "7", "OTHER": "1"}))])
    assert (out["profile"]["k_max"], out["profile"]["cv_folds"], out["profile"]["merge_jaccard"]) == (5, 7, 0.95)
    assert (origin["profile.k_max"], origin["profile.cv_folds"], origin["profile.stop_rule"]) == ("file", "environment", "defaults")
    for bad in ({"profile": {"k_max": "x"}}, {"nope": 1}, {"profile": 3}, {"profile": {"refine": 1}}):
        with pytest.raises(ValueError):
            config.check(bad)


def test_helpers():
    assert support.duration(1.5) == "1.50s" and support.duration(120) == "2.0m" and support.duration(3661, "%Hh%Mm%Ss") == "1h1m1s"
    assert support.output_name("{query}_{collection}.tsv.tsv", query="q", collection="c") == "q_c.tsv"
    assert support.scrubbed("run /data/x/sample1 on /data/x", {"/data/x": "folder", "/data/x/sample1": "sample"}) == "run <sample> on <folder>"
