"""Searches whose index is restricted, where it is hashed, to what the queries hold."""

import random

import __spark_entry__ as entry
import pyarrow as pa
import pytest
from helixlake.functions.dna import project_dna, projected
from helixlake.operators import search as S
from helixlake.operators import sketch as K
from helixlake.plans import testmap as T
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_projection_of_bytes(spark):
    """As lower(), translate() and regexp_replace() give it, for slices, nulls and letters that fold to a to z."""
    rng = random.Random(4)
    texts = [None, "", "İ", "K", "â", *["".join(rng.choice("abczXYZKI \nİKé漢\U0001f600Äı™Ǆ") for _ in range(rng.randrange(30))) for _ in range(200)]]
    letters = F.translate(F.lower("text"), T._LETTERS, T._BASES)
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    rows = df.select(project_dna(F.col("text")).alias("a"), F.regexp_replace(letters, "[^ACGT]", "").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[0]["a"] is None and len({r["a"] for r in rows}) > 100
    assert projected(pa.array(texts)[2:40]).to_pylist() == projected(pa.array(texts)).to_pylist()[2:40]
    assert projected(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("case", [{}, {"method": "murmur3"}, {"method": "xxhash64"}, {"min_count": 2}, {"n": 9, "scaled": 1}])
def test_sketch_of_known_hashes(spark, case):
    rng = random.Random(5)
    df = spark.createDataFrame([(f"g{i % 4}", "".join(rng.choice("ACGT") for _ in range(900)) * 2) for i in range(8)], "name string, seq string")
    whole = K.sketch(df, "seq", ["name"], **({"scaled": 5} | case))
    rows = sorted(map(tuple, whole.collect()))
    known = {h for _, h in rows[::7]}
    got = K.sketch(df, "seq", ["name"], **({"scaled": 5} | case), within=spark.createDataFrame([(h,) for h in [*known, "0" * len(rows[0][1])]], "h string"))
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[1] in known] != []


@pytest.mark.parametrize("name", ["search_top_labels", "gather_excluding"])
def test_few_hashes_leave_their_task(spark, monkeypatch, name):
    """Of the genomes' hashes only those of reads are shuffled, and whole sketches of matches alone."""
    made, step = [], K.hashed_rows
    monkeypatch.setattr(K, "hashed_rows", lambda *a: made.append(step(*a)) or made[-1])
    entry.queries()[name](spark, SMALL).collect()
    left = sum(df.count() for df in list(made))
    assert 0 < left < T.genome_index(spark, SMALL).count() / 2


@pytest.mark.parametrize("mode", S.SCORES)
def test_sizes_of_matches(spark, mode):
    """A search with sizes made for its matches gives what it gives with all sizes."""
    rng = random.Random(6)
    index = [(f"n{i}", f"{rng.randrange(300):03d}") for i in range(20) for _ in range(40)]
    index = spark.createDataFrame(index, "name string, h string").distinct()
    queries = spark.createDataFrame([(q, f"{rng.randrange(300):03d}") for q in range(5) for _ in range(60)], "query int, h string").distinct()
    asked = []
    counts = index.groupBy("name").agg(F.count("*").alias("n_match"))
    sizes = lambda names: asked.append(names.count()) or counts.join(names, "name", "left_semi")
    known = index.join(queries.select("h").distinct(), "h", "left_semi")
    for threshold in (0.01, 0.12, 0.17):
        want = sorted(map(tuple, S.search(queries, index, mode, threshold).collect()))
        assert sorted(map(tuple, S.search(queries, known, mode, threshold, sizes=sizes).collect())) == want
        assert mode == "max_containment" or threshold < 0.17 or asked[-1] < 20


@pytest.mark.parametrize("scaled", [1, 3])
def test_sketch_of_labels_as_numbers(spark, monkeypatch, scaled):
    """The rows of sketch(), from hashes that are shuffled many to a row."""
    rng = random.Random(7)
    core = "".join(rng.choice("ACGT") for _ in range(1500))
    rows = [(("a", "b", None)[i % 3], core[100 * i :] + "".join(rng.choice("ACGTN") for _ in range(300))) for i in range(7)] + [("c", None), ("c", "ACG")]
    df = spark.createDataFrame(rows, "label string, seq string").repartition(3)
    monkeypatch.setattr(K, "DEALT", 500)
    order = lambda x: (x[0] or "", x[1])
    got = K.label_sketch(df, "seq", "label", 21, scaled)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, K.sketch(df, "seq", ["label"], 21, scaled).collect()), key=order) != []
    assert "hashpartitioning(part" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(h" not in plan


def test_pangenome_of_one_pass(spark, tmp_path, monkeypatch):
    """Families and genomes are labelled by one pass over the sequences, with counts by each."""
    from helixlake.operators import mapping as R
    from helixlake.plans import run

    rng = random.Random(8)
    core = "".join(rng.choice("ACGT") for _ in range(60))
    genes = spark.createDataFrame([(f"f{i % 2}", f"g{i % 3}", core[i:] + "".join(rng.choice("ACGT") for _ in range(30))) for i in range(5)], "family string, genome string, sequence string")
    known = spark.createDataFrame([(core,)], "s string")
    passes, step = [], R.hashed_rows
    monkeypatch.setattr(R, "hashed_rows", lambda *a: passes.append(1) or step(*a))
    for least in (1, 2):
        run.index_pangenome(genes, f"{tmp_path}/p{least}", 21, least, R.read_hashes(known, "s", 21), 4)
        assert len(passes) == least
        have = run.open_pangenome(spark, f"{tmp_path}/p{least}")
        for kind in ("family", "genome"):
            want = R.kmer_labels(genes, "sequence", kind, 21, least).join(R.read_hashes(known, "s", 21), "h", "left_semi")
            assert sorted(map(tuple, have.labels(kind).collect())) == sorted(map(tuple, want.collect())) != []


def test_chosen_names_have_a_size(spark):
    """The names that a gather asks sizes for are a small table, so no sequence is shuffled to them."""
    index = spark.createDataFrame([(f"n{i % 5}", f"{i:03d}") for i in range(40)], "name string, h string")
    query = spark.createDataFrame([("q", f"{i:03d}") for i in range(0, 40, 3)], "query string, h string")
    asked = []

    def sizes(names):
        asked.append(names._jdf.queryExecution().optimizedPlan().nodeName())
        return index.join(names, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n_match"))

    rows = S.gather_sample(query, index.join(query, "h", "left_semi"), 0.0, sizes=sizes)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, S.gather_sample(query, index, 0.0).collect())) != []
    assert asked == ["LogicalRelation"]  # of files, whose size is known
