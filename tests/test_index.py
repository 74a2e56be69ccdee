"""Stored indexes: buckets that join without a shuffle, classes of labels, and the sieve before the shuffle."""

import random

import pytest
from helixlake.operators import mapping as R
from helixlake.operators import search as S
from helixlake.plans import buckets, run
from pyspark.sql import functions as F


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df):
    """For each Exchange of a plan, the text below it."""
    lines = physical(df).split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "Exchange " in line and "BroadcastExchange" not in line:
            j = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:j]))
    return out


def stays(df, path):
    """Whether a plan reads the stored table, and shuffles other rows to it by hash but never its own."""
    by_hash = [x for x in exchanged(df) if "hashpartitioning(h#" in x.split("\n")[0]]
    name = buckets._name(path)
    return "SortMergeJoin [h#" in physical(df) and f"{name}[" in physical(df) and bool(by_hash) and not any(name in x for x in by_hash)


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = [dna(150) for _ in range(12)]
    genes = [(f"f{i}", f"g{g}", s if rng.random() < 0.8 else s[:70] + dna(20) + s[90:]) for g in range(6) for i, s in enumerate(core) if i < 8 or rng.random() < 0.5]
    reads = [(n, core[n % 12][a : a + 60]) for n in range(40) for a in (n,)] + [(100, dna(60)), (101, "ACG"), (102, core[0][:40] + "N" + core[1][:40])]
    return spark.createDataFrame(genes, "family string, genome string, sequence string"), spark.createDataFrame(reads, "read long, seq string")


def rows(df):
    return sorted(tuple(r) for r in df.select("read", "label", "hits", "n_kmers").collect())


def test_classes_give_the_same_hits(spark, data, tmp_path, no_broadcast):
    genes, reads = data
    folder = str(tmp_path / "pan")
    run.index_pangenome(genes, folder, buckets=8)
    index = run.open_pangenome(spark, folder)
    for kind in "family", "genome":
        plain = R.kmer_labels(genes, "sequence", kind)
        assert rows(index.hits(reads, "seq", "read", kind)) == rows(R.label_hits_of_reads(reads, "seq", "read", plain))
        assert sorted(map(tuple, index.labels(kind).collect())) == sorted(map(tuple, plain.collect()))
    assert index.kmers.count() == index.kmers.select("h").distinct().count()
    assert index.classes.select("class").distinct().count() < index.kmers.count() / 10
    assert stays(index.hits(reads, "seq", "read"), f"{folder}/kmers")
    plain = spark.read.parquet(f"{folder}/kmers")  # the same files without their layout are shuffled
    assert any("hashpartitioning(h#" in x.split("\n")[0] and "parquet [h#" in x for x in exchanged(R.class_hits_of_reads(reads, "seq", "read", plain, index.classes, "family")))
    files = [p for p in (tmp_path / "pan/kmers").iterdir() if p.name.startswith("part-")]
    assert len(files) == 8
    run.index_pangenome(genes.where("genome <> 'g0'").drop("genome"), folder, buckets=4, min_count=2)  # written anew at the same place
    again = run.open_pangenome(spark, folder)
    assert sorted(map(tuple, again.labels().collect())) == sorted(map(tuple, R.kmer_labels(genes.where("genome <> 'g0'"), "sequence", "family", min_count=2).collect()))
    assert again.labels("genome").count() == 0


def test_search_reads_the_index_where_it_lies(spark, data, tmp_path, no_broadcast):
    genes, reads = data
    genomes = genes.groupBy(F.col("genome").alias("name")).agg(F.concat_ws("N", F.sort_array(F.collect_list("sequence"))).alias("sequence")).withColumn("species", F.substring("name", 1, 1))
    run.index_bank(genomes, str(tmp_path / "bank"), scaled=2, buckets=8)
    bank = run.open_bank(spark, str(tmp_path / "bank"))
    query = bank.sketch(reads.select(F.col("read").cast("string").alias("query"), F.col("seq").alias("sequence")))
    for level in "genome", "pangenome":
        got = bank.search(query, level, "containment")
        want = S.search(query, bank.index(level), "containment").orderBy("query", F.desc("score"), "name")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] and got.count() > 20
    both = S.overlaps(query, bank.index(), bank.sizes["genome"])
    assert stays(both, str(tmp_path / "bank/genomes"))


def test_buckets_of_another_session(spark, tmp_path):
    """A session that has not written the table opens it from its layout."""
    path = str(tmp_path / "it's here")
    spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("key")).write.parquet(str(tmp_path / "x"))
    buckets.write_buckets(spark.read.parquet(str(tmp_path / "x")), path, "key", 5)
    spark.sql(f"DROP TABLE {buckets._name(path)}")
    table = buckets.read_buckets(spark, path)
    assert table.count() == 100 and not exchanged(table.groupBy("key").count())


def test_sieve(spark, data, monkeypatch):
    """No known hash is held back, most of the others are, and the labels are the same with it, without it, and when it is full."""
    known = spark.range(3000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    all_rows = spark.range(60_000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    filters = R.sieve(known, 1 << 10)
    assert filters.count() <= 1 << 10
    got = R.sifted(all_rows, filters, 1 << 10)
    assert got.where("id < 3000").count() == 3000 and got.columns == ["id", "h"]
    assert got.where("id >= 3000").count() < 0.03 * 57_000
    assert R.sieve(known.where("false")).count() == 0 and R.sifted(all_rows, R.sieve(known.where("false"))).count() == 0
    genes, reads = data
    plain = sorted(map(tuple, R.kmer_labels(genes, "sequence", "family").join(R.read_hashes(reads, "seq"), "h", "left_semi").collect()))
    calls, step = [], R.sifted
    monkeypatch.setattr(R, "sifted", lambda *a: (calls.append(1), step(*a))[1])
    for words, used in ((R.SIEVE_WORDS, 1), (1 << 10, 1), (2, 0)):
        calls.clear()
        assert sorted(map(tuple, R.kmer_labels(genes, "sequence", "family", within=R.read_hashes(reads, "seq"), words=words).collect())) == plain
        assert len(calls) == used
