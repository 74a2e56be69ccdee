"""k-mers of genomes that no read holds: they fall by their numbers, before they are hashed."""

import random
import tracemalloc

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pytest
from helixlake.functions import codes as C
from helixlake.functions.dna import crowded, projected, spread
from helixlake.operators import mapping as R
from helixlake.operators import sketch as K
from helixlake.plans import testmap as T
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def some(rng, n: int, letters: str = "ACGT") -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def numbers_of(seqs: list, k: int) -> np.ndarray:
    return np.unique(np.concatenate([x for _, x in C.kmers_of(pa.array(seqs), k)]))


@pytest.mark.parametrize("k", [2, 21, 31])
def test_wanted_kmers(k, monkeypatch):
    """Those that are wanted, with the places of their sequences, as a filter afterwards leaves them."""
    rng = random.Random(k)
    seqs = pa.array([None, "", some(rng, 70, "ACGTN"), some(rng, k), some(rng, 300), some(rng, k - 1), some(rng, 90, "acgt")])
    for size in (1 << 16, 64):
        monkeypatch.setattr(C, "POSITIONS", size)
        every = [(r, x) for rows, found in C.kmers_of(seqs, k) for r, x in zip(rows.tolist(), found.tolist(), strict=True)]
        got = [(r, x) for rows, found in C.kmers_of(seqs, k, lambda x: x % np.uint64(3) == 0) for r, x in zip(rows.tolist(), found.tolist(), strict=True)]
        assert got == [(r, x) for r, x in every if x % 3 == 0] != every
    assert list(C.kmers_of(seqs, k, lambda x: np.zeros(len(x), bool))) == []


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 8, 9, 15, 16, 17, 21, 31])
def test_numbers_of_kmers(k):
    """As the digits of base 4 give them, from codes of any type."""
    rng = np.random.default_rng(k)
    for kind in (np.uint8, np.int64):
        codes = rng.integers(0, 4, 200).astype(kind)
        number = lambda x: int("".join(map(str, x)), 4)
        want = [min(number(x), number([3 - i for i in x[::-1]])) for x in (codes[i : i + k].tolist() for i in range(200 - k + 1))]
        got = C.canonical(codes, k)
        assert got.dtype == np.uint64 and got.tolist() == want
    assert C.canonical(codes[: k - 1], k).tolist() == []


def test_short_numbers_are_narrow():
    """Numbers of few letters take few bytes until the last step."""
    codes = np.random.default_rng(1).integers(0, 4, C.POSITIONS).astype(np.uint8)
    for k, most in ((4, 1.5), (21, 4)):
        tracemalloc.start()
        made = C.canonical(codes, k).nbytes
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * made


def test_projected_ends():
    """Each sequence ends where it should, between texts that are empty, null or without letters."""
    texts = ["", None, "ab", "", "12", "Cd é", None, "x", ""]
    assert projected(pa.array(texts)).to_pylist() == ["", None, "AC", "", "", "GT", None, "T", ""]
    assert projected(pa.array(["", ""])).to_pylist() == ["", ""] and projected(pa.array(texts).slice(3, 3)).to_pylist() == ["", "", "GT"]


def screens(spark, monkeypatch, name: str) -> list:
    """What the passes of a query over its genomes want hashed."""
    made, step = [], R.hashed_rows
    monkeypatch.setattr(R, "hashed_rows", lambda *a: made.append(a[6:]) or step(*a))
    entry.queries()[name](spark, SMALL)
    return made


@pytest.mark.parametrize("name", ["read_min_fraction", "kmer_label_within", "read_top_label"])
def test_few_kmers_are_hashed(spark, monkeypatch, name):
    """All k-mers of reads are, and hardly any other."""
    ((wanted,),) = screens(spark, monkeypatch, name)
    reads = numbers_of([r["seq"] for r in T.reads(spark, SMALL).collect()], T.K)
    assert wanted(reads).all()
    others = numbers_of([some(random.Random(9), 50_000)], T.K)
    assert wanted(others).mean() < 0.01


def test_few_kmers_are_looked_up(spark, monkeypatch):
    """Only k-mers whose word is in use are looked up in the large table of the reads' k-mers."""
    ((wanted,),) = screens(spark, monkeypatch, "read_top_label")
    looked, step = [], K.may_hold
    monkeypatch.setattr(K, "may_hold", lambda table, values, *a: looked.append(len(values)) or step(table, values, *a))
    others = numbers_of([some(random.Random(9), 50_000)], T.K)
    wanted(others)
    assert 0 < sum(looked) < len(others) / 10


@pytest.mark.parametrize("known", [0, 1, 1000, 400_000])
def test_words_in_use(known):
    """They change nothing, and are told only if they are few."""
    rng = np.random.default_rng(known)
    values, table = rng.integers(0, 2**64, known, np.uint64), np.zeros(1 << K.PREFIX - 6, np.uint64)
    first = values >> np.uint64(64 - K.PREFIX)
    np.bitwise_or.at(table, (first >> np.uint64(6)).astype(np.intp), np.uint64(1) << (first & np.uint64(63)))
    words = K.known_words(table)
    assert (words is None) == (known == 400_000)
    asked = np.concatenate([values, rng.integers(0, 2**64, 20_000, np.uint64), values ^ np.uint64(1 << 40)])
    assert K.may_hold(table, values, 16, words).all() and (K.may_hold(table, asked, 16, words) == K.may_hold(table, asked, 16)).all()
    assert K.may_hold(table, asked[:0], 16, words).tolist() == []


@pytest.mark.parametrize("k", [21, 31, 33])
def test_labels_within_reads(spark, k):
    """Labels and counts are those that a join on all hashes leaves, for short and long k-mers and hashes given alone."""
    rng = random.Random(k)
    core = some(rng, 300)
    genes = spark.createDataFrame([(i % 3 or None, core[30 * i :] + some(rng, 100) + core[:60]) for i in range(6)] + [(5, None), (5, "ACG")], "label int, seq string")
    reads = spark.createDataFrame([(core[100:200].lower(),), (core[150:260] + "N" + some(rng, 50),), (None,)], "seq string")
    known = R.read_hashes(reads, "seq", k)
    order = lambda rows: sorted(map(tuple, rows.collect()), key=lambda x: (x[0], x[1] or 0))
    for least in (1, 2):
        want = order(R.kmer_labels(genes, "seq", "label", k, least).join(known, "h", "left_semi"))
        assert order(R.kmer_labels(genes, "seq", "label", k, least, within=known)) == want != []
        assert order(R.kmer_labels(genes, "seq", "label", k, least, within=known.select("h"))) == want


@pytest.mark.parametrize("name", ["read_kmer_hits", "mapping_lines"])
def test_one_row_group_is_dealt(spark, tmp_path, monkeypatch, name):
    """Documents of a file with one row group, which Spark cuts into many partitions of which one has rows, are worked on by all tasks."""
    docs = T.table(spark, SMALL, "documents")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    T.table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    made, step = [], R.hashed_rows
    monkeypatch.setattr(R, "hashed_rows", lambda seqs, *a: made.append(seqs) or step(seqs, *a))
    try:
        plain = T.table(spark, str(tmp_path), "documents")
        held = lambda df: [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert plain.rdd.getNumPartitions() > 4 and held(plain) == [docs.count()]
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
        assert len(made) == 1 and len(tasks := held(made[0])) >= 4 and max(tasks) < docs.count() / 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(map(tuple, entry.queries()[name](spark, SMALL).collect())) != []


def test_even_files_stay(spark, tmp_path):
    """Files that feed all tasks alike are not shuffled, nor are plans that are no scan."""
    rows = spark.range(4000, numPartitions=8).withColumn("text", F.md5(F.col("id").cast("string").cast("binary")))
    rows.write.parquet(str(tmp_path / "x"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
    try:
        files = spark.read.parquet(str(tmp_path / "x"))
        assert files.rdd.getNumPartitions() >= 8 and spread(files) is files and spread(rows) is rows
        assert not crowded(spark.read.parquet(str(tmp_path / "x")).where("false"), 4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
