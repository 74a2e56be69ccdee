"""k-mers as numbers: the same hashes as row by row, and few rows that leave a task."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helixlake.functions import codes as C
from helixlake.functions.md5 import md5_first
from helixlake.functions.murmur import first_halves
from helixlake.operators import sketch as K
from pyspark.sql import functions as F

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def plain_kmers(seqs, k):
    for i, s in enumerate(seqs):
        s = (s or "").upper()
        for p in range(len(s) - k + 1):
            if set(x := s[p : p + k]) <= set("ACGT"):
                yield i, min(x, x.translate(COMPLEMENT)[::-1])


def some(rng, n):
    return "".join(rng.choice("ACGTacgtN" if rng.random() < 0.1 else "ACGT") for _ in range(n))


@pytest.mark.parametrize("size", [1, 3, 4, 21, 23, 54, 55])
def test_md5(size):
    rng = random.Random(size)
    rows = [rng.randbytes(size) for _ in range(40)]
    got = md5_first(np.frombuffer(b"".join(rows), np.uint8).reshape(40, size))
    assert [format(x, "016x") for x in got.tolist()] == [hashlib.md5(r).hexdigest()[:16] for r in rows]


@pytest.mark.parametrize("k", [1, 4, 21, 31])
def test_kmers_and_hashes(k, monkeypatch):
    monkeypatch.setattr(C, "POSITIONS", 50)  # k-mers across blocks, and rows across them
    rng = random.Random(k)
    seqs = [some(rng, rng.choice([0, 3, 20, 21, 22, 70, 300])) for _ in range(20)] + [None, ""]
    want = list(plain_kmers(seqs, k))
    found = list(C.kmers_of(pa.array(["CCCC", *seqs, "G" * 40])[1:-1], k))  # a slice of a longer array
    assert [(r, bytes(w).decode()) for at, ks in found for r, w in zip(at.tolist(), C.spelled(ks, k), strict=True)] == want
    numbers = np.concatenate([ks for _, ks in found])
    assert C.hex_digits(C.hashes(numbers, k, "md5"), 15).to_pylist() == [hashlib.md5(x.encode()).hexdigest()[:15] for _, x in want]
    assert C.hashes(numbers, k, "murmur3").tolist() == first_halves([x.encode() for _, x in want]).tolist()


@pytest.fixture(scope="module")
def genomes(spark):
    rng = random.Random(9)
    rows = [(f"g{i % 5}", some(rng, 3000)) for i in range(8)] + [("none", None), ("short", "ACG")]
    return rows, spark.createDataFrame(rows, "name string, seq string")


def test_murmur_rows_carry_no_sequence(genomes):
    """The pieces of sequences do not lie in queues beside each of their k-mers."""
    rows, df = genomes
    got = K.sketch(df, "seq", ["name"], 21, 10, method="murmur3")
    want = {(rows[i][0], h) for i, h in ((i, format(first_halves([x.encode()])[0], "016x")) for i, x in plain_kmers([s for _, s in rows], 21)) if h < format(16**16 // 10, "016x")}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_bottom_n_before_the_shuffle(spark, genomes, monkeypatch):
    """At most n hashes of a sequence's block leave its task, and the result is that of all of them."""
    rows, df = genomes
    kept = []
    step = K.hashed_rows
    monkeypatch.setattr(K, "hashed_rows", lambda *a: kept.append(step(*a)) or kept[-1])
    got = K.sketch(df, "seq", ["name"], 21, n=5)
    by = {}
    for i, x in plain_kmers([s for _, s in rows], 21):
        by.setdefault(rows[i][0], set()).add(hashlib.md5(x.encode()).hexdigest()[:15])
    assert sorted(map(tuple, got.collect())) == sorted((name, h) for name, hs in by.items() for h in sorted(hs)[:5])
    assert kept[0].count() <= 5 * 8


@pytest.mark.parametrize("method", ["md5", "murmur3"])
def test_same_rows_as_by_functions(genomes, monkeypatch, method):
    """Bounds, counts and keys as the functions on rows give them."""
    _, df = genomes
    cases = [dict(scaled=3), dict(scaled=1), dict(n=4), dict(scaled=1, min_count=2), dict(n=3, min_count=2)]
    twice = df.unionByName(df.where("name < 'g3'")).withColumn("id", F.struct("name"))
    made = [sorted(map(tuple, K.sketch(twice, "seq", ["name", "id"], 21, method=method, **c).collect())) for c in cases]
    monkeypatch.setattr(K, "fast", lambda *a: False)
    assert made == [sorted(map(tuple, K.sketch(twice, "seq", ["name", "id"], 21, method=method, **c).collect())) for c in cases]
    assert all(made)


@pytest.mark.parametrize("k", [2, 21, 31])
def test_labels_of_distinct_kmers(spark, monkeypatch, k):
    """Labels and counts as a plain dictionary has them, for k-mers dealt as numbers; their rows are few."""
    from helixlake.operators import mapping as R

    rng = random.Random(k)
    core = some(rng, 400)
    rows = [(i % 3 or None, core[100 * i :] + some(rng, 200)) for i in range(4)] + [(7, None), (8, "ACGT" * 20), (8, "ACGT" * 20)]
    df = spark.createDataFrame(rows, "label int, seq string").repartition(3)
    times = {}
    for i, x in plain_kmers([s for _, s in rows], k):
        key = hashlib.md5(x.encode()).hexdigest()[:15], rows[i][0]
        times[key] = times.get(key, 0) + 1
    order = lambda x: (x[0], x[1] or 0)
    for least in (1, 2):
        got = [tuple(r) for r in R.kmer_labels(df, "seq", "label", k, least).collect()]
        assert sorted(got, key=order) == sorted((x for x, n in times.items() if n >= least), key=order)
    plan = R.kmer_labels(df, "seq", "label", k)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(h" not in plan


def test_ends_of_labels_need_no_sort(spark):
    """The label index is summed in a hash table: rows of all k-mers are not sorted by their label."""
    import __spark_entry__ as entry

    plan = entry.queries()["kmer_label_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_known_prefixes(spark):
    """No known hash is without its bit."""
    from helixlake.operators import mapping as R

    hs = ["0" * 15, "f" * 15, *(hashlib.md5(bytes([i])).hexdigest()[:15] for i in range(200))]
    bits = R.known_prefixes(spark.createDataFrame([(h,) for h in hs], "h string"))
    first = [int(h, 16) >> 34 for h in hs]
    assert all(int(bits[p >> 6]) >> (p & 63) & 1 for p in first) and sum(int(x).bit_count() for x in bits[bits > 0].tolist()) == len(set(first))
