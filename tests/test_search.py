"""Gathering of a whole sample against brute force."""

import random

import __spark_entry__ as entry
import pytest
from helixlake.operators import search

SMALL = "/root/testdata/sf0.001"


def cover(query, genomes, threshold):
    """(round, name, f_query, f_match, shared) of the greedy cover of a set of hashes."""
    left, out = set(query), []
    while left:
        shared, name = min((-len(left & hs), n) for n, hs in genomes.items() if n not in {r[1] for r in out}) if len(out) < len(genomes) else (0, "")
        if not shared or -shared / len(left) < threshold:
            break
        out.append((len(out) + 1, name, round(-shared / len(query), 4), round(-shared / len(genomes[name]), 4), -shared))
        left -= genomes[name]
    return out


@pytest.mark.parametrize("most", [10**6, 150, 0])
def test_gather_of_a_sample(spark, monkeypatch, most):
    rng = random.Random(3)
    query = {f"{i:04d}" for i in range(400)}
    genomes = {f"s{i % 4}@{i}": {f"{rng.randrange(600):04d}" for _ in range(rng.randint(5, 160))} for i in range(8)}
    q = spark.createDataFrame([("sample", h) for h in query], "query string, h string")
    index = spark.createDataFrame([(n, n.split("@")[0], h) for n, hs in genomes.items() for h in hs], "name string, species string, h string")
    monkeypatch.setattr(search, "GROUP_PAIRS", most)
    for threshold, out in ((0.0, None), (0.05, None), (0.15, None), (0.0, "s1")):
        exclude = None if out is None else index.where(f"species = '{out}'").select("name")
        got = search.gather_sample(q, index, threshold, exclude).orderBy("round").collect()
        want = cover(query, {n: hs for n, hs in genomes.items() if out is None or not n.startswith(out)}, threshold)
        assert len(want) > 3 and [tuple(r)[1:] for r in got] == want and {r["query"] for r in got} == {"sample"}
    assert search.gather_sample(q.where("false"), index).count() == 0 and search.gather_sample(q, index.where("false")).count() == 0


@pytest.mark.parametrize(("most", "matches"), [(400, 4096), (10**6, 5), (900, 12)])
def test_gather_counts_all_pairs_rarely(spark, monkeypatch, most, matches):
    """Most rounds are told from bounds: the pairs are gone over for fewer than half of them."""
    rng = random.Random(8)
    query = {f"{i:04d}" for i in range(900)}
    genomes = {f"g{i:02d}": {f"{(i * 14 + rng.randrange(60)) % 1000:04d}" for _ in range(40)} for i in range(60)}
    q = spark.createDataFrame([("sample", h) for h in query], "query string, h string")
    index = spark.createDataFrame([(n, h) for n, hs in genomes.items() for h in hs], "name string, h string")
    monkeypatch.setattr(search, "GROUP_PAIRS", most)
    monkeypatch.setattr(search, "MOST_MATCHES", matches)
    passes, step = [], search.without
    monkeypatch.setattr(search, "without", lambda *a: (passes.append(1), step(*a))[1])
    got = search.gather_sample(q, index, 0.0).orderBy("round").collect()
    want = cover(query, genomes, 0.0)
    assert [tuple(r)[1:] for r in got] == want and len(want) > 20
    assert 0 < 2 * len(passes) < len(want)


def test_whole_detection(spark):
    from helixlake.plans import testmap

    query = {r["h"] for r in testmap.sample(spark, SMALL).collect()}
    genomes = {}
    for r in testmap.genome_index(spark, SMALL).collect():
        genomes.setdefault(r["name"], set()).add(r["h"])
    run = lambda name: entry.queries()[name](spark, SMALL).orderBy(*(["first_round"] if name.startswith("cand") else ["round"])).collect()
    run_plain = lambda name: sorted(tuple(r) for r in entry.queries()[name](spark, SMALL).collect())
    want, total = cover(query, genomes, 0.05), 0
    for r, (k, name, f_query, f_match, _) in zip(run("detection_full"), want, strict=True):
        total += f_query
        assert (r["round"], r["genome"], r["f_query"], r["f_match"], r["cum_f_query"]) == (k, name, f"{f_query:.6f}", f"{f_match:.6f}", f"{total:.6f}")
    first = {}
    for k, name, *_ in want:
        first.setdefault(name.split("@")[0], k)
    assert {r["species"]: r["first_round"] for r in run("candidates_full")} == first
    assert run_plain("detection_cumsum") == sorted(map(tuple, run("detection_full"))) and run_plain("candidates_first_seen") == sorted(map(tuple, run("candidates_full")))
    rest = cover(query, {n: hs for n, hs in genomes.items() if not n.startswith("src0@")}, 0.0)
    assert [tuple(r) for r in run("gather_excluding_full")] == [r[:4] for r in rest]
    assert run_plain("gather_excluding") == sorted(r[1:4] for r in rest)
    whole = cover(query, genomes, 0.0)
    assert [tuple(r)[1:] for r in run("gather_full")] == whole
    reads = {}
    for r in testmap.read_sketches(spark, SMALL).collect():
        reads.setdefault(str(r["query"]), set()).add(r["h"])
    per_read = sorted((q, *x) for q, hs in reads.items() for x in cover(hs, genomes, 0.05))
    assert sorted(tuple(r) for r in entry.queries()["gather_per_read"](spark, SMALL).collect()) == per_read
