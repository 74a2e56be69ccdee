"""Ranked search against plain scores of all documents, its index, and the query's SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helixlake.llm import ranked_search as R
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain_search(docs, items, top):
    """(item_id, rank, doc_id, score), all documents scored for each item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(c.total() for _, c in counts)
    df = Counter(x for _, c in counts for x in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 90 + (90 * c.total() * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in set(terms(text)) if c[x])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(13)
    stock = ["".join(rng.choice("abcXYé中9") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    text = lambda n: rng.choice([" ", ", ", "\n", "_-"]).join(rng.choices(stock, weights, k=n))
    docs = [(k * 7 % 1009 - 20, text(rng.choice([1, 3, 30, 200]))) for k in range(400)]
    docs += [(2000 + k, "the same words here") for k in range(30)] + [(3000, None), (3001, ""), (3002, " .,!"), (3003, text(40_000)), (3004, "É é ﬁ Ⅷ"), (5, "a b c"), (5, "a b c"), (None, "the same words here"), (None, "lone word")]
    items = [(k, text(rng.choice([1, 5, 60]))) for k in range(40)] + [(100, None), (101, ""), (102, "nowhere"), (103, "the SAME words HERE"), (103, "lone"), (None, "é ﬁ"), (104, docs[-7][1]), (105, text(3000))]
    return docs, items


@pytest.mark.parametrize(("shard", "top"), [(1, 10), (7, 10), (64, 1), (64, 10), (64, 1000), (8192, 1), (8192, 10), (8192, 1000)])
def test_search_against_plain_scores(spark, tables, shard, top, monkeypatch):
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    monkeypatch.setattr(R, "BLOCK_ITEMS", 17)
    docs, items = tables
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "terms", "item", "a.b")}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    got = R.ranked(given, asked, top)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_search(docs, items, top)


def test_index_holds_all_postings(spark, tables, monkeypatch):
    monkeypatch.setattr(R, "SHARD_BYTES", 3000)
    docs, _ = tables
    rows = R.build_index(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) > 10
    got, have = Counter(), Counter((i, t, n) for i, text in docs for t, n in Counter(terms(text)).items())
    for r in rows:
        assert r["ids"] == sorted(r["ids"], key=lambda i: (i is None, i or 0))
        at = 0
        for t, df, end in zip(bytes(r["terms"]).split(b" "), np.frombuffer(r["dfs"], "<u4"), np.frombuffer(r["ends"], "<u4"), strict=False):
            values = R.unsqueezed(np.frombuffer(r["postings"], np.uint8)[at:end])
            at = end
            assert len(values) == 2 * df
            got.update((r["ids"][d], t.decode(), int(n)) for d, n in zip(np.cumsum(values[::2]), values[1::2], strict=True))
    assert got == have
    assert sum(r["n_docs"] for r in rows) == sum(bool(terms(t)) for _, t in docs) and sum(r["n_terms"] for r in rows) == sum(len(terms(t)) for _, t in docs)


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**35, 2**62])
    raw, start = R.squeezed(values)
    assert R.unsqueezed(np.frombuffer(raw, np.uint8)).tolist() == values.tolist() and start[3] == 3


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    want = R.term_counts(text)
    monkeypatch.setattr(R, "STEP", 11)
    assert R.term_counts(text) == want and R.term_counts("x" * 100) == Counter({b"x" * 100: 1})


def test_empty_tables(spark, tables):
    docs, items = tables
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert R.ranked(none[0], spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert R.ranked(spark.createDataFrame(docs, "doc_id long, text string"), none[1]).collect() == []


@pytest.mark.parametrize("table", ["small", "awkward"])
def test_query_and_sql(spark, tables, tmp_path, table):
    folder, last = SMALL, ""
    docs, items = [[r for r in t if r[0] is not None and r[0] not in (5, 103)] for t in tables]
    if table == "awkward":
        folder, last = str(tmp_path), "/*.parquet"
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    else:
        docs, items = [[tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))]
    got = R.op13_ranked_search(spark, folder)
    con = duckdb.connect()
    for t in "documents", "benchmark":
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{last}'")
    want = con.execute(R.OP13_SQL)
    assert [c[0] for c in want.description] == got.columns == ["item_id", "rank", "doc_id", "score"]
    have = sorted([tuple(r) for r in got.collect()], key=repr)
    assert have == sorted(want.fetchall(), key=repr) == plain_search(docs, items, 10)
