"""The manifest against a plain tree, its SQL, and on awkward tables."""

import hashlib
import random
import zlib

import duckdb
import pytest
from helixlake.llm import merkle
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    return [("<" if at >> k & 1 else ">") + row[(at >> k) ^ 1] if (at >> k) ^ 1 < len(row) else "" for k, row in enumerate(tree[:-1])]


def fold(leaf, proof):
    for s in proof:
        leaf = sha(s[1:], leaf) if s.startswith("<") else sha(leaf, s[1:])
    return leaf


def plain_manifest(rows):
    """(doc_id, leaf, claimed, proof, subroot, root) of each row."""
    by_lang = {}
    for r in rows:
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        by_lang.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)), plain_leaf(r, changed)))
    names = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([k[2] for k, _ in sorted(by_lang[g])]) for g in names}
    crown = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for pos, (key, claimed) in enumerate(sorted(by_lang[g])):
            out.append((key[1] if key[0] else None, key[2], claimed, path(trees[g], pos) + path(crown, at), trees[g][-1][0], crown[-1][0]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    langs = ["en"] * 30 + ["de"] * 9 + ["é", "", None, None, "-", "=", "zz", "a\tb"]
    out = [{"doc_id": rng.randint(0, 10**9), "source": rng.choice(["s", None, ""]), "lang": rng.choice(langs), "n_chars": rng.choice([None, 5, 10**12]), "text": rng.choice([None, "", "text é 中", "x" * 40_000, f"t{k}"])} for k in range(150)]
    once = {"doc_id": 7, "source": "s", "lang": "only", "n_chars": 1, "text": "lone"}
    repeats = [{"doc_id": 5, "source": "s", "lang": "en", "n_chars": 1, "text": t} for t in ("b", "a", "a")]
    return [*out, once, *repeats, {"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}, {"doc_id": None, "source": "s", "lang": "de", "n_chars": 3, "text": "abc"}]


@pytest.mark.parametrize("n", [*range(1, 20), 31, 32, 33, 100])
def test_traversal_gives_every_path(n):
    leaves = [sha(str(i)) for i in range(n)]
    tree, raw = plain_tree(leaves), [x.encode() for x in leaves]
    for more in 0, 3:  # a block below a taller tree goes up without partners
        height = merkle.levels(n, 12) + more
        top = tree[-1][0]
        for _ in range(more):
            top = sha(top)
        assert merkle.treehash(raw, height).decode() == top
        assert list(merkle.traverse(raw, height)) == [path(tree, i) + [""] * more for i in range(n)]


@pytest.mark.parametrize("bits", [2, 12])
def test_manifest_against_plain_tree(spark, rows, bits):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("g", "pos", "n", "digest", "block", "a.b")})
    changed = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    claims = merkle.digest([F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(c) for c in merkle.COLUMNS])
    found = merkle.manifest(docs.repartition(5), claims=claims, bits=bits)
    got = [tuple(r) for r in found.select("doc_id", "leaf", "claimed", "proof", "subroot", "root", merkle.folded(F.col("claimed"), F.col("proof")).alias("folded")).collect()]
    want = [(*r, fold(r[2], r[3])) for r in plain_manifest(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(merkle_root == folded for _, leaf, claimed, _, _, merkle_root, folded in want if leaf == claimed)
    assert any(leaf != claimed for _, leaf, claimed, *_ in want) and not any(r[5] == r[6] for r in want if r[1] != r[2])


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_ranges_that_are_not_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_RANGES", 0)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert {r["root"] for r in merkle.manifest(docs, bits=3).collect()} == {plain_manifest(rows)[0][5]}


@pytest.mark.parametrize("table", ["small", "awkward"])
def test_query_and_sql(spark, rows, tmp_path, table):
    folder = SMALL
    if table == "awkward":
        folder = str(tmp_path)
        spark.createDataFrame([tuple(r.values()) for r in rows if r["doc_id"] is not None], SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if table == 'awkward' else ''}'")
    want = con.execute(merkle.OP11_SQL).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))
    given = spark.read.parquet(f"{folder}/documents.parquet").collect()
    plain = [(i, leaf, sub, root, sha(*[s[1:] for s in proof]), fold(claimed, proof), fold(claimed, proof) == root) for i, leaf, claimed, proof, sub, root in plain_manifest([r.asDict() for r in given])]
    assert sorted(map(tuple, got[["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]].values.tolist())) == sorted(plain)
