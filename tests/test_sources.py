"""Sequence files, lists, parsing and catalogue records."""

import gzip
import json
import random

import pytest
from helixlake.functions import parsing as X
from helixlake.functions.dna import kmers
from helixlake.operators import sketch as K
from helixlake.operators.mapping import annotate, annotation_report, mapping_from_tsv
from helixlake.operators.search import gather, search
from helixlake.sources import catalog, discover, dumps, fastx
from helixlake.streaming.incremental import running_sketch
from pyspark.sql import functions as F


def test_fasta_fastq_genbank(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one x\nACGT\nACGT\n>two\nTTTT\n")
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1 a\nACGT\n+\nIIII\n@r2\nGGGG\n+\n@III\n")
    (tmp_path / "h.gbff").write_text("LOCUS       X1  8 bp\nORIGIN\n        1 acgtac gt\n//\nLOCUS       X2 4 bp\nORIGIN\n        1 tttt\n//\n")
    read = lambda name: {(r["seq_id"], r["sequence"], r["qual"]) for r in fastx.read_sequences(spark, str(tmp_path / name)).collect()}
    assert read("g.fa") == {("one", "ACGTACGT", None), ("two", "TTTT", None)}
    assert read("r.fastq.gz") == {("r1", "ACGT", "IIII"), ("r2", "GGGG", "@III")}
    assert read("h.gbff") == {("X1", "ACGTACGT", None), ("X2", "TTTT", None)}
    with pytest.raises(ValueError):
        fastx.read_sequences(spark, "x.txt")


def test_scans_of_odd_files(spark, tmp_path):
    """Marks inside headers, foreign line ends, qualities that look like headers, and splits at any line."""
    rng = random.Random(33)
    (tmp_path / "odd.fna").write_bytes(b">one > two >three\r\nAC\r\nGT\r\n>four\r\n\r\nTT\r\n")
    got = {(r["seq_id"], r["sequence"]) for r in fastx.read_fasta(spark, str(tmp_path / "odd.fna")).collect()}
    assert got == {("one", "ACGT"), ("four", "TT")}
    (tmp_path / "odd.gbk").write_bytes(b"LOCUS X1 4 bp\r\nCOMMENT http://a//b\r\nORIGIN\r\n 1 acgt\r\n//\r\nLOCUS X2 2 bp\r\nORIGIN\r\n 1 tt\r\n//\r\n")
    assert {(r["seq_id"], r["sequence"]) for r in fastx.read_genbank(spark, str(tmp_path / "odd.gbk")).collect()} == {("X1", "ACGT"), ("X2", "TT")}
    want, text = [], []
    for i in range(400):
        n = rng.randint(1, 60)
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("@+IF#5") for _ in range(n))
        want.append((f"r{i}", seq, qual))
        text.append(f"@r{i} x\n{seq}\n+{'r' + str(i) if i % 3 else ''}\n{qual}\n")
    (tmp_path / "reads.fq").write_text("".join(text) + "\n")
    with gzip.open(tmp_path / "reads.fq.gz", "wt") as f:
        f.write("".join(text))
    read = lambda name: sorted((r["seq_id"], r["sequence"], r["qual"]) for r in fastx.read_fastq(spark, str(tmp_path / name)).collect())
    assert read("reads.fq.gz") == sorted(want)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (150, 333, 4096):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            assert read("reads.fq") == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_kmers_of_a_long_sequence(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGTN") if rng.random() < 0.02 else rng.choice("ACGT") for _ in range(3000))
    docs = spark.createDataFrame([("a", seq), ("b", seq[:21]), ("c", seq[:20])], "name string, seq string")
    flip = str.maketrans("ACGT", "TGCA")
    want = {(n, i, min(s[i : i + 21], s[i : i + 21][::-1].translate(flip))) for n, s in (("a", seq), ("b", seq[:21])) for i in range(len(s) - 20) if "N" not in s[i : i + 21]}
    for piece in (1, 37, 1 << 16):
        got = kmers(docs, "seq", 21, ["name"], piece=piece).select("name", "pos", F.col("kmer").cast("string")).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_requests():
    names = {4: "s__Kt", 9: "s__Mz"}
    assert catalog.requested(" 9, s__Kt,,4 ,s__Mz", names) == ["s__Mz", "s__Kt"] and catalog.requested("", names) == []
    for bad in ("5", "s__Rq"):
        with pytest.raises(ValueError):
            catalog.requested(bad, names)


def test_bank_lines(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    assert {tuple(r) for r in discover.bank_lines(lines("p1 a.fa b.fa", "", "p2\tc.fa")).collect()} == {("p1", "a.fa"), ("p1", "b.fa"), ("p2", "c.fa")}
    for bad in (("p1",), ("p1 a", "p1 b")):
        with pytest.raises(Exception, match="a line has no path|an id is given twice"):
            discover.bank_lines(lines(*bad)).collect()
    for name in "ab":
        (tmp_path / f"{name}.fa").write_text(">x\nA\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fa\n\n {tmp_path}/b.fa \n")
    assert [r["path"] for r in discover.file_of_files(spark, str(tmp_path / "list.txt")).collect()] == [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"]
    (tmp_path / "list.txt").write_text(f"{tmp_path}/c.fa\n")
    with pytest.raises(FileNotFoundError):
        discover.file_of_files(spark, str(tmp_path / "list.txt"))


def test_specs_read_back(spark):
    """Every spec that can be put together gives its parts back; what has a part too many or an empty one is an error."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("kmnrtz_-.7") for _ in range(rng.randint(1, 6)))
    want = [(word(), rng.choice([None, word()]), rng.choice([None, word()])) for _ in range(60)]
    specs = [n + (f"@{v}" if v else "") + (f":{m}" if m else "") for n, v, m in want]
    c = X.checked_spec(F.col("s"))
    got = spark.createDataFrame([(s,) for s in specs], "s string").select(X.collection_name(c), X.collection_version(c), X.collection_member(c)).collect()
    assert [tuple(r) for r in got] == [(n, v or "latest", m) for n, v, m in want]
    for bad in ("kmn@1:a:b", "kmn:a:b", "kmn@", "kmn@:a", "", "kmn:", "k@1@2"):
        with pytest.raises(Exception, match="not a collection spec"):
            spark.createDataFrame([(bad,)], "s string").select(c).collect()


def test_scalar_parsing(spark):
    def told(values, column):
        return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]

    def kind(text):
        for of in (int, float):
            try:
                of(text)
                return of.__name__
            except ValueError:
                pass
        return "str"

    values = ["0", "-17", "+5", "6.25", "1e3", "-.5", "7 apples", "", "0x1f", "12,5", "north"]
    assert told(values, X.value_kind) == [kind(v) for v in values]
    names = [f"/bank/s{i}{a}{b}" for i, (a, b) in enumerate((a, b) for a in (".FNA", ".fq", ".fastq", ".fasta", ".fa", ".gbff", ".tsv", "") for b in ("", ".gz"))]
    fastx = lambda n: n.lower().removesuffix(".gz").rsplit(".", 1)[-1] in X.FASTX
    assert told(names, X.is_fastx) == [fastx(n) for n in names]
    assert told(["Persistent", "S", "cloud", "shell", "P", "unknown"], X.partition_colour) == [X.COLOURS[k] for k in ("P", "S", "C", "S", "P", "other")]
    labels = [(f"<g{i}{':x' * (i % 2)}>", 3 * i) for i in range(4)]
    assert told([f"{n}:{h}" for n, h in labels], X.label_family) == [n[1:-1] for n, _ in labels]
    assert told([f"{n}:{h}" for n, h in labels], X.label_hits) == [h for _, h in labels]
    assert told([" kt , mz,, ", "*", None, " * "], X.include_list) == [["kt", "mz"], None, None, None]
    assert told(["/bank/sp9/iso3.fna"], lambda c: X.signature_name(F.lit("sp9"), c)) == ["sp9@iso3"]
    assert told(["/bank/iso3/contigs.fna"], lambda c: X.signature_name(F.lit("sp9"), c, True)) == ["sp9@iso3"]
    sizes = [0, 1023, 1024, 5 * 1024**2 // 2, 7 * 1024**3, 3 * 1024**4]
    assert told(map(str, sizes), lambda c: X.human_size(c.cast("double"))) == ["0.0 B", "1023.0 B", "1.0 KB", "2.5 MB", "7.0 GB", "3.0 TB"]


def test_catalogue(spark):
    text = json.dumps({"name": "X", "id": 1, "releases": [{"version": v, "latest": v == "2.0.0", "pangenome_count": 3} for v in ("2.0.0", "1.0.0", "v10.0.0")]})
    rows = catalog.releases(spark.createDataFrame([(text,)], "j string"), "j")
    assert [r["version"] for r in rows.collect()] == ["1.0.0", "2.0.0", "v10.0.0"]
    assert catalog.latest(rows).first()["version"] == "v10.0.0"
    plan = catalog.fetch_plan(spark.createDataFrame([("a",), ("b",)], "label string"), spark.createDataFrame([("a",)], "label string"))
    assert {tuple(r) for r in plan.collect()} == {("a", "present"), ("b", "fetch")}


def test_mapping_tsv(spark):
    lines = spark.createDataFrame([("0\tr\t<fam0>:79\t<fam1>:3",), ("1\tr\t<fam0>:29",), ("2\tr\t<fam1>:10",), ("3\tr",), ("4\tr\t<what>:5",)], "line string")
    nodes = spark.createDataFrame([("fam0", 100), ("fam1", 100)], "nid string, length int")
    mapping = mapping_from_tsv(lines, F.col("line"))
    row = {r["nid"]: r for r in annotate(mapping.where("mapped"), nodes).collect()}
    assert row["fam0"]["read_count"] == 2 and row["fam0"]["kmer_count"] == 108 and abs(row["fam0"]["weight"] - 1.5) < 1e-12
    report = annotation_report(mapping, nodes).first()
    assert (report["total_seq"], report["total_seq_mapped"]) == (5, 3)


def test_sketches(spark):
    random.seed(5)
    base = "".join(random.choice("ACGT") for _ in range(3000))
    flip = str.maketrans("ACGT", "TGCA")
    rows = [("pan1@a", base), ("pan1@rc", base[::-1].translate(flip)), ("pan2@b", "".join(random.choice("ACGT") for _ in range(3000))), ("short", "ACGT"), ("odd", "N" * 50)]
    seqs = spark.createDataFrame(rows, "name string, seq string")
    sk = K.sketch(seqs, "seq", ["name"], 21, 10).persist()
    held = {n: {r["h"] for r in sk.where(F.col("name") == n).collect()} for n, _ in rows}
    assert held["pan1@a"] and held["pan1@a"] == held["pan1@rc"] and not held["short"] and not held["odd"]
    assert sk.count() == K.sketch(seqs.repartition(3), "seq", ["name"], 21, 10).count()
    assert K.sketch(seqs, "seq", ["name"], 21, n=7).where("name = 'pan2@b'").count() == 7
    query = sk.where("name = 'pan1@a'").select(F.lit("q").alias("query"), "h")
    top = {r["name"]: r for r in search(query, sk, "containment", 0.01).collect()}
    assert top["pan1@a"]["score"] == 1.0 and top["pan1@a"]["coverage"] == 1.0 and "pan2@b" not in top
    cover = gather(query, sk, 0.05).collect()
    assert [(r["name"], r["f_query"]) for r in cover] == [("pan1@a", 1.0)]
    with pytest.raises(ValueError):
        search(query, sk, "cosine")


def test_dumps(spark, tmp_path):
    genes = spark.createDataFrame([("f1", "MK"), ("f1", "MK"), ("f2", "ML")], "family string, sequence string")
    assert sorted(r[0] for r in dumps.family_records(genes).collect()) == [">f1\nMK", ">f2\nML"]
    dumps.write_fasta(dumps.family_records(genes), str(tmp_path / "out"), compress=True)
    assert list((tmp_path / "out").glob("*.gz"))


def test_running_sketch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("ACGTACGTACGTACGTACGTACGTAAAA\n" * 2)
    q = running_sketch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), scaled=1)
    q.awaitTermination()
    (tmp_path / "in/b.txt").write_text("ACGTACGTACGTACGTACGTACGTCCCC\n")
    running_sketch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), scaled=1).awaitTermination()
    lines = spark.read.text(str(tmp_path / "in")).selectExpr("'sample' as name", "value as seq")
    want = {r["h"] for r in K.sketch(lines, "seq", ["name"], 21, 1).collect()}
    assert {r["h"] for r in spark.read.parquet(str(tmp_path / "out")).select("h").distinct().collect()} == want


def plain_murmur(data, seed):
    """The published definition, one value at a time."""
    full = (1 << 64) - 1
    turn = lambda x, r: (x << r | x >> (64 - r)) & full
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F

    def last(k):
        k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & full
        k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & full
        return k ^ k >> 33

    h1 = h2 = seed
    n = len(data) // 16
    for i in range(n):
        k1, k2 = (int.from_bytes(data[16 * i + j : 16 * i + j + 8], "little") for j in (0, 8))
        h1 ^= turn(k1 * c1 & full, 31) * c2 & full
        h1 = ((turn(h1, 27) + h2) * 5 + 0x52DCE729) & full
        h2 ^= turn(k2 * c2 & full, 33) * c1 & full
        h2 = ((turn(h2, 31) + h1) * 5 + 0x38495AB5) & full
    tail = data[16 * n :]
    h2 ^= turn(int.from_bytes(tail[8:], "little") * c2 & full, 33) * c1 & full
    h1 ^= turn(int.from_bytes(tail[:8], "little") * c1 & full, 31) * c2 & full
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & full
    h2 = (h2 + h1) & full
    h1, h2 = last(h1), last(h2)
    h1 = (h1 + h2) & full
    return h1, (h2 + h1) & full


def test_murmur3(spark):
    import numpy as np
    from helixlake.functions import murmur

    vectors = {b"": (0, 0), b"hello": (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19), b"The quick brown fox jumps over the lazy dog": (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)}
    for data, want in vectors.items():  # published values, seed 0
        rows = np.frombuffer(data, np.uint8).reshape(1, len(data))
        assert plain_murmur(data, 0) == want == tuple(int(x[0]) for x in murmur.murmur3(rows, 0))
    rng = random.Random(5)
    values = [bytes(rng.randrange(256) for _ in range(n)) for n in range(70) for _ in range(3)]
    assert murmur.first_halves(values).tolist() == [plain_murmur(v, 42)[0] for v in values]
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    docs = spark.createDataFrame([("a", seq), ("b", seq[:30]), ("c", None)], "name string, seq string")
    flip = str.maketrans("ACGT", "TGCA")
    want = {(n, format(plain_murmur(min(k, k[::-1].translate(flip)).encode(), 42)[0], "016x")) for n, s in (("a", seq), ("b", seq[:30])) for i in range(len(s) - 20) for k in [s[i : i + 21]]}
    got = {tuple(r) for r in K.sketch(docs, "seq", ["name"], 21, 4, method="murmur3").collect()}
    assert got == {(n, h) for n, h in want if int(h, 16) < 2**64 // 4} and len(got) > 40
    assert K.sketch(docs, "seq", ["name"], 21, 1, 5, method="murmur3").count() == 10
