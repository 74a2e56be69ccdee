"""Streams against the same tables made at once, after restarts and repeated batches."""

import random

from helixlake.operators import sketch as K
from helixlake.operators.mapping import annotate, mapping_from_tsv
from helixlake.streaming import incremental as I
from pyspark.sql import functions as F


def test_a_sketch_goes_on_after_a_restart(spark, tmp_path):
    """Each batch reads its own lines, looks hashes up in the state and writes the new ones; the table equals one made at once."""
    rng = random.Random(2)
    folder, table, checkpoint = (tmp_path / x for x in ("in", "out", "ck"))
    folder.mkdir()
    lines = ["".join(rng.choice("ACGTN" if i % 9 == 0 else "ACGT") for _ in range(80)) for i in range(60)]
    seen = []
    for part in range(4):
        (folder / f"{part}.txt").write_text("".join(x + "\n" for x in lines[part * 12 : part * 12 + 20]))  # parts overlap
        query = I.running_sketch(spark, str(folder), str(table), str(checkpoint), scaled=3)
        query.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
        rows = spark.read.parquet(str(table))
        want = K.sketch(spark.read.text(str(folder)).select(F.lit("s").alias("n"), F.col("value").alias("seq")), "seq", ["n"], 21, 3).select("h")
        assert sorted(r["h"] for r in rows.collect()) == sorted(r["h"] for r in want.collect())
        scans = [p["sources"] for p in query.recentProgress]
        assert all(len(s) == 1 for s in scans)  # the table itself is no source
        state = query.recentProgress[-1]["stateOperators"][0]
        assert state["numRowsTotal"] == rows.count()
    assert seen == [20, 20, 20, 20]
    I.running_sketch(spark, str(folder), str(table), str(checkpoint), scaled=3).awaitTermination()  # nothing new
    assert spark.read.parquet(str(table)).count() == want.count()


def test_annotation_counts_grow(spark, tmp_path):
    rng = random.Random(6)
    nodes = spark.createDataFrame([(f"f{i}", 100 + i) for i in range(20)], "nid string, length long")
    folder, table, checkpoint = (tmp_path / x for x in ("in", "out", "ck"))
    folder.mkdir()

    def more(part, families, n):
        text = [f"{k}\tr{k}\t<f{rng.choice(families)}>:{rng.randint(1, 60)}" if k % 5 else f"{k}\tr{k}" for k in range(n)]
        (folder / f"{part}.tsv").write_text("\n".join(text) + "\n")

    def same():
        mapping = mapping_from_tsv(spark.read.text(str(folder)), F.col("value")).where("mapped")
        want = {r["nid"]: (r["read_count"], r["kmer_count"], round(r["weight"], 9)) for r in annotate(mapping, nodes).where("read_count > 0").collect()}
        got = {r["family"]: (r["read_count"], r["kmer_count"], round(r["weight"], 9)) for r in I.annotation_so_far(spark, str(table)).collect()}
        assert got == want and len(got) > 3

    run = lambda: I.running_annotation(spark, str(folder), nodes, str(table), str(checkpoint)).awaitTermination()
    more(0, range(25), 200)  # some families are unknown
    run()
    same()
    more(1, range(3), 30)
    run()
    same()
    assert spark.read.parquet(str(table)).where("batch = 1").count() <= 3  # what changed alone
    before = sorted(p.name for p in checkpoint.joinpath("commits").iterdir() if p.name.isdigit())
    (checkpoint / "commits" / before[-1]).unlink()  # as if the driver had died before the end of the batch
    crc = checkpoint / "commits" / f".{before[-1]}.crc"
    crc.unlink(missing_ok=True)
    run()
    same()
    I.compacted(spark, str(table))
    same()
    assert [p.name for p in table.iterdir() if p.name.startswith("batch=")] == ["batch=1"]
    more(2, range(8, 12), 40)
    run()
    same()
