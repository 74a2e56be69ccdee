"""The data source of sequence files against the readers, in partitions of any size."""

import gzip
import random
import struct
import zlib

import pytest
from helixlake.sources import datasource, fastx


def blocked(data, sizes):
    """Blocked gzip: members of at most 64 kB that tell their own size, and an empty one at the end."""
    out, at = [], 0
    while at < len(data) or not out or at is None:
        n = next(sizes)
        part = data[at : at + n]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
        at += n
    out.append(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
    return b"".join(out)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = random.Random(23)
    folder = tmp_path_factory.mktemp("fastx")
    fastq, fasta = [], []
    for i in range(300):
        n = rng.randint(1, 70)
        seq, qual = "".join(rng.choice("ACGTNacgt") for _ in range(n)), "".join(rng.choice("@+IF#5>") for _ in range(n))
        fastq.append(f"@r{i} x y\n{seq}\n+\n{qual}\n" + "\n" * (i % 17 == 0))
        fasta.append(f">s{i} > not a record\r\n" + "".join(seq[k : k + 20] + "\r\n" for k in range(0, n, 20)) + "\r\n" * (i % 13 == 0))
    q, a = "".join(fastq).encode(), "".join(fasta).encode()
    (folder / "r.fq").write_bytes(q)
    (folder / "a.fna").write_bytes(a)
    (folder / "z.fastq.gz").write_bytes(gzip.compress(q))
    (folder / "m.fa.gz").write_bytes(gzip.compress(a[:5000]) + gzip.compress(a[5000:]))
    (folder / "b.fq.gz").write_bytes(blocked(q, iter(lambda: rng.randint(1, 400), None)))
    (folder / "c.fa.gz").write_bytes(blocked(a, iter(lambda: rng.randint(1, 900), None)))
    (folder / "none.fa").write_bytes(b"")
    (folder / "end.fq").write_bytes(b"@only\nAC\n+\nII")
    return folder


@pytest.mark.parametrize("name", ["r.fq", "a.fna", "z.fastq.gz", "m.fa.gz", "b.fq.gz", "c.fa.gz", "none.fa", "end.fq"])
@pytest.mark.parametrize("size", [97, 1500, 1 << 25])
def test_equal_to_the_readers(spark, files, name, size):
    datasource.register(spark)
    if size == 97 and name[0] in "rabc":
        size = 499
    df = spark.read.format("fastx").option("splitBytes", size).load(str(files / name))
    want = sorted(map(tuple, fastx.read_sequences(spark, str(files / name)).collect()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want and df.columns == ["sample_id", "seq_id", "sequence", "qual"]
    assert len(want) == {"none.fa": 0, "end.fq": 1}.get(name, 300)
    if size < 2000 and name in ("r.fq", "a.fna", "b.fq.gz", "c.fa.gz"):
        assert df.rdd.getNumPartitions() > 5


def test_folders_patterns_and_columns(spark, files):
    datasource.register(spark)
    read = spark.read.format("fastx")
    assert read.load(str(files)).count() == 6 * 300 + 1
    assert read.load(f"{files}/*.fq, {files}/a.fna").count() == 601
    assert read.load(f"file://{files}/[ac].f*").select("sample_id").distinct().count() == 2
    some = read.schema("seq_id string, sample_id string").load(str(files / "r.fq"))
    assert some.columns == ["seq_id", "sample_id"] and some.first()["sample_id"] == "r.fq"
    with pytest.raises(Exception, match="no such columns"):
        read.schema("wrong string").load(str(files / "r.fq")).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("fastx").load(str(files / "x.fa")).collect()
