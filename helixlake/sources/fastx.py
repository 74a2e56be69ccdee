"""Sequence files as DataFrames: sample_id, seq_id, sequence, qual."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _stem(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.gz)?$", 1)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records; Spark splits plain files, and a compressed file is one task.

    Records end where a line starts with >, so that mark may stand anywhere in a header.
    """
    text = spark.read.option("lineSep", "\n>").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    rows = text.select(F.regexp_replace("value", r"^\s*>", "").alias("value"), "path").where(F.trim("value") != "")  # only the first of a file keeps its mark
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)"), r"\s", "")
    return rows.select(_stem(F.col("path")).alias("sample_id"), F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.upper(seq).alias("sequence"), F.lit(None).cast("string").alias("qual"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """GenBank records, cut at the lines of their end marks, whatever ends a line."""
    rows = spark.read.option("lineSep", "\n//").text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.col("value").contains("LOCUS"))
    origin = F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    return rows.select(_stem(F.col("path")).alias("sample_id"), F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("seq_id"), F.upper(F.regexp_replace(origin, r"[^A-Za-z]", "")).alias("sequence"), F.lit(None).cast("string").alias("qual"))


#: Lines that are looked at to find where a record begins, and lines held at a time.
LOOKED_AT, HELD = 256, 40_000


def first_record(lines: list[str]) -> int:
    """The place of the first line of a record among lines cut out of a file, or their number if none begins."""

    def record(i: int) -> bool:
        part = lines[i : i + 4]
        return part[0].startswith("@") and (len(part) < 3 or part[2].startswith("+")) and (len(part) < 4 or len(part[1]) == len(part[3]))

    for start in range(min(4, len(lines))):
        if all(record(i) for i in range(start, min(len(lines), LOOKED_AT), 4)):
            return start
    return len(lines)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each split (path, start, line), and the lines before and after them with part 0 and 1."""
    names = ["path", "start", "part", "lines"]
    held: list[str] = []
    path, start, open_ = None, 0, False

    def rows(part: int, groups: list[list[str]]) -> pa.RecordBatch:
        n = len(groups)
        cols = [pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(groups, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def whole(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, open_
        if not open_:
            at = 0 if start == 0 else first_record(held)
            if at or last:
                yield rows(0, [held[:at]])
            held, open_ = held[at:], True
        full = len(held) // 4 * 4
        if full:
            yield rows(2, [held[i : i + 4] for i in range(0, full, 4)])
        held = held[full:]
        if last:
            yield rows(1, [held])

    for batch in batches:
        for p, s, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (p, s) != (path, start):
                if path is not None:
                    yield from whole(True)
                path, start, held, open_ = p, s, [], False
            if line.strip():
                held.append(line.rstrip("\r"))
            if len(held) >= HELD:
                yield from whole(False)
    if path is not None:
        yield from whole(True)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ records of four lines; blank lines don't count.

    Spark splits plain files at any line.  Each split finds where its first record begins
    and gives its whole records; the few lines before and after them, a row of each for a
    split, are put together in the order of the splits of a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    parts = lines.mapInArrow(_records, "path string, start long, part int, lines array<string>")
    inner = parts.where("part = 2").select("path", "lines")
    own = W.partitionBy("path").orderBy("start", "part")
    edges = parts.where("part < 2").groupBy("path", "start", "part").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    edges = edges.withColumn("run", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(own))  # a tail and the heads that follow it
    joined = edges.groupBy("path", "run").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "part", "lines"))), lambda x: x["lines"])).alias("lines"))
    cut = joined.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int")), lambda i: F.slice("lines", i * 4 + 1, 4))).alias("lines")).where(F.size("lines") > 0)
    line = lambda i: F.trim(F.coalesce(F.get("lines", F.lit(i)), F.lit("")))
    return inner.unionByName(cut).select(
        _stem(F.col("path")).alias("sample_id"), F.regexp_extract(line(0), r"^@?\s*(\S*)", 1).alias("seq_id"), F.upper(line(1)).alias("sequence"), line(3).alias("qual")
    )


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """The reader that a path's ending asks for."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".fq", ".fastq")):
        return read_fastq(spark, path)
    if name.endswith((".gb", ".gbff", ".gbk")):
        return read_genbank(spark, path)
    if name.endswith((".fa", ".fasta", ".fna")):
        return read_fasta(spark, path)
    raise ValueError(f"unknown kind of sequence file: {path}")
