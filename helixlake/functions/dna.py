"""Column expressions and row generators for nucleotide sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .murmur import murmur_hex

#: Hexadecimal digits of a k-mer's hash that are kept: 60 bits.
DIGITS = 15


#: The base of each byte that is a letter, else 0.
_BASE = np.zeros(256, np.uint8)
for _i in range(26):
    _BASE[ord("a") + _i] = _BASE[ord("A") + _i] = ord("ACGT"[_i % 4])
#: The two other letters whose lower case is one of a to z, in UTF-8.
_FOLDED = (("\u0130".encode(), "i"), ("\u212a".encode(), "k"))


def projected(values: pa.Array) -> pa.Array:
    """project_dna() of an array of texts, all their bytes at once."""
    texts = values.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bases = _BASE[data]
    for spelled, letter in _FOLDED:
        at = np.flatnonzero(data[: len(data) - len(spelled) + 1] == spelled[0])
        for i, byte in enumerate(spelled[1:], 1):
            at = at[data[at + i] == byte]
        bases[at] = _BASE[ord(letter)]
    held = bases != 0
    ends, some = np.zeros(len(texts) + 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(some):
        ends[some + 1] = np.add.reduceat(held, offsets[some] - offsets[0], dtype=np.int64)
    ends = np.cumsum(ends)
    made = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(bases[held])])
    return pa.compute.if_else(texts.is_valid(), made, pa.scalar(None, pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def project_dna(text: Column) -> Column:
    """Any text as a sequence over ACGT: letters, in lower case, map to the four bases in turn, all else goes.

    Arrow batches are mapped byte by byte; translate() and regexp_replace() take many times as long, a letter each.
    """

    @F.arrow_udf("string")
    def project(values: pa.Array) -> pa.Array:
        return projected(values)

    return project(text)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it scans files that leave some idle; other plans stay, as to count theirs would run them.

    That is so where files give fewer partitions than cores, and where a Parquet file of few row
    groups is cut into more: rows of a group are all read by the task that has its middle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter", "ArrowEvalPython") and node.children().size() == 1:
        node = node.children().apply(0)
    if node.nodeName() != "LogicalRelation":
        return df
    parts = df.rdd.getNumPartitions()
    if parts >= wanted and not (node.toString().strip().endswith("parquet") and crowded(df, wanted)):
        return df
    return df.repartition(max(wanted, parts))


def crowded(df: DataFrame, tasks: int) -> bool:
    """Whether a partition of Parquet files has more than twice the rows that each of so many tasks would have; only the files' footers are read."""
    most, total = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return bool(total) and most * tasks > 2 * total


#: Bases of a sequence whose positions become rows together.
PIECE = 1 << 16


def kmers(seqs: DataFrame, seq_col: str, k: int, keep: list[str], canonical: bool = True, piece: int = PIECE) -> DataFrame:
    """keep, pos and kmer (binary) of every k-mer that holds A, C, G and T alone.

    A sequence is cut into pieces that overlap by k - 1, so no row holds the positions of
    a whole chromosome.  Positions are cut from binary columns, where a substring costs
    its own length; the reverse complement is made once for a piece and read from its end.
    """
    whole = seqs.where(F.length(seq_col) >= k).select(*keep, F.upper(seq_col).cast("binary").alias("_all"))
    cut = whole.select(*keep, "_all", F.explode(F.sequence(F.lit(0), F.length("_all") - k, F.lit(piece))).alias("_from"))
    base = cut.select(*keep, "_from", F.expr(f"substring(_all, _from + 1, {piece + k - 1})").alias("_fwd"))
    base = base.select(*keep, "_from", "_fwd", reverse_complement(F.col("_fwd").cast("string")).cast("binary").alias("_rev"))  # a projection of its own, below the rows of positions
    rows = base.withColumn("_n", F.length("_fwd")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - k)).alias("_at"))
    forward = F.expr(f"substring(_fwd, _at + 1, {k})")
    backward = F.expr(f"substring(_rev, _n - {k} - _at + 1, {k})")
    made = rows.select(*keep, (F.col("_from") + F.col("_at")).alias("pos"), (F.least(forward, backward) if canonical else forward).alias("kmer"))
    return made.where(F.col("kmer").cast("string").rlike("^[ACGT]+$"))


def hashed(kmer: Column, method: str = "md5") -> Column:
    """A k-mer's hash: 15 hex digits of md5 (equal in any engine) or of xxhash64 (fast), or the 16 of murmur3 (seed 42, other tools')."""
    if method == "md5":
        return F.substring(F.md5(kmer), 1, DIGITS)
    if method == "xxhash64":
        return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(kmer))), 16, "0"), 1, DIGITS)
    if method == "murmur3":
        return murmur_hex(kmer)
    raise ValueError(f"unknown hash {method!r}")


def threshold(scaled: int, method: str = "md5") -> str:
    """The hash below which a k-mer is sampled, one in `scaled`, as hex digits."""
    digits = 16 if method == "murmur3" else DIGITS
    return format(16**digits // scaled, f"0{digits}x") if scaled > 1 else "g"
