"""Sketches: sampled sets of k-mer hashes, in long form (one row for each hash)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import codes as C
from ..functions.dna import DIGITS, hashed, kmers, spread, threshold

#: Hashes that a task hands on together.
ROWS_OUT = 1 << 16


def fast(k: int, method: str) -> bool:
    """Whether k-mers are hashed as numbers, in Arrow batches, and not row by row."""
    return k <= C.MOST_K and method in ("md5", "murmur3")


def least_by_row(rows: np.ndarray, found: np.ndarray, n: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a row and a hash; the n least hashes of each row if n is given."""
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    rows, found = rows[new], found[new]
    if n:
        few = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
        rows, found = rows[few], found[few]
    return rows, found


def hashed_rows(seqs: DataFrame, seq_col: str, keys: list[str], k: int, method: str, keep: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """keys and h of the k-mers of each sequence; keep(rows, hashes) thins those of a block of positions before any leaves its task, wanted(k-mers) before any is hashed."""
    source = spread(seqs.select(*keys, F.col(seq_col).alias("_seq")))
    digits = 16 if method == "murmur3" else DIGITS
    schema = seqs.select(*keys).schema.add("h", StringType())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []

            def out(batch=batch, rows=rows, found=found) -> pa.RecordBatch:
                at = pa.array(np.concatenate(rows))
                columns = [batch.column(i).take(at) for i in range(len(keys))]
                return pa.RecordBatch.from_arrays([*columns, C.hex_digits(np.concatenate(found), digits)], names=[*keys, "h"])

            for at, numbers in C.kmers_of(batch.column(len(keys)), k, wanted):
                at, values = keep(at, C.hashes(numbers, k, method))
                rows.append(at)
                found.append(values)
                if sum(map(len, rows)) >= ROWS_OUT:
                    yield out()
                    rows.clear()
                    found.clear()
            if sum(map(len, rows)):
                yield out()

    return source.mapInArrow(made, schema)


#: First bits of a hash that a table of known ones has: a bit for each, 64 in a word.
PREFIX = 26


def known_prefixes(hashes: DataFrame) -> np.ndarray:
    """A bit for each of the first PREFIX bits of hashes (h): 8 MB, however many hashes there are."""
    first = F.shiftright(F.conv(F.substring("h", 1, 7), 16, 10).cast("bigint"), 28 - PREFIX)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), first.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(F.shiftright(first, 6).alias("word"), bit.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (PREFIX - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


#: With a larger share of its words in use, a table is looked up at once.
FEW_WORDS = 0.25


def known_words(table: np.ndarray) -> np.ndarray | None:
    """Which words of a table of known_prefixes() hold a bit: 1 MB, which a core's cache holds; None if too many do to tell much."""
    used = table != 0
    return used if used.mean() <= FEW_WORDS else None


def may_hold(table: np.ndarray, values: np.ndarray, digits: int = DIGITS, words: np.ndarray | None = None) -> np.ndarray:
    """Whether a table of known_prefixes() has the first bits of hashes of so many digits; with known_words() of the table, only those whose word is in use are looked up in it."""
    if words is not None:
        out = words[(values >> np.uint64(4 * digits - PREFIX + 6)).astype(np.intp)]
        at = np.flatnonzero(out)
        out[at] = may_hold(table, values[at], digits)
        return out
    first = values >> np.uint64(4 * digits - PREFIX)
    return (table[(first >> np.uint64(6)).astype(np.intp)] >> (first & np.uint64(63)) & np.uint64(1)).astype(bool)


def sketch(seqs: DataFrame, seq_col: str, keys: list[str], k: int = 21, scaled: int = 1000, n: int = 0, method: str = "md5", min_count: int = 1, within: DataFrame | None = None, buckets: int = 0) -> DataFrame:
    """keys and h: distinct hashes below the sampling bound, or the n smallest if n is given.

    The bound is applied before any shuffle, and so is n: a task hands on the n smallest of
    a sequence's block.  The distinct combines on the map side.  With min_count, a k-mer
    has to occur that often among the rows of its keys.  `within` (h) leaves of the
    result what is known there; nearly all else falls in the task that hashes it.  With
    buckets (and no n) rows are dealt by hash over so many partitions, and lie so afterwards.
    """
    if fast(k, method):
        bound = int(threshold(scaled, method), 16) if not n and scaled > 1 else None
        digits = 16 if method == "murmur3" else DIGITS
        known = None if within is None or n else seqs.sparkSession.sparkContext.broadcast(known_prefixes(within))

        def keep(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if bound is not None:
                below = values < np.uint64(bound)
                at, values = at[below], values[below]
            if known is not None:
                had = may_hold(known.value, values, digits)
                at, values = at[had], values[had]
            return least_by_row(at, values, n) if min_count <= 1 else (at, values)

        rows = hashed_rows(seqs, seq_col, keys, k, method, keep)
    else:
        h = hashed(F.col("kmer"), method)
        rows = kmers(spread(seqs.select(*keys, seq_col)), seq_col, k, keys).select(*keys, h.alias("h"))
        if not n:
            rows = rows.where(F.col("h") < threshold(scaled, method))
    if within is not None and not n:
        rows = rows.join(within.select("h").distinct(), "h", "left_semi").select(*keys, "h")
    if buckets and not n:
        rows = rows.repartition(buckets, "h")
    rows = rows.distinct() if min_count <= 1 else rows.groupBy(*keys, "h").agg(F.count("*").alias("_c")).where(F.col("_c") >= min_count).select(*keys, "h")
    if n:
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("h"))).where(F.col("_r") <= n).drop("_r")
        rows = rows if within is None else rows.join(within.select("h").distinct(), "h", "left_semi").select(*keys, "h")
    return rows


#: Parts that hashes of labels are dealt over, and hashes that a task deals together.
PARTS, DEALT = 1024, 1 << 21


def label_sketch(seqs: DataFrame, seq_col: str, label_col: str, k: int = 21, scaled: int = 1000, method: str = "md5") -> DataFrame:
    """sketch() by one label that many sequences share: (label_col, h); hashes are shuffled as numbers, many to a row, in ranges of their values."""
    if not fast(k, method):
        return sketch(seqs, seq_col, [label_col], k, scaled, method=method)
    digits = 16 if method == "murmur3" else DIGITS
    bound = int(threshold(scaled, method), 16) if scaled > 1 else 16**digits
    step = -(-bound // PARTS)
    source = spread(seqs.select(F.col(label_col).alias("label"), F.col(seq_col).alias("seq")))
    kind = source.schema["label"].dataType.simpleString()
    edges = np.array([step * p for p in range(1, PARTS) if step * p < bound], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, count, label_type = {}, 0, None

        def out() -> pa.RecordBatch:
            parts, labels, tails = [], [], []
            for label, some in gathered.items():
                for p, values in enumerate(np.split(found := np.unique(np.concatenate(some)), np.searchsorted(found, edges))):
                    if len(values):
                        parts.append(p)
                        labels.append(label)
                        tails.append(values.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(labels, label_type), pa.array(tails, pa.binary())], names=["part", "label", "tails"])

        for batch in batches:
            label_type = batch.column(0).type
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            names, place = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for rows, numbers in C.kmers_of(batch.column(1), k):
                values = C.hashes(numbers, k, method)
                below = values <= np.uint64(bound - 1)
                own, values = place[rows[below]], values[below]
                for i in np.unique(own).tolist():
                    gathered.setdefault(names[i], []).append(values[own == i])
                if (count := count + len(values)) >= DEALT:
                    yield out()
                    gathered.clear()
                    count = 0
        if count:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        codes = pa.concat_arrays(table.column("label").chunks).dictionary_encode(null_encoding="encode")
        each = [np.frombuffer(x, np.uint64) for x in table.column("tails").to_pylist()]
        own = np.repeat(codes.indices.to_numpy(zero_copy_only=False), [len(x) for x in each])
        own, values = least_by_row(own, np.concatenate(each))
        return pa.table({label_col: codes.dictionary.take(pa.array(own)), "h": C.hex_digits(values, digits)})

    packed = source.mapInArrow(deal, f"part int, label {kind}, tails binary")
    return packed.groupBy("part").applyInArrow(merge, f"`{label_col}` {kind}, h string")


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The union of sketches by coarser keys."""
    return sketches.select(*keys, "h").distinct()


def sizes(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.count("*").alias("n_hashes"))
