"""k-mer labels, read mapping and annotation of gene families."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.dna import DIGITS, hashed, kmers, spread
from ..functions.parsing import label_family, label_hits
from .sketch import fast, hashed_rows, known_prefixes, known_words, may_hold
from .tables import kept, shuffles_deleted

#: Fixed value: added to a read's k-mer hits before they are divided by the family's length.
K_OFFSET = 21


#: Words of 64 bits of a sieve: a table of at most so many rows, which may be broadcast.
SIEVE_WORDS = 1 << 20
#: A sieve with a larger share of its bits set than this lets too much through to be worth a join.
FULL = 0.5


def _sieve_place(words: int) -> tuple[Column, Column]:
    """The word of a hash and its four bits there."""
    y = F.xxhash64(F.lit(1), "h")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(y, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64("h"), F.lit(words)), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def sieve(hashes: DataFrame, words: int = SIEVE_WORDS) -> DataFrame:
    """A Bloom filter of (h): (word, bits), of at most `words` rows however many hashes there are; a row is combined before it is shuffled."""
    word, bits = _sieve_place(words)
    return hashes.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def sifted(rows: DataFrame, filters: DataFrame, words: int = SIEVE_WORDS) -> DataFrame:
    """rows (with h) that a sieve may hold: none that it holds goes, and of the others those with all bits set by chance stay."""
    word, bits = _sieve_place(words)
    told = rows.withColumns({"_word": word, "_own": bits}).join(F.broadcast(filters), "_word")
    return told.where(F.col("_bits").bitwiseAND(F.col("_own")) == F.col("_own")).select(*rows.columns)


#: Parts that k-mers are dealt over, by the first bits of their scattered numbers, and k-mers that a task deals together.
PART_BITS, DEALT = 10, 1 << 22
#: An odd number: a product with it scatters k-mers, and has one inverse.
ODD = 0x9E3779B97F4A7C15


def _cut(x: int, bits: int) -> np.uint64:
    return np.uint64(x % (1 << bits))


def _dealt(parts: dict, bits: int) -> list[tuple]:
    """Rows (part, labels, sizes, times, tails) of the distinct k-mers of each label, for those gathered by label."""
    labels = list(parts)
    each = [np.unique(np.concatenate(parts[x]), return_counts=True) for x in labels]
    numbers, times = np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each]).astype(np.uint32)
    own = np.repeat(np.arange(len(labels)), [len(x) for x, _ in each])
    part = (numbers >> np.uint64(bits - PART_BITS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    numbers, times, own = numbers[order] & np.uint64((1 << (bits - PART_BITS)) - 1), times[order], own[order]
    ends = np.cumsum(np.bincount(part, minlength=1 << PART_BITS))
    rows = []
    for p, (lo, hi) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
        if lo < hi:
            starts = np.flatnonzero(np.diff(own[lo:hi], prepend=-1))
            steps = np.diff(numbers[lo:hi], prepend=np.uint64(0))  # ascending within a label: small steps, whose high bytes are alike
            rows.append((p, [labels[i] for i in own[lo:hi][starts].tolist()], np.diff(starts, append=hi - lo).astype(np.uint32).tobytes(), _planes(times[lo:hi], 4), _planes(steps, 8)))
    return rows


def _planes(values: np.ndarray, size: int) -> bytes:
    """Numbers byte by byte, the bytes of one place together, which compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes()


def _unplaned(raw: bytes, kind: type, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def distinct_kmers(seqs: DataFrame, seq_col: str, label_col: str, k: int, min_count: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(h, label) of all k-mers of a label, min_count times at least; k-mers are shuffled as numbers, many to a row.

    With turns, those of one range of parts alone: each k-mer has its turn.

    A task hands on the distinct k-mers of each label among DEALT of them, in 2**PART_BITS
    parts by their scattered numbers, so all of a k-mer meet in one part; a k-mer is hashed there, once a label.
    """
    bits = max(2 * k, PART_BITS)
    source = spread(seqs.select(F.col(label_col).alias("label"), F.col(seq_col).alias("seq")))
    kind = source.schema["label"].dataType
    mask, odd, back = np.uint64((1 << bits) - 1), _cut(ODD, bits), _cut(pow(ODD, -1, 1 << bits), bits)

    def due(numbers: np.ndarray) -> np.ndarray:
        return ((numbers * odd & mask) >> np.uint64(bits - PART_BITS)) * np.uint64(turns) >> np.uint64(PART_BITS) == np.uint64(turn)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, count, label_type = {}, 0, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*_dealt(gathered, bits), strict=True))
            kinds = [pa.int32(), pa.list_(label_type), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "labels", "sizes", "times", "tails"])

        for batch in batches:
            label_type = batch.column(0).type
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            names, place = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for rows, numbers in C.kmers_of(batch.column(1), k, due if turns > 1 else None):
                own, numbers = place[rows], numbers * odd & mask
                order = np.argsort(own, kind="stable")
                own, numbers = own[order], numbers[order]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                for i, one in zip(own[starts].tolist(), np.split(numbers, starts[1:]), strict=True):
                    gathered.setdefault(names[i], []).append(one)
                if (count := count + len(numbers)) >= DEALT:
                    yield out()
                    gathered.clear()
                    count = 0
        if count:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        label_codes = pa.concat_arrays([c.flatten() for c in table.column("labels").chunks]).dictionary_encode(null_encoding="encode")
        sizes = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("sizes").to_pylist()])
        own = np.repeat(label_codes.indices.to_numpy(zero_copy_only=False), sizes)
        tails = np.concatenate([np.cumsum(_unplaned(x, np.uint64, 8), dtype=np.uint64) for x in table.column("tails").to_pylist()])
        times = np.concatenate([_unplaned(x, np.uint32, 4) for x in table.column("times").to_pylist()])
        order = np.lexsort((tails, own))
        own, tails = own[order], tails[order]
        starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (tails[1:] != tails[:-1]))))
        enough = starts[np.add.reduceat(times[order].astype(np.int64), starts) >= min_count]
        numbers = (tails[enough] | np.uint64(table.column("part")[0].as_py() << (bits - PART_BITS))) * back & mask
        found = [C.hashes(numbers[i : i + C.POSITIONS], k, "md5") for i in range(0, len(numbers), C.POSITIONS)]
        h = C.hex_digits(np.concatenate(found) if found else np.zeros(0, np.uint64), DIGITS)
        return pa.table({"h": h, "label": label_codes.dictionary.take(pa.array(own[enough]))})

    label_name = kind.simpleString()
    packed = source.mapInArrow(deal, f"part int, labels array<{label_name}>, sizes binary, times binary, tails binary")
    return packed.groupBy("part").applyInArrow(merge, f"h string, label {label_name}")


#: Letters whose k-mers are shuffled in one turn; their disk is free again before the next.
LETTERS_A_TURN = 3_000_000_000


def label_spans(seqs: DataFrame, seq_col: str, label_col: str, k: int, letters: int) -> DataFrame:
    """label, n_kmers, least and greatest: how many k-mers a label's sequences of so many letters in all hold, and their first and last hash.

    Sequences are gone over once for each LETTERS_A_TURN, by turns of distinct_kmers(), so the
    disk for its shuffle does not grow beyond that of one turn.
    """
    turns = min(max(1, -(-letters // LETTERS_A_TURN)), 1 << PART_BITS) if fast(k, "md5") else 1
    number = F.conv("h", 16, 10).cast("bigint")  # as strings the least and greatest would sort all rows by label
    found = []
    for turn in range(turns):
        rows = distinct_kmers(seqs, seq_col, label_col, k, 1, turn, turns) if fast(k, "md5") else kmer_labels(seqs, seq_col, label_col, k)
        ends = rows.select("label", number.alias("h")).groupBy("label").agg(F.count("*").alias("n_kmers"), F.min("h").alias("least"), F.max("h").alias("greatest"))
        if turns > 1:
            with shuffles_deleted(seqs.sparkSession):
                ends = kept(ends)
        found.append(ends)
    spans = found[0]
    if turns > 1:
        spans = functools.reduce(DataFrame.unionByName, found).groupBy("label").agg(F.sum("n_kmers").alias("n_kmers"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return spans.select("label", "n_kmers", *[F.lpad(F.lower(F.hex(c)), 15, "0").alias(c) for c in ("least", "greatest")])


def kmer_labels(seqs: DataFrame, seq_col: str, label_col: str, k: int = 21, min_count: int = 1, within: DataFrame | None = None, words: int = SIEVE_WORDS) -> DataFrame:
    """(h, label) of all k-mers that a label's sequences hold; `within` (h) restricts to known k-mers, before any is counted.

    Most rows that `within` does not hold fall where they are made, to a table of the first
    bits of its hashes and then to a sieve, before the shuffle that decides; not if so many
    hashes are known that it would hold back little.  If `within` is of read_hashes(), with
    `scattered`, nearly all k-mers fall by their numbers, and only the others are hashed.
    """
    if within is None and fast(k, "md5"):
        return distinct_kmers(seqs, seq_col, label_col, k, min_count)
    rows = counted_kmers(seqs.select(F.col(label_col).alias("label"), F.col(seq_col).alias("_s")), "_s", ["label"], k, within, words)
    return rows.where(F.col("n") >= min_count).select("h", "label")


def counted_kmers(seqs: DataFrame, seq_col: str, labels: list[str], k: int = 21, within: DataFrame | None = None, words: int = SIEVE_WORDS) -> DataFrame:
    """h, labels and n: how often the sequences of each combination of labels hold a k-mer, in one pass over them."""
    full = True
    numbered = within is not None and "scattered" in within.columns and fast(k, "md5")
    if within is not None:
        within = kept(within.select("h", *(["scattered"] if numbered else [])).distinct())
        filters = kept(sieve(within, words))
        full = (filters.agg(F.sum(F.bit_count("_bits"))).first()[0] or 0) / (64 * words) > FULL
    if fast(k, "md5"):
        known = None if full else seqs.sparkSession.sparkContext.broadcast(known_prefixes(within))
        places = None
        if numbered and not full:
            table = known_prefixes(within.select(F.col("scattered").alias("h")))
            places = seqs.sparkSession.sparkContext.broadcast((table, known_words(table)))

        def wanted(numbers: np.ndarray) -> np.ndarray:
            table, words = places.value
            return may_hold(table, scattered(numbers), 16, words)

        def keep(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if known is None:
                return at, values
            had = may_hold(known.value, values)
            return at[had], values[had]

        rows = hashed_rows(seqs, seq_col, labels, k, "md5", keep, wanted if places else None).select("h", *labels)
    else:
        rows = kmers(spread(seqs.select(*labels, seq_col)), seq_col, k, labels).select(hashed(F.col("kmer")).alias("h"), *labels)
    if within is not None:
        rows = (rows if full else sifted(rows, filters, words)).join(within, "h", "left_semi")
    return rows.groupBy("h", *labels).agg(F.count("*").alias("n"))


def colour_classes(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, class) and (class, kind, label) of distinct rows (h, kind, label): hashes of the same labels share a class.

    A class is known by the number of its labels and two sums of their hashes, so no set
    of labels is put together for each hash; its labels are those of its first hash.
    """
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)"))
    sums = labelled.groupBy("h").agg(F.count("*").alias("n"), total("kind", "label").alias("p"), total(F.lit(1), F.xxhash64("label", "kind"), "label").alias("q"))
    classes = kept(sums.select("h", F.md5(F.concat_ws(":", "n", "p", "q").cast("binary")).alias("class")))
    first = classes.groupBy("class").agg(F.min("h").alias("h"))
    return classes, labelled.join(first, "h").select("class", "kind", "label")


def class_hits_of_reads(reads: DataFrame, seq_col: str, read_col: str, kmer_classes: DataFrame, classes: DataFrame, kind: str, k: int = 21) -> DataFrame:
    """label_hits_of_reads() for labels of a kind, by classes: a read's k-mers are joined once, and its classes then to their labels."""
    rows = kmers(reads.select(read_col, seq_col), seq_col, k, [read_col]).select(F.col(read_col).alias("read"), hashed(F.col("kmer")).alias("h"))
    per_hash = rows.groupBy("read", "h").agg(F.count("*").alias("times"))
    totals = per_hash.groupBy("read").agg(F.sum("times").alias("n_kmers"))
    by_class = per_hash.join(kmer_classes, "h").groupBy("read", "class").agg(F.sum("times").alias("times"))
    hits = by_class.join(classes.where(F.col("kind") == kind), "class").groupBy("read", "label").agg(F.sum("times").alias("hits"))
    return hits.join(totals, "read")


def scattered(numbers: np.ndarray) -> np.ndarray:
    """k-mers as other numbers, one for each, whose first bits are spread evenly."""
    return numbers * np.uint64(ODD)


def read_hashes(reads: DataFrame, seq_col: str, k: int = 21) -> DataFrame:
    """(h, scattered): the distinct k-mers of reads, to restrict labels to, by their hashes and (up to 31 letters) by their scattered numbers, as 16 hex digits."""
    if not fast(k, "md5"):
        return kmers(reads.select(seq_col), seq_col, k, []).select(hashed(F.col("kmer")).alias("h")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, numbers in C.kmers_of(batch.column(0), k):
                numbers = np.unique(numbers)
                yield pa.RecordBatch.from_arrays([C.hex_digits(C.hashes(numbers, k, "md5"), DIGITS), C.hex_digits(scattered(numbers), 16)], names=["h", "scattered"])

    return spread(reads.select(seq_col)).mapInArrow(cut, "h string, scattered string").distinct()


def label_hits_of_reads(reads: DataFrame, seq_col: str, read_col: str, labels: DataFrame, k: int = 21) -> DataFrame:
    """read, label, hits, n_kmers: positions of each read whose k-mer carries a label.

    Labels made for these reads alone are best restricted to their k-mers, read_hashes().
    """
    rows = kmers(reads.select(read_col, seq_col), seq_col, k, [read_col]).select(F.col(read_col).alias("read"), hashed(F.col("kmer")).alias("h"))
    per_hash = rows.groupBy("read", "h").agg(F.count("*").alias("times"))
    totals = per_hash.groupBy("read").agg(F.sum("times").alias("n_kmers"))
    hits = per_hash.join(labels, "h").groupBy("read", "label").agg(F.sum("times").alias("hits"))
    return hits.join(totals, "read")


def mapped(hits: DataFrame, min_fraction: float = 0.15, most: int = 0) -> DataFrame:
    """read, label, hits, rank of labels with enough of the read's k-mers, the best first."""
    good = hits.where(F.col("hits") >= F.ceil(F.lit(min_fraction) * F.col("n_kmers")))
    ranked = good.withColumn("rank", F.row_number().over(W.partitionBy("read").orderBy(F.desc("hits"), "label")))
    return ranked.where(F.col("rank") <= most) if most else ranked


def mapping_lines(reads: DataFrame, best: DataFrame, mode: str = "matches", as_json: bool = False) -> DataFrame:
    """One line of text (index, value) for each of reads (index, read), with its labels of best (read, label, hits, rank) in their order.

    Tab-separated: index, read, and `<label>:hits` for each label in the mode `matches`, or `<label>` in
    the mode `labels`; a read without a label ends after its name.  As JSON: the same as an object.
    """
    if mode not in ("matches", "labels"):
        raise ValueError(f"unknown mode {mode!r}")
    listed = best.groupBy("read").agg(F.sort_array(F.collect_list(F.struct("rank", "label", "hits"))).alias("_l"))  # the labels of one read
    rows = reads.join(listed, "read", "left")
    found = F.coalesce("_l", F.array().cast("array<struct<rank:int,label:string,hits:bigint>>"))
    if as_json:
        each = F.transform(found, lambda x: F.struct(x["label"].alias("label"), x["hits"].alias("hits"))) if mode == "matches" else F.transform(found, lambda x: x["label"])
        return rows.select("index", F.to_json(F.struct("index", F.col("read").cast("string").alias("read"), each.alias("labels"))).alias("value"))
    text = F.transform(found, lambda x: F.concat(F.lit("<"), x["label"], F.concat(F.lit(">:"), x["hits"].cast("string")) if mode == "matches" else F.lit(">")))
    return rows.select("index", F.array_join(F.concat(F.array(F.col("index").cast("string"), F.col("read").cast("string")), text), "\t").alias("value"))


def mapping_from_tsv(lines: DataFrame, line: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, mapped, family and hits of each line: index, name, then <family>:hits; only the first label counts."""
    parts = F.split(F.trim(line), "\t")
    label = F.when(F.size(parts) >= 3, F.get(parts, F.lit(2)))
    return lines.select(*keep, (F.size(parts) >= 3).alias("mapped"), label_family(label).alias("family"), label_hits(label).alias("hits"))


def annotate(mapping: DataFrame, nodes: DataFrame, offset: int = K_OFFSET) -> DataFrame:
    """nodes with read_count, kmer_count and weight from mapping (family, hits); unknown families are passed over.

    A family has one length, so its weight is one quotient of whole numbers: it does not hang
    on the order of rows, and bounds that it meets exactly are met.
    """
    sums = mapping.groupBy(F.col("family").alias("nid")).agg(F.count("*").alias("read_count"), F.sum("hits").alias("kmer_count"))
    zero = {"read_count": 0, "kmer_count": 0, "weight": 0.0}
    base = nodes.drop(*zero).join(sums, "nid", "left")
    base = base.withColumn("weight", (F.col("kmer_count") + offset * F.col("read_count")) / F.col("length"))
    return base.withColumns({c: F.coalesce(c, F.lit(v).cast("double" if c == "weight" else "bigint")) for c, v in zero.items()})


def annotation_report(mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """total_seq and total_seq_mapped: all lines, and those of known families."""
    known = nodes.select(F.col("nid").alias("family"), F.lit(1).alias("one"))
    return mapping.join(known, "family", "left").agg(F.count("*").alias("total_seq"), F.count("one").alias("total_seq_mapped"))
