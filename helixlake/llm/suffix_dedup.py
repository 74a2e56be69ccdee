"""Removal of repeated 50-byte strings, by cover sampling and blockwise sorting.

A suffix matters here by its first WIDTH bytes.  Sorting all suffixes would move
WIDTH bytes for each byte of text, so, as in blockwise construction with a difference
cover, a sample of positions is ranked first and only what the sample can't decide is
sorted, one bucket at a time.  The cover is taken from the content: a position is
sampled if its GRAM bytes have the least hash among those inside some WIDTH-byte
string.  It has the property that makes a difference cover work - two equal strings
hold a sampled position at the same offset - with a density of 2 / (WIDTH - GRAM + 2)
instead of about 7/32 for a cover of period 32.

1. Documents are gathered into chunks of bounded size and written once, compressed.
2. Neighbouring strings with the same sampled position form a run.  Runs are compared
   by the fingerprint of their whole span, in buckets by sampled gram: a run whose
   span occurs in a document with a smaller id is decided, and so is a run whose
   sampled gram no other document has.
3. What is left are ties: runs that share a sampled gram with another document but
   not the whole span, for example at the ends of a copied passage.  Only their
   strings are sorted, again in buckets.
4. Each chunk turns its decisions into covered bytes.

Both comparisons first keep one entry of a fingerprint within a chunk (the one with the
smallest id), so a passage that a third of all documents share reaches its bucket once
for each chunk.  A gram with more than VARIED different spans in a chunk, such as a
frequent phrase, is not sent to step 2 by its spans: two marks say which ids hold it,
its runs are ties, and their strings are dealt by their own fingerprints in step 3.  So
no gram sends more than VARIED entries of a chunk to one bucket.

Runs and strings are compared by two keys: 64 bits of the whole and 32 of the sampled
gram, which equal ones share.  Unequal ones are taken for equal with a chance of 2**-96
a pair, and of 2**-64 among those of one gram; 10**13 runs of 100 TB make about 10**26 pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, resting_on, written
from .textbatch import mix, powers, prefix_hash, range_hash

WIDTH, GRAM = 50, 20
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Replies up to this size are broadcast to the chunks; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Different spans of one gram that a chunk compares as runs.
VARIED = 8
#: Strings that are looked at together; positions need POSITION bits.
POSITION = 20
STEP = (1 << POSITION) - 64
NO_ID = np.iinfo(np.int64).max
CHUNK_SCHEMA = "chunk long, ids array<long>, sizes array<long>, data binary"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """Documents gathered into chunks of about `size` bytes; a longer one is a chunk of its own."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, total = TaskContext.get().partitionId() << 32, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def out() -> pa.RecordBatch:
            cols = [
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                pa.array([squeeze.compress(b"".join(held))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "sizes", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                if held and total + len(raw) > size:
                    yield out()
                    number, ids, held, total = number + 1, [], [], 0
                ids.append(doc)
                held.append(raw)
                total += len(raw)
        if held:
            yield out()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(gathered, CHUNK_SCHEMA)


def _changes(value: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a pair differs from the one before it."""
    out = np.ones(len(value), bool)
    out[1:] = (value[1:] != value[:-1]) | (second[1:] != second[:-1])
    return out


class Entries:
    """Fingerprints of a chunk, one for each distinct pair of a value and a second key: that of the smallest document.

    `local` marks items that repeat a value of a smaller document of the same chunk.
    Kept entries stand by bucket and value, an order that each pass finds again.
    """

    def __init__(self, value: np.ndarray, second: np.ndarray, doc: np.ndarray, ids: np.ndarray, bucket: np.ndarray, buckets: int):
        order = np.lexsort((ids[doc], second, value))
        first = _changes(value[order], second[order])
        group = np.cumsum(first) - 1
        kept = order[first]
        self.local = np.zeros(len(value), bool)
        self.local[order] = ids[doc[order]] > ids[doc[kept]][group] if len(order) else False
        by = np.argsort(bucket[kept], kind="stable")
        self.kept = kept[by]
        place = np.empty(len(kept), np.int64)
        place[by] = np.arange(len(kept))
        self.place = np.empty(len(value), np.int64)
        self.place[order] = place[group]
        self.cuts = np.searchsorted(bucket[self.kept], np.arange(buckets + 1))

    def of(self, bits: np.ndarray) -> np.ndarray:
        """Answers to the kept entries, for all items."""
        return bits[self.place]


class Chunk:
    """Runs and strings of one chunk of documents."""

    def __init__(self, ids: list, sizes: list, data: bytes):
        self.given, self.sizes = ids, np.array(sizes, np.int64)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.prefix = prefix_hash(self.data)
        starts = max(0, len(self.data) - WIDTH + 1)
        parts = [self._runs(a, min(starts, a + STEP)) for a in range(0, starts, STEP)]
        self.start, self.end, self.gram = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def _runs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (of starts, exclusive) and sampled gram of runs among the strings that start in lo..hi."""
        n, inside = hi - lo, WIDTH - GRAM + 1
        p = self.prefix[lo : hi + WIDTH]
        m = n + inside - 1
        h = mix((p[GRAM : GRAM + m] - p[:m]) * powers(len(self.prefix), True)[lo : lo + m])
        low = np.uint64((1 << POSITION) - 1)
        least, span = (h & ~low) | np.arange(m, dtype=np.uint64), 1
        while span * 2 <= inside:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < inside:
            least = np.minimum(least[:n], least[inside - span : inside - span + n])
        at = np.arange(lo, hi)
        doc = np.searchsorted(self.offsets, at[[0, -1]], "right") - 1 if n else np.zeros(2, int)
        bounds = self.offsets[doc[0] : doc[1] + 2]
        which = np.repeat(np.arange(len(bounds) - 1), np.diff(np.clip(bounds, lo, hi)))
        whole = at + WIDTH <= bounds[which + 1]
        edge = np.ones(n, bool)
        edge[1:] = (least[1:] != least[:-1]) | (which[1:] != which[:-1]) | (whole[1:] != whole[:-1])
        cut = np.flatnonzero(edge)
        ends = np.append(cut[1:], n)
        ok = whole[cut]
        cut, ends = cut[ok], ends[ok]
        return lo + cut, lo + ends, h[(least[cut] & low).astype(np.int64)]

    def runs(self, buckets: int) -> None:
        """Set self.entries of the runs `sent`; `local` of all; and marks (gram, id, salt) of varied grams."""
        self.span = range_hash(self.prefix, self.start, self.end + WIDTH - 1)
        bucket = (self.gram >> np.uint64(7)).astype(np.int64) % buckets
        every = Entries(self.span, self.gram, self.doc, self.ids, bucket, buckets)
        self.local, self.entries, self.sent = every.local, every, np.arange(len(self.span))
        self.marks = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        _, at, count = np.unique(self.gram[every.kept], return_inverse=True, return_counts=True)
        varied = every.of(count[at] > VARIED) if len(at) else np.zeros(0, bool)
        if varied.any():
            self.sent = np.flatnonzero(~varied)
            self.entries = Entries(self.span[self.sent], self.gram[self.sent], self.doc[self.sent], self.ids, bucket[self.sent], buckets)
            rest = np.flatnonzero(varied)
            order = rest[np.lexsort((self.ids[self.doc[rest]], self.gram[rest]))]
            edge = np.flatnonzero(np.diff(self.gram[order], prepend=self.gram[order][:1] ^ np.uint64(1)))
            ends = np.append(edge[1:], len(order)) - 1
            both = np.concatenate([order[edge], order[ends]])
            self.marks = (self.gram[both], self.ids[self.doc[both]], np.repeat(np.arange(1, 3, dtype=np.uint64), len(edge)))

    def decided(self, known: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which runs are repeated, and which are tied, from the answers to the entries."""
        repeated, open_runs = self.local.copy(), np.ones(len(self.local), bool)
        repeated[self.sent] |= self.entries.of(known)
        open_runs[self.sent] = self.entries.of(tied)
        return repeated, open_runs & ~repeated

    def ties(self, open_runs: np.ndarray, buckets: int) -> Entries:
        """Entries of all strings of the given runs; their starts are kept in self.at, their grams in self.of_gram."""
        size = (self.end - self.start)[open_runs]
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.at = np.repeat(self.start[open_runs] - first, size) + np.arange(size.sum())
        self.string = range_hash(self.prefix, self.at, self.at + WIDTH)
        self.of_gram = np.repeat((self.gram[open_runs] >> np.uint64(32)).astype("<u4"), size)
        doc = np.repeat(self.doc[open_runs], size)
        return Entries(self.string, self.of_gram, doc, self.ids, (self.string >> np.uint64(7)).astype(np.int64) % buckets, buckets)

    def answered(self, repeated: np.ndarray) -> list[tuple]:
        """A row for each document, from the starts of repeated strings."""
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + WIDTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for i, doc in enumerate(self.given):
            a, b = self.offsets[i], self.offsets[i + 1]
            g = gone[a:b]
            spans = int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1))
            out.append((doc, int(b - a), int(g.sum()), spans, self.data[a:b][~g].tobytes()))
        return out


def _blobs(chunk_id: int, chunk: Chunk, entries: Entries, columns: list[np.ndarray], doc: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, chunk, bytes): count, ids of documents, place of the document, then the columns."""
    for b in range(len(entries.cuts) - 1):
        part = entries.kept[entries.cuts[b] : entries.cuts[b + 1]]
        if len(part):
            used, place = np.unique(doc[part], return_inverse=True)
            head = np.array([len(part), len(used)], "<i8")
            yield b, chunk_id, b"".join(x.tobytes() for x in (head, chunk.ids[used], place.astype("<u4"), *(c[part] for c in columns)))


def _mark_blobs(chunk_id: int, chunk: Chunk, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Blobs of the marks, from a chunk that does not exist: nobody waits for the answers.  The span of a mark occurs once."""
    gram, ids, salt = chunk.marks
    bucket = (gram >> np.uint64(7)).astype(np.int64) % buckets
    span = mix(mix(gram + salt) ^ np.uint64(chunk_id * 0x9E3779B97F4A7C15 % (1 << 64)))
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        head = np.array([len(own), len(own)], "<i8")
        yield int(b), -1, b"".join(x.tobytes() for x in (head, ids[own], np.arange(len(own), dtype="<u4"), (gram[own] >> np.uint64(32)).astype("<u4"), span[own]))


def _opened(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, used = np.frombuffer(blob, "<i8", 2)
    ids, at = np.frombuffer(blob, "<i8", used, 16), 16 + 8 * int(used)
    out = [ids[np.frombuffer(blob, "<u4", n, at)]]
    at += 4 * int(n)
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += np.dtype(kind).itemsize * int(n)
    return out


def _repeats(value: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the same value and second key."""
    order = np.lexsort((ids, second, value))
    first = _changes(value[order], second[order])
    out = np.zeros(len(order), bool)
    out[order] = ids[order] > ids[order[first]][np.cumsum(first) - 1]
    return out


def _decide(kinds: list[str], decide: Callable[..., list[np.ndarray]]):
    """A function of one bucket: opens its blobs, decides, and answers each chunk with bits."""

    def bucket(table: pa.Table) -> pa.Table:
        parts = [_opened(x, kinds) for x in table.column("blob").to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        answers = decide(*(np.concatenate([p[i] for p in parts]) for i in range(len(kinds) + 1)))
        bits = [b"".join(np.packbits(x[a:b]).tobytes() for x in answers) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return bucket


def _runs_decided(ids: np.ndarray, gram: np.ndarray, span: np.ndarray) -> list[np.ndarray]:
    known = _repeats(span, gram, ids)
    rest = np.flatnonzero(~known)
    order = rest[np.argsort(gram[rest], kind="stable")]
    edge = np.flatnonzero(np.diff(gram[order], prepend=gram[order][:1] ^ np.uint32(1))) if len(order) else np.zeros(0, int)
    low, high = np.minimum.reduceat(ids[order], edge) if len(edge) else [], np.maximum.reduceat(ids[order], edge) if len(edge) else []
    tied = np.zeros(len(ids), bool)
    if len(edge):
        tied[order] = np.repeat(low != high, np.diff(np.append(edge, len(order))))
    return [known, tied]


def _strings_decided(ids: np.ndarray, string: np.ndarray, gram: np.ndarray) -> list[np.ndarray]:
    return [_repeats(string, gram, ids)]


def _answers(entries: Entries, reply: list, each: int) -> list[np.ndarray]:
    """The bits of all buckets of a chunk, put together again for the kept entries."""
    out = [np.zeros(len(entries.kept), bool) for _ in range(each)]
    for r in reply or []:
        a, b = entries.cuts[r["bucket"]], entries.cuts[r["bucket"] + 1]
        size = -(-(b - a) // 8)
        for i in range(each):
            out[i][a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8, size, i * size))[: b - a].astype(bool)
    return out


def _shipped(make: Callable[[dict], Iterator[tuple[int, int, bytes]]]):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for bucket, chunk, blob in make(batch.slice(i, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "chunk", "blob"])

    return mapped


BLOBS, BITS = "bucket int, chunk long, blob binary", "chunk long, bucket int, bits binary"


def _with_reply(held: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """The chunks with the answers that a comparison gave to each, a written table."""
    size = bits.agg(F.sum(F.length("bits") + 16)).first()[0] or 0
    reply = bits.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(name))
    return held.join(F.broadcast(reply) if size <= BROADCAST_BYTES else reply, "chunk", "left")


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (bytes) of each row of docs; ids are integers.

    A byte goes if a WIDTH-byte string that covers it also starts in a document with a
    smaller id.  Null and short texts lose nothing.  Rows that repeat an id take
    nothing from each other; a null id counts as larger than all others.  Other
    columns are ignored and an empty table gives an empty result.
    """
    held = written(chunks(docs, id_col, text_col))
    total = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def ship_runs(row: dict):
        c = Chunk(row["ids"], row["sizes"], row["data"])
        c.runs(buckets)
        own = [x[c.sent] for x in ((c.gram >> np.uint64(32)).astype("<u4"), c.span, c.doc)]
        yield from _blobs(row["chunk"], c, c.entries, own[:2], own[2])
        yield from _mark_blobs(row["chunk"], c, buckets)

    def open_runs(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
        """The chunk, which runs are repeated, and which are tied."""
        c = Chunk(row["ids"], row["sizes"], row["data"])
        c.runs(buckets)
        return c, *c.decided(*_answers(c.entries, row["runs"], 2))

    def ship_ties(row: dict):
        c, _, tied = open_runs(row)
        e = c.ties(np.flatnonzero(tied), buckets)
        doc = np.searchsorted(c.offsets, c.at, "right") - 1
        return _blobs(row["chunk"], c, e, [c.string, c.of_gram], doc)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c, repeated, tied = open_runs(row)
                e = c.ties(np.flatnonzero(tied), buckets)
                (known,) = _answers(e, row["ties"], 1)
                size = (c.end - c.start)[repeated]
                first = np.concatenate([[0], np.cumsum(size)])[:-1]
                whole = np.repeat(c.start[repeated] - first, size) + np.arange(size.sum())
                rows = c.answered(np.concatenate([whole, c.at[e.local | e.of(known)]]).astype(np.int64))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    runs_told = written(held.mapInArrow(_shipped(ship_runs), BLOBS).groupBy("bucket").applyInArrow(_decide(["<u4", "<u8"], _runs_decided), BITS))
    asked = _with_reply(held, runs_told, "runs")
    ties_told = written(asked.mapInArrow(_shipped(ship_ties), BLOBS).groupBy("bucket").applyInArrow(_decide(["<u8", "<u4"], _strings_decided), BITS))
    told = _with_reply(asked, ties_told, "ties")
    done = told.mapInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return resting_on(done.withColumnRenamed("id", id_col), held, runs_told, ties_told)


def op7_suffix_dedup(spark, sf_dir):
    out = repeated_strings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
