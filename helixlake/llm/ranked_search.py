"""Ranked lexical search: an inverted index in shards, and document-at-a-time merging of its postings.

A shard is a few thousand documents that one task has read, sorted by id: the length of
each, a sorted list of terms, and for each term its postings, as variable-length
integers of (documents since the last one, occurrences).  It is built without a shuffle and is one row of a
table, so it can be stored and searched again.

A search takes the queries in blocks of bounded size.  One pass over the lists of terms
counts the documents of each term of a block; a second one merges, for each shard and
query, the postings of the query's terms through a heap of the next document of each
list.  A result heap for each query, bounded and keyed by score and then id, lives
as long as the task.  Once it is full, lists whose best scores together can't reach its
least entry leave the merge and are only looked up for documents that still can; no
document that could enter is passed over.  The heaps of all tasks are merged at last.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, documents, quoted, resting_on, written

#: Documents and bytes of text of a shard; a longer document is a shard of its own.
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
#: Queries of a block and the bytes of their texts, and bytes of text that are cut into terms at a time.
BLOCK_ITEMS, BLOCK_BYTES, STEP = 4096, 8 << 20, 1 << 20
#: A document's length counts for 90 hundredths; fixed values of the score.
FREE, BY_LENGTH, SATURATION, UNIT = 10, 90, 8, 1000
NO_ID = 1 << 63
#: ASCII letters and digits and all bytes of other characters stand for themselves, A-Z for a-z, all else separates.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "ids array<bigint>, lengths array<bigint>, n_docs long, n_terms long, terms binary, dfs binary, ends binary, postings binary"


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in a text; a long text is cut between terms."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    out: Counter = Counter()
    at = 0
    while at < len(raw):
        end = len(raw) if at + STEP >= len(raw) else raw.find(b" ", at + STEP)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def squeezed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Variable-length integers, seven bits a byte, and the offset at which each begins."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for b in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > b)
        out[start[on] + b] = (values[on] >> (7 * b) & 127) | np.where(sizes[on] > b + 1, 128, 0)
    return out.tobytes(), start


def unsqueezed(raw: np.ndarray) -> np.ndarray:
    """The numbers of bytes of squeezed()."""
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def shard_row(docs: list[tuple]) -> tuple:
    """A row of INDEX for (id, counts of terms) of some documents."""
    docs = sorted(docs, key=lambda d: NO_ID if d[0] is None else d[0])
    names: dict[bytes, int] = {}
    term, tf = [], []
    for _, counts in docs:
        term += [names.setdefault(t, len(names)) for t in counts]
        tf += counts.values()
    doc = np.repeat(np.arange(len(docs)), [len(c) for _, c in docs])
    ordered = sorted(names)
    rank = np.empty(len(names), np.int64)
    rank[[names[t] for t in ordered]] = np.arange(len(names))
    term = rank[np.array(term, np.int64)]
    by = np.argsort(term, kind="stable")
    term, doc, tf = term[by], doc[by], np.array(tf, np.int64)[by]
    head = np.flatnonzero(np.diff(term, prepend=-1))
    gap = np.diff(doc, prepend=0)
    gap[head] = doc[head]
    postings, start = squeezed(np.stack([gap, tf], 1).ravel())
    ends = np.append(start[2 * head[1:]], len(postings)) if len(head) else head
    lengths = [c.total() for _, c in docs]
    return ([i for i, _ in docs], lengths, sum(n > 0 for n in lengths), sum(lengths), b" ".join(ordered), np.diff(head, append=len(term)).astype("<u4").tobytes(), ends.astype("<u4").tobytes(), postings)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of docs, as a written table of INDEX; a row is a shard.

    Null and empty texts are documents without a term.  Rows that repeat an id are
    documents of their own, rows without an id come last.  Other columns are ignored.
    """
    names, kinds = [x.split()[0] for x in INDEX.split(", ")], [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(shard_row(held), kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if held and size + len(text or "") > SHARD_BYTES or len(held) == SHARD_DOCS:
                    yield given()
                    held, size = [], 0
                held.append((doc, term_counts(text)))
                size += len(text or "")
        if held:
            yield given()

    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), quoted(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(shards, INDEX))


def document_counts(index: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of the wanted terms occurs; terms of no document are left out."""
    shared = index.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for terms, dfs in zip(*batch.columns, strict=True):
                for t, n in zip(terms.as_py().split(b" "), np.frombuffer(dfs.as_py(), "<u4").tolist(), strict=False):
                    if t in shared.value:
                        total[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    counts = index.select("terms", "dfs").mapInArrow(counted, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in counts.collect()}  # at most the terms of a block of queries


class Shard:
    """One row of an index, whose lists are opened as they are asked for."""

    def __init__(self, row: dict, places: dict[bytes, int], n: int, total: int):
        """n documents have terms, total terms in all; places: the number of each wanted term."""
        self.row, self.ids = row, row["ids"].as_py()
        lengths = np.array(row["lengths"].as_py(), np.int64)
        self.damp = SATURATION * (FREE + BY_LENGTH * lengths * n // max(1, total))
        self.at = {places[t]: i for i, t in enumerate(row["terms"].as_py().split(b" ")) if t in places}
        self.ends = np.frombuffer(row["ends"].as_py(), "<u4").astype(np.int64)
        self.raw = np.frombuffer(row["postings"].as_py(), np.uint8)
        self.open: dict[int, tuple[list[int], list[int], int, dict[int, int]]] = {}

    def postings(self, term: int) -> tuple[list[int], list[int], int, dict[int, int]]:
        """Documents, what an occurrence list is worth in each, the largest such worth, and worths by document."""
        if term not in self.open:
            i = self.at[term]
            values = unsqueezed(self.raw[(self.ends[i - 1] if i else 0) : self.ends[i]])
            docs, tf = np.cumsum(values[::2]), values[1::2]
            worth = 1_000_000_000 * tf // (UNIT * tf + self.damp[docs])
            docs, listed = docs.tolist(), worth.tolist()
            self.open[term] = docs, listed, int(worth.max()), dict(zip(docs, listed, strict=True))
        return self.open[term]


def merge_lists(shard: Shard, terms: list[tuple[int, int]], best: list[tuple[int, int]], top: int) -> None:
    """Merges the lists of (term, weight) of one query document by document into best, a heap of (score, -id)."""
    lists = sorted(((w * (p := shard.postings(t))[2], w, p) for t, w in terms if t in shard.at and w), key=lambda x: x[0])
    if not lists:
        return
    weight, found = [w for _, w, _ in lists], [p for *_, p in lists]
    docs, worth, by_doc = [p[0] for p in found], [p[1] for p in found], [p[3] for p in found]
    reach, total = [], 0  # what a document of the lists up to this one can score at most
    for most, *_ in lists:
        total += most
        reach.append(total)
    least = best[0][0] if len(best) == top else 0
    looked_up = 0  # lists before this one can't lift a document into the heap by themselves
    while looked_up < len(lists) and reach[looked_up] < least:
        looked_up += 1
    bits = len(lists).bit_length()
    mask, place = (1 << bits) - 1, [0] * len(lists)
    front = [docs[k][0] << bits | k for k in range(looked_up, len(lists))]
    heapq.heapify(front)
    while front:
        doc, score = front[0] >> bits, 0
        while front and front[0] >> bits == doc:
            k = front[0] & mask
            at = place[k]
            score += weight[k] * worth[k][at]
            place[k] = at = at + 1
            if at < len(docs[k]):
                heapq.heapreplace(front, docs[k][at] << bits | k)
            else:
                heapq.heappop(front)
        for k in range(looked_up - 1, -1, -1):
            if score + reach[k] < least:
                break
            if more := by_doc[k].get(doc):
                score += weight[k] * more
        else:
            name = shard.ids[doc]
            entry = (score, -(NO_ID if name is None else name))
            if score <= 0 or len(best) == top and entry <= best[0]:
                continue
            if len(best) < top:
                heapq.heappush(best, entry)
            else:
                heapq.heapreplace(best, entry)
            if len(best) == top and best[0][0] > least:
                least, before = best[0][0], looked_up
                while looked_up < len(lists) and reach[looked_up] < least:
                    looked_up += 1
                if looked_up > before:
                    front = [x for x in front if x & mask >= looked_up]
                    heapq.heapify(front)


@dataclass
class Block:
    """A block of queries: the terms by number, their weights, and the numbers of each query's terms."""

    places: dict[bytes, int]
    weights: list[int]
    queries: list[list[int]]
    n: int
    total: int
    top: int


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search_block(index: DataFrame, block: Block) -> DataFrame:
    """(item, doc_id, score) of the entries of each task's heaps."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in b.queries]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[i] for c in batch.schema.names}, b.places, b.n, b.total)
                for terms, heap in zip(b.queries, best, strict=True):
                    merge_lists(shard, [(t, b.weights[t]) for t in terms], heap, b.top)
        rows = [(item, None if -key == NO_ID else -key, score) for item, heap in enumerate(best) for score, key in heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "ends", "postings").mapInArrow(searched, "item long, doc_id long, score long")


def blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Item ids and their terms, in blocks; a partition of items at a time is fetched."""
    ids, texts, size = [], [], 0
    for r in items.select(quoted(item_col).alias("i"), quoted(text_col).cast("string").alias("t")).toLocalIterator():
        if ids and (len(ids) == BLOCK_ITEMS or size + len(r["t"] or "") > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(list(term_counts(r["t"])))
        size += len(r["t"] or "")
    if ids:
        yield ids, texts


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` documents of each row of items, as a written table.

    Scores are above 0; equal ones are ranked by id, documents without an id last.  Items
    of null, empty or unknown text have no result; rows that repeat an item id are items
    of their own.  An empty index or table of items gives no row.
    """
    spark = index.sparkSession
    stats = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
    kind = dict(items.dtypes)[item_col]
    out = []
    for ids, texts in blocks(items, item_col, text_col):
        counts = document_counts(index, sorted({t for terms in texts for t in terms}))
        places = {t: i for i, t in enumerate(sorted(counts))}
        weights = [weight(stats["n"], counts[t]) for t in places]
        block = Block(places, weights, [[places[t] for t in terms if t in places] for terms in texts], stats["n"], stats["total"], top)
        found = search_block(index, block)
        best = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"item long, `{item_col}` {kind}")
        out.append(written(ranked.join(F.broadcast(names), "item").select(item_col, "rank", "doc_id", "score")))
    if not out:
        return spark.createDataFrame([], f"`{item_col}` {kind}, rank int, doc_id long, score long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return resting_on(whole, *out)


def ranked(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """search() of items in an index of docs that is deleted afterwards."""
    index = build_index(docs)
    out = search(index, items, top=top)
    discard(index)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::bigint AS total FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, len(terms)::bigint AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, s GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark)),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::bigint AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
