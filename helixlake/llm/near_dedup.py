"""Near-duplicates by an inverted join over MinHash signature coordinates.

A text's set is its distinct pairs of adjacent words.  Its signature has K
coordinates; two texts of likeness 0.8 agree in 0.8 K of them on average, and in
fewer than MATCHES with a chance of about 1e-8.

1. Texts with equal sets form a class; one document stands for it.
2. Postings: every document is posted under each (coordinate, value) pair.  A value
   that one document has cannot collide, so a document with fewer than MATCHES
   shared values is done.
3. Prefix and skip: with a document's values ordered from rare to frequent, two
   documents that agree in MATCHES coordinates share one of the first K - MATCHES + 1.
   Lists are merged only for these; the frequent values are skipped over, and looked
   at only when collisions are counted.  Of lists with the same members one is kept.
4. Collisions are counted among the documents of a list, on one byte of each
   coordinate (equal values stay equal).  Documents that agree in MATCHES coordinates
   are candidates of each other, and what candidates connect is a family.
5. Every set is sent once, to its family, where links are confirmed on full sets.
   A family of more than BLOCK documents is dealt over several blocks, and a few of
   its documents are sent to all of them, so that what they link grows together.
6. Only in such families pairs are left that no block held together: documents outside
   the largest component of a list, against the list.  Their collisions are counted
   in blocks of bounded size, and only sets of documents that collide are sent.

Components are what links connect, so links inside a component need not be found.
Only ids and signatures move in steps 2 to 4, and sets only for documents that are
candidates.  Written tables are deleted once what is made of them has been written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import answers, discard, documents, every, quoted, resting_on, unused, written
from .textbatch import ascii_lower, joined, mix, prefix_hash, range_hash, slices, words

K, MATCHES = 64, 32
#: Links need 100 * intersection >= PERCENT * union.
PERCENT, SHINGLE = 80, 2
#: Documents, and elements of their sets, on either side of a block of comparisons.
BLOCK, ELEMENTS = 1024, 1 << 20
#: Documents of a large family that are sent to all of its blocks.
CENTRES = 4
#: Candidates whose ids and families may be broadcast (about 100 bytes each).
BROADCAST_IDS = 500_000
#: Keys of long lists that may be broadcast.
BROADCAST_LISTS = 500_000
#: Ids of removed documents that may be broadcast; their hash table takes about 100 MB of each executor.
BROADCAST_GONE = 2_000_000
#: Lists up to this length are counted many at a time.
SHORT = 16
_A = np.random.default_rng(11).integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 63, K, dtype=np.uint64)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct word shingles of each text.

    A-Z are lower-cased.  A text with fewer words than a shingle has one element, all
    its words; a text without words has none.
    """
    data, offsets = joined(texts)
    data = ascii_lower(data)
    start, end, row = words(data, offsets)
    h = range_hash(prefix_hash(data), start, end)
    count = np.bincount(row, minlength=len(texts))
    out = h.copy()
    for k in range(1, size):
        out[:-k] = mix(out[:-k] * np.uint64(3) + mix(h[k:] + np.uint64(k)))
    first = np.concatenate([[0], np.cumsum(count)])
    whole = np.ones(len(h), bool)
    for k in range(1, size):
        whole[np.maximum(0, first[1:] - k)[count >= k]] = False
    sets = [np.zeros(0, np.uint64)] * len(texts)
    at, of = out[whole], row[whole]
    order = np.lexsort((at, of))
    at, of = at[order], of[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    at, of = at[new], of[new]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        if count[i] >= size:
            sets[i] = at[cuts[i] : cuts[i + 1]]
        elif count[i]:
            total = np.array([count[i]], np.uint64)
            for k in range(first[i], first[i + 1]):
                total = mix(total * np.uint64(7) + h[k : k + 1])
            sets[i] = total
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K minima of each non-empty set, as unsigned 32-bit values."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), K), np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _signed(texts: list[str], shingle: int) -> list:
    sets = shingle_sets(texts, shingle)
    full = [i for i, s in enumerate(sets) if len(s)]
    sig = signatures([sets[i] for i in full]) if full else []
    by = dict(zip(full, sig, strict=True))
    return [
        [len(s) for s in sets],
        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
        [by[i].tobytes() if i in by else None for i in range(len(sets))],
    ]


def _batches(columns: Callable[[pa.RecordBatch], dict[str, pa.Array]]):
    """A mapInArrow function of a function of one batch."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = columns(batch)
            yield pa.RecordBatch.from_arrays(list(got.values()), names=list(got))

    return mapped


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _posted(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    sig = _fixed(batch.column(1), "<u4", K)
    key = (np.arange(K, dtype=np.int64) << 32) + sig.astype(np.int64)
    return {"key": pa.array(key.ravel()), "id": pa.array(np.repeat(batch.column(0).to_numpy(), K))}


def prefix_postings(reps: DataFrame) -> DataFrame:
    """(key, id): the postings of each document's prefix, of values that documents share."""
    posts = reps.select("id", "sig").mapInArrow(_batches(_posted), "key long, id long")
    shared = posts.join(posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "key")
    own = W.partitionBy("id")  # at most K rows
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("df", "key"))).withColumn("held", F.count("*").over(own))
    return ranked.where(F.col("rank") <= F.col("held") - MATCHES + 1).select("key", "id")


def lists(prefix: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lists of prefix postings, short ones (key, id) and long ones of more than BLOCK
    documents (key, id, root); and the written table of keys that both read.

    Lists with one member are left out, and of lists with the same members (by their
    number and two exclusive sums of hashes) all but one.  root is the least id of a
    list.  Keys of long lists are broadcast after a count, so their postings stay where
    they are; no task is dealt more than a short list of one key.
    """
    made_of = prefix.groupBy("key").agg(
        F.count("*").alias("n"), F.min("id").alias("root"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "id")).alias("y")
    ).where("n > 1")
    made_of = written(made_of)
    one = made_of.groupBy("n", "x", "y").agg(F.min(F.struct("key", "root")).alias("l")).select("n", "l.key", "l.root")
    long, every = one.where(F.col("n") > BLOCK).select("key", "root"), made_of.where(F.col("n") > BLOCK).select("key")
    hint = F.broadcast if every.count() <= BROADCAST_LISTS else lambda df: df
    short = prefix.join(hint(every), "key", "left_anti").join(one.where(F.col("n") <= BLOCK).select("key"), "key")
    return short, prefix.join(hint(long), "key").select("key", "id", "root"), made_of


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of whole groups from batches sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        head, tail = tuple(c[0] for c in cols), tuple(c[-1] for c in cols)
        if last is not None and head != last:
            yield pa.Table.from_batches(held)
            held = []
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if len(new):
            cut = int(new[-1]) + 1
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = tail
    if held:
        yield pa.Table.from_batches(held)


def _spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The component of each of n items, as one of its items; near(i, rest) marks those of rest that i is linked with.

    An item that has been reached isn't asked about again, so a group that is linked
    with one of its items costs one comparison for each item.
    """
    label, rest = np.arange(n), np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            hit = near(front.pop(), rest)
            label[rest[hit]] = seed
            front += rest[hit].tolist()
            rest = rest[~hit]
    return label


def _lowest(label: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each item's component."""
    low = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    return low[label]


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, root) of postings whose document agrees in MATCHES coordinates with another of its
    list: root is the least id that such agreements reach within the list."""
    for table in _groups(batches, 1):
        key, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
        sig = _fixed(table.column(2).combine_chunks(), np.uint8, K)
        label = np.arange(len(key))
        edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
        size = np.diff(edge)
        for lo, n in zip(edge[:-1][size > SHORT], size[size > SHORT], strict=True):
            own = sig[lo : lo + n]
            label[lo : lo + n] = lo + _spread(n, lambda i, rest, own=own: (own[rest] == own[i]).sum(1) >= MATCHES)
        at, left, right = np.flatnonzero(np.repeat(size <= SHORT, size)), [], []
        for gap in range(1, SHORT):
            at = at[at + gap < len(key)]
            at = at[key[at] == key[at + gap]]
            for a in range(0, len(at), 20_000):
                i = at[a : a + 20_000]
                hit = i[(sig[i] == sig[i + gap]).sum(1) >= MATCHES]
                left.append(hit)
                right.append(hit + gap)
        if left:
            i, j, before = np.concatenate(left), np.concatenate(right), None
            while before is None or (before != label).any():
                before = label.copy()
                np.minimum.at(label, j, label[i])
                np.minimum.at(label, i, label[j])
        active = np.bincount(label, minlength=len(label))[label] > 1
        root = _lowest(label, ids)
        yield pa.RecordBatch.from_arrays([pa.array(key[active]), pa.array(ids[active]), pa.array(root[active])], names=["key", "id", "root"])


def _bytes_of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    low = _fixed(batch.column(1), "<u4", K).astype(np.uint8)
    return {"id": batch.column(0), "sig": pa.array([x.tobytes() for x in low], pa.binary())}


def candidate_postings(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, root): postings of documents that collide often enough with another of their list; and (id, sig) in bytes.

    A list longer than BLOCK stands as one family here; step 6 counts its collisions.
    """
    prefix = written(prefix_postings(reps))
    low = written(reps.mapInArrow(_batches(_bytes_of), "id long, sig binary"))
    short, long, made_of = lists(prefix)
    counted = short.join(low, "id").select("key", "id", "sig")
    kept = counted.repartition("key").sortWithinPartitions("key").mapInArrow(_colliding, "key long, id long, root long")
    found = written(kept.unionByName(long))
    discard(prefix, made_of)
    return found, low


def _alike(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted sets are linked with the sorted set a; none is empty."""
    size = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat((a[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
    return 100 * both >= PERCENT * (size + len(a) - both)


def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the confirmed components of each block (family, part, id, elements)."""
    for table in _groups(batches, 2):
        cols = [table.column(i).to_numpy() for i in range(2)]
        edge = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0), [True]]))
        ids, raw, links = table.column(2).to_numpy(), table.column(3), []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raw.slice(lo, hi - lo).to_pylist()]
            sig = signatures(sets).astype(np.uint8) if len(sets) > SHORT else None

            def near(i: int, rest: np.ndarray, sets=sets, sig=sig) -> np.ndarray:
                ok = np.ones(len(rest), bool) if sig is None else (sig[rest] == sig[i]).sum(1) >= MATCHES
                if ok.any():
                    ok[ok] = _alike(sets[i], [sets[j] for j in rest[ok]])
                return ok

            own = ids[lo:hi]
            root = _lowest(_spread(hi - lo, near), own)
            links.append(np.stack([own, root])[:, own != root])
        a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(shingle: int):
    """A mapInArrow function that puts the sets of texts (last column) in place of the texts."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                sets = shingle_sets(texts[a:b], shingle)
                full = pa.array([len(s) > 0 for s in sets])
                part = [c.slice(a, b - a) for c in batch.columns[:-1]]
                done = pa.RecordBatch.from_arrays([*part, pa.array([s.tobytes() for s in sets], pa.binary())], names=[*batch.schema.names[:-1], "elements"])
                yield done.filter(full)

    return mapped


def with_sets(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """rows (id, ...), one for each id, with `elements`: the sets of their documents.

    rows are broadcast after a count; beyond the bound the texts are shuffled by id once.
    """
    few = rows.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("_text"))
    found = texts.join(F.broadcast(rows) if few else rows, "id").select(*rows.columns, "_text")
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return found.mapInArrow(_sets(shingle), f"{schema}, elements binary")


def _part(of: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "id"), of).cast("int")


def families(active: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, family, parts, places): the family of each candidate, its number of blocks, and those the document is sent to."""
    roots = components(active.select(F.col("id").alias("a"), F.col("root").alias("b")))
    ids = active.select("id").distinct()
    member = ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("family"))
    member = written(member.join(sizes, "id").groupBy("id", "family").agg(F.max("n").alias("n")))
    discard(roots)
    need = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).cast("int")
    whole = member.groupBy("family").agg(need.alias("parts"), F.array(*[F.min_by("id", F.xxhash64(F.lit(k), "id")) for k in range(1, CENTRES + 1)]).alias("centres"))
    everywhere = (F.col("parts") > 1) & F.array_contains("centres", F.col("id"))
    places = F.when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_part(F.col("parts"))))
    dealt = written(member.join(whole, "family").select("id", "family", "parts", places.alias("places")))
    discard(member)
    return dealt


def family_links(docs: DataFrame, dealt: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Confirmed links (a, b) within the blocks of each family."""
    made = with_sets(docs, dealt.select("id", "family", "places"), id_col, text_col, shingle)
    blocks = made.select("family", F.explode("places").alias("part"), "id", "elements")
    return blocks.repartition("family", "part").sortWithinPartitions("family", "part").mapInArrow(_family_links, "a long, b long")


def _blocks(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Start, end, and the rows of either side of each block (key, part, ask, id, comp, probe, ...)."""
    cols = [table.column(i).to_numpy() for i in range(3)]
    edge = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0), [True]]))
    probe = np.array(table.column(5).to_pylist(), bool)
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        build, ask = lo + np.flatnonzero(~probe[lo:hi]), lo + np.flatnonzero(probe[lo:hi])
        if len(build) and len(ask):
            yield lo, hi, build, ask


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block that collide often enough with one of the other side in another component."""
    for table in _groups(batches, 3):
        comp, sig = table.column(4).to_numpy(), _fixed(table.column(6).combine_chunks(), np.uint8, K)
        on = np.zeros(len(comp), bool)
        for _, _, build, ask in _blocks(table):
            for i in ask:
                hit = build[((sig[build] == sig[i]).sum(1) >= MATCHES) & (comp[build] != comp[i])]
                on[hit] = True
                on[i] |= len(hit) > 0
        kept = table.select(list(range(6))).filter(pa.array(on)).combine_chunks()
        yield from kept.to_batches()


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a block: for each probe and each other component, one confirmed partner if there is any."""
    for table in _groups(batches, 3):
        ids, comp, raw, links = table.column(3).to_numpy(), table.column(4).to_numpy(), table.column(6), []
        for lo, hi, build, ask in _blocks(table):
            sets = [np.frombuffer(x, np.uint64) for x in raw.slice(lo, hi - lo).to_pylist()]
            sig = signatures(sets).astype(np.uint8)
            for i in ask:
                near = build[((sig[build - lo] == sig[i - lo]).sum(1) >= MATCHES) & (comp[build] != comp[i])]
                if len(near):
                    near = near[_alike(sets[i - lo], [sets[j - lo] for j in near])]
                    links += [(int(ids[i]), int(ids[j])) for j in near[np.unique(comp[near], return_index=True)[1]]]
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def crossing_links(docs: DataFrame, apart: DataFrame, low: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Confirmed links between documents of the lists apart (key, id, family, comp) that lie in different components.

    A family that its lists would cover in more blocks than it has itself is taken as one list.
    """
    def split(rows: DataFrame) -> DataFrame:
        by = rows.groupBy("family", "key", "comp").agg(F.count("*").alias("n")).groupBy("family", "key")
        mixed = by.agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("comps")).where("comps > 1")
        return mixed.select("family", "key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("asks"))

    cost = F.sum(F.col("parts").cast("double") * F.col("asks"))
    whole = apart.select("family", F.col("family").alias("key"), "id", "comp").distinct()
    by_list, by_family = split(apart), split(whole)
    either = by_list.groupBy("family").agg(cost.alias("a")).join(by_family.groupBy("family").agg(cost.alias("b")), "family")
    cheaper = written(either.select("family", (F.col("b") <= F.col("a")).alias("own")))
    own = cheaper.where("own").select("family")
    rows = written(
        apart.join(cheaper.where("not own").select("family"), "family").join(by_list, ["family", "key"]).select("key", "id", "comp", "main", "parts", "asks")
        .unionByName(whole.join(own, "family").join(by_family, ["family", "key"]).select((-F.col("key") - 1).alias("key"), "id", "comp", "main", "parts", "asks"))
    )
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    build = rows.select("key", _part(F.col("parts"), 3).alias("part"), every("asks").alias("ask"), "id", "comp", F.lit(False).alias("probe"))
    probe = rows.where("comp <> main").select("key", every("parts").alias("part"), _part(F.col("asks"), 4).alias("ask"), "id", "comp", F.lit(True).alias("probe"))
    order = ["key", "part", "ask"]
    placed = build.unionByName(probe).join(low, "id").select(*order, "id", "comp", "probe", "sig")
    asking = placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(_asking, "key long, part int, ask int, id long, comp long, probe boolean")
    calls = written(asking.groupBy("id").agg(F.collect_list(F.struct(*order, "comp", "probe")).alias("calls")))  # at most one for each block of its lists
    made = with_sets(docs, calls, id_col, text_col, shingle).select("id", F.inline("calls"), "elements")
    dealt = made.select(*order, "id", "comp", "probe", "elements").repartition(*order).sortWithinPartitions(*order)
    links = written(dealt.mapInArrow(_crossing, "a long, b long"))
    discard(cheaper, rows, calls)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: the smallest node it is connected to.

    Alternates large and small stars until the edges no longer change; each turn is
    a few aggregations and joins, and is written to the shared folder.
    """

    def stars(both: DataFrame, larger: bool) -> DataFrame:
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        seen = both.join(low, "x")
        if larger:
            return seen.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        return seen.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = stars(both, True).where("x <> y").distinct()
        small = stars(large, False).where("x <> y").distinct()
        last, now = now, written(small)
        discard(last)
        count, total = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0))).first()
        if (count, total) == mark:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
        mark = (count, total)


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (id, comp) after links (a, b) join their components."""
    of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    roots = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = comps.join(roots, comps["comp"] == roots["node"], "left")
    out = written(moved.select("id", F.coalesce("root", "comp").alias("comp")))
    discard(comps, roots)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, n_shingles, component_id and kept for each row of docs; ids are integers.

    The component is the smallest id that links reach.  Null and empty texts, and
    texts without words, are linked with nothing, as are rows without an id, whose
    component is null.  Rows that repeat an id count as one document.  An empty table
    gives an empty result; other columns are ignored.
    """
    signed = answers(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), "id", "text", {"n": "long", "digest": "binary", "sig": "binary"}, lambda: lambda texts: _signed(texts, shingle))
    signed = written(signed)
    classes = written(signed.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n")))
    active, low = candidate_postings(classes.select(F.col("rep").alias("id"), "sig"))
    dealt = families(active, classes.select(F.col("rep").alias("id"), "n"))
    links = written(family_links(docs, dealt, id_col, text_col, shingle))
    comps = joined_components(written(dealt.select("id", F.col("id").alias("comp"))), links)
    large = dealt.where("parts > 1").select("id", "family")
    if not large.isEmpty():
        apart = written(active.select("key", "id").join(large, "id").join(comps, "id").select("key", "id", "family", "comp"))
        crossed = crossing_links(docs, apart, low, id_col, text_col, shingle)
        comps = joined_components(comps, crossed)
        discard(apart, crossed)
    discard(active, low, dealt, links)
    labelled = classes.select("digest", "rep").join(comps, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    alone = F.concat(F.lit("id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")
    rows = signed.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).otherwise(alone).alias("digest"))
    root = F.coalesce("comp", "id")
    return rows.join(labelled, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept")
    )


def keep_by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keep_representatives() of a table whose ids are all given, and differ.

    The texts are shuffled only if more than BROADCAST_GONE documents go.
    """
    (name,) = unused(docs, "__gone_id")
    gone = written(near_duplicates(docs, id_col, text_col, shingle).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct())
    few = gone.count() <= BROADCAST_GONE
    out = docs.join(F.broadcast(gone) if few else gone, quoted(id_col).cast("bigint") == F.col(name), "left_anti")
    return resting_on(out, gone)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest id.

    Decided row by row: rows that share an id, or have none, are documents of their own.
    Null and empty texts, and texts without words, all stay.  Where ids are missing or repeated, the rows are numbered by id and text first, those
    without an id last, which costs one shuffle of the texts.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    if ids.where("id is null").isEmpty() and ids.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        return keep_by_id(docs, id_col, text_col, shingle)
    (row_id,) = unused(docs, "__row_id")
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = written(ordered.select(*every(docs), F.monotonically_increasing_id().alias(row_id)))
    kept = keep_by_id(rows, row_id, text_col, shingle)
    return resting_on(kept.select(*every(docs)), rows, kept)


def op5_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
