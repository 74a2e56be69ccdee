"""Document fingerprints from closed syncmers; only SQL functions run on the executors.

The alphabet is tokens: runs of up to CHUNK characters that are not white space; of a
longer run every substring of WINDOW characters is a token, so that an inserted
character changes the tokens about it and no others.  A k-mer is K tokens in a row,
and its inner substrings are its parts of S tokens.  It is a closed syncmer, or anchor,
if the smallest inner hash stands first or last, which holds for 2 of K - S + 1.  Whether a k-mer is chosen depends on
the k-mer alone, so a passage keeps its anchors wherever it is moved.

Every anchor is kept with its place, and passages are matched on those.  The
fingerprint and the Jaccard likeness of two texts come from all their anchors.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import body, documents, let

K, S, CHUNK, WINDOW = 5, 2, 16, 8
#: Cells of the id range that are counted at a time to place bucket bounds, and rows aimed at.
CELLS, ROWS_PER_BUCKET, LEVELS = 65_536, 4_000, 4


def _hashes(text: Column) -> Column:
    windows = lambda r: F.regexp_extract_all(r, F.lit(rf"(?=(\S{{{WINDOW}}}))"), F.lit(1))
    cut = lambda runs: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= CHUNK, F.array(r)).otherwise(windows(r))))
    tokens = lambda runs: F.when(F.exists(runs, lambda r: F.length(r) > CHUNK), cut(runs)).otherwise(runs)
    return F.transform(let(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), tokens), lambda t: F.xxhash64(t))


def _shifted(of: Column, n: Column, count: int) -> list[Column]:
    """The first n items of an array, of the array less its first item, and so on."""
    return [F.slice(of, F.lit(i + 1), n).alias(f"t{i}") for i in range(count)]


def with_anchors(df: DataFrame, text_col: str, out: str, k: int = K, inner: int = S) -> DataFrame:
    """df with `out`: every closed syncmer of a text as (hash, place), by place.

    The place is the number of the k-mer's first token, from 0.  A text with fewer than
    k tokens has one anchor, all its tokens; a text without tokens has none.  Each step
    is a projection of its own, so that the hashes are computed once.
    """
    if not 0 < inner < k:
        raise ValueError("inner substrings are shorter than a k-mer")
    h, s, width = F.col("_hashes"), F.col("_inner"), k - inner + 1
    parts = [f"t{i}" for i in range(width)]
    at_least = lambda n: F.greatest(n, F.lit(0))
    joined = F.transform(F.arrays_zip(*_shifted(h, at_least(F.size(h) - (inner - 1)), inner)), lambda m: F.xxhash64(*[m[f"t{i}"] for i in range(inner)]))
    n = at_least(F.size(s) - (width - 1))
    places = F.slice(F.sequence(F.lit(0), F.size(s)), F.lit(1), n).alias("place")
    closed = F.filter(F.arrays_zip(*_shifted(s, n, width), places), lambda m: F.least(m[parts[0]], m[parts[-1]]) <= F.least(*[m[t] for t in parts]))
    anchors = F.transform(closed, lambda m: F.struct(F.xxhash64(*[m[t] for t in parts]).alias("hash"), m["place"].alias("place")))
    short = F.array(F.struct(F.xxhash64(h).alias("hash"), F.lit(0).alias("place")))
    none = F.array().cast("array<struct<hash:bigint,place:int>>")
    hashed = df.withColumn("_hashes", _hashes(F.col(text_col))).withColumn("_inner", joined)
    return hashed.withColumn(out, F.when(F.size(h) >= k, anchors).when(F.size(h) > 0, short).otherwise(none)).drop("_hashes", "_inner")


def anchor_set(anchors: Column) -> Column:
    """The ascending array of the distinct hashes of anchors, 32 bits each."""
    return F.sort_array(F.array_distinct(F.transform(anchors, lambda a: F.shiftrightunsigned(a["hash"], 32))))


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, size: int | None = None) -> DataFrame:
    """df with `out`: the anchor set of a text, or its `size` smallest hashes."""
    found = anchor_set(F.col("_anchors"))
    return with_anchors(df, text_col, "_anchors", k).withColumn(out, found if size is None else F.slice(found, 1, size)).drop("_anchors")


def matched(left: DataFrame, right: DataFrame, id_col: str = "doc_id", anchors: str = "anchors") -> DataFrame:
    """id, other, place, other_place for every pair of equal anchors of a row of left and one of right; one equi-join.

    Of a passage that two texts share, all pairs have the same difference of places.
    """
    flat = lambda df, i, p: df.select(F.col(id_col).alias(i), F.inline(anchors)).select(i, "hash", F.col("place").alias(p))
    return flat(left, "id", "place").join(flat(right, "other", "other_place"), "hash").select("id", "other", "place", "other_place")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two anchor sets, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union).cast("double")


def fingerprint(sk: Column) -> Column:
    """An anchor set as text: eight hex digits for each hash."""
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def _constant(values: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Buckets:
    """Buckets of neighbouring ids with about as many rows each, from counts of fixed size.

    The id range is cut into cells, which are counted; a cell with more rows than a bucket
    should have is cut again between its ends, up to LEVELS times and as long as its ids differ.  So a few
    ids far from all others cost one more count, and rows of one id stay together.  An id
    with more rows than a bucket should have is alone in its bucket, and `parts` tells
    over how many its rows may be dealt by a hash (1 for all other buckets).
    """

    def __init__(self, ids: DataFrame, rows_per_bucket: int, cells: int):
        n, lo, hi = ids.agg(F.count("*"), F.min("id"), F.max("id")).first()
        lo, hi = (0, 0) if lo is None else (lo, hi)
        self.null = lo - 1
        self.most = max(rows_per_bucket, -(-2 * n // cells))
        given = ids.select(self.ident(F.col("id")).alias("ident"))
        nodes, size = [(lo - 1, max(1, -(-(hi - lo + 2) // cells)))], cells
        #: Of each level: first id and width of the cells of its nodes, cells of a node, and (rows, first id, last id) and next node by (node, cell).
        self.levels: list[tuple[list, int, dict, dict]] = []
        while nodes and len(self.levels) < LEVELS:
            self.levels.append((nodes, size, {}, {}))
            at = self._walk(F.col("ident"))
            reached = given.select(at.alias("at"), "ident").where("at.node >= 0").groupBy("at.node", "at.cell").agg(F.count("*").alias("n"), F.min("ident").alias("least"), F.max("ident").alias("most"))
            counts = {(r["node"], r["cell"]): (r["n"], int(r["least"]), int(r["most"])) for r in reached.collect()}  # at most as many as cells were made
            heavy = sorted(x for x, (rows, *_) in counts.items() if rows > self.most and nodes[x[0]][1] > 1) if len(self.levels) < LEVELS else []
            self.levels[-1] = (nodes, size, counts, {x: i for i, x in enumerate(heavy)})
            below = max(16, cells // max(1, len(heavy)))
            spans = [counts[x][1:] for x in heavy]
            nodes, size = [(least, max(1, -(-(most - least + 1) // below))) for least, most in spans], below
        self.heads: list[int] = []
        self.parts: list[int] = []
        self.bucket: list[dict] = [{} for _ in self.levels]
        self.filled = 0
        self._fill(0, 0)

    def ident(self, id_col: Column) -> Column:
        return F.coalesce(id_col.cast("decimal(20,0)"), F.lit(self.null).cast("decimal(20,0)"))

    def _fill(self, level: int, node: int) -> None:
        _, _, counts, below = self.levels[level]
        for at in sorted(a for a in counts if a[0] == node):
            if at in below:
                self._fill(level + 1, below[at])
                continue
            rows, least, most = counts[at]
            parts = -(-rows // self.most) if least == most else 1
            if not self.heads or self.filled >= self.most or parts > 1:
                self.heads.append(most)
                self.parts.append(parts)
                self.filled = 0
            self.heads[-1] = max(self.heads[-1], most)
            self.filled += rows
            self.bucket[level][at] = len(self.heads) - 1

    def _walk(self, ident: Column) -> Column:
        """(node, cell) of an id at the last level, or node -1 where a level before holds its bucket."""

        def cell_of(level: int, node: Column) -> Column:
            nodes, size, *_ = self.levels[level]
            of = lambda i: F.get(_constant([x[i] for x in nodes], "decimal(20,0)"), F.greatest(node, F.lit(0)))
            return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((ident - of(0)) / of(1)))).cast("int")

        def deeper(level: int):
            nodes, size, _, below = self.levels[level]
            table = _constant([below.get((k, c), -1) for k in range(len(nodes)) for c in range(size)], "int")

            def step(at: Column) -> Column:
                node = F.when(at["node"] < 0, F.lit(-1)).otherwise(F.get(table, at["node"] * size + at["cell"]))
                return let(node, lambda n: F.struct(n.alias("node"), cell_of(level + 1, n).alias("cell")))

            return step

        at = F.struct(F.lit(0).alias("node"), cell_of(0, F.lit(0)).alias("cell"))
        for level in range(len(self.levels) - 1):
            at = let(at, deeper(level))
        return at

    def of(self, ident: Column) -> Column:
        """The bucket of an id, by its ident()."""
        levels, found = self.levels, F.lit(-1)
        for level in reversed(range(len(levels))):
            nodes, size, *_ = levels[level]
            self.levels = levels[: level + 1]
            table = _constant([self.bucket[level].get((k, c), -1) for k in range(len(nodes)) for c in range(size)], "int")
            here = let(self._walk(ident), _looked_up(table, size))
            found = let(here, _either(found))
        self.levels = levels
        return found


def _looked_up(table: Column, size: int):
    return lambda at: F.when(at["node"] < 0, F.lit(-1)).otherwise(F.get(table, at["node"] * size + at["cell"]))


def _either(other: Column):
    return lambda here: F.when(here >= 0, here).otherwise(other)


def _in_parts(placed: DataFrame, found: Buckets, tie: Column, leads: Column) -> tuple[DataFrame, Column, int]:
    """placed with the buckets of crowded ids dealt over their parts by a hash of 32 bits, what marks the first rows, and the number of buckets.

    One count finds the parts that have rows; there are fewer of them than two for each bucket's worth of rows.
    """
    parts = F.get(_constant(found.parts, "bigint"), F.col("_bucket"))
    part = F.shiftright(tie * parts, 32).cast("int")  # 0 where a bucket has one part
    first = [0, *itertools.accumulate(found.parts)]
    slot = F.get(_constant(first[:-1], "int"), F.col("_bucket")) + part
    top = {r["slot"]: r["top"] for r in placed.where(parts > 1).groupBy(slot.alias("slot")).agg(F.max(tie).alias("top")).collect()}
    whole = {first[i] for i, n in enumerate(found.parts) if n == 1}
    held = sorted(whole | top.keys())
    number = dict(zip(held, range(len(held)), strict=True))
    tops = F.get(_constant([top.get(x, -1) for x in range(first[-1])], "bigint"), slot)
    leads = leads & ((tops < 0) | (tops == tie))
    numbers = F.get(_constant([number.get(x, -1) for x in range(first[-1])], "int"), slot)
    return placed.withColumn("_leads", leads).withColumn("_bucket", numbers), F.col("_leads"), len(held)


def with_next(rows: DataFrame, id_col: str, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, cells: int = CELLS) -> DataFrame:
    """rows with next_<column>: the values of the next row by descending id, of the first row after the last.

    Rows are dealt by buckets of neighbouring ids and the window runs within a bucket.
    The first row of a bucket is also sent, as a ghost, to the end of the bucket above
    it, so one shuffle serves all.  Null ids stand after all others.  Rows that share an
    id, or have none, follow each other by the hash of their columns, which also deals
    them over several buckets where they are more than one should have.  So only rows
    that are alike in id and columns always stand together.
    """
    ident = F.col(id_col).cast("bigint")
    found = Buckets(rows.select(ident.alias("id")), rows_per_bucket, cells)
    placed = rows.withColumn("_ident", found.ident(ident)).withColumn("_bucket", found.of(F.col("_ident")))
    total, order = len(found.heads), [ident.desc_nulls_last(), *[F.xxhash64(c) for c in columns]]
    leads = F.col("_ident") == F.get(_constant(found.heads or [0], "decimal(20,0)"), F.col("_bucket"))
    if max(found.parts, default=1) > 1:
        tie = F.shiftrightunsigned(F.xxhash64(*columns), 32)
        placed, leads, total = _in_parts(placed, found, tie, leads)
        order.insert(1, tie.desc())
    above = F.pmod(F.col("_bucket") + 1, F.lit(max(1, total)))
    place = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("ghost")))
    ghost = F.array(F.struct(above.alias("b"), F.lit(True).alias("ghost")))
    dealt = placed.withColumn("_place", F.explode(F.when(leads, F.concat(place, ghost)).otherwise(place))).drop("_ident")
    window = W.partitionBy("_place.b").orderBy("_place.ghost", *order)
    following = F.lead(F.struct(*columns)).over(window)
    return (
        dealt.withColumn("_next", following).where(~F.col("_place.ghost"))
        .select(*rows.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])
    )


def op2_closed_syncmers(spark, sf_dir):
    """Anchors and fingerprints of all documents, and fingerprints of their edited texts.

    Only texts are shuffled; anchors are found after that.
    """
    docs = documents(spark, sf_dir).select("doc_id", body().alias("body"))
    paired = with_next(docs, "doc_id", ["body"])
    n = F.length("body")
    half = F.floor(n / 2).cast("int")
    edited = paired.select(
        "doc_id", n.cast("bigint").alias("n_chars"), "body", "next_body",
        F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.col("next_body"), F.lit(1), half)).alias("edited"),
    )
    done = with_anchors(edited, "body", "anchors").withColumn("sketch", anchor_set(F.col("anchors")))
    for text in "next", "edited":
        done = with_sketch(done, "next_body" if text == "next" else "edited", f"{text}_sketch")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        "anchors",
    )
