"""Exact de-duplication by progressive refinement (length, prefix hash, full hash).

Only SQL functions; no Python runs on the executors.

1. Lengths: one aggregation counts the rows of each length; a length that occurs
   once belongs to a text that has no copy.
2. Prefix hash: rows of the remaining lengths are counted by length and the hash
   of their first characters.
3. Full hash: only rows whose (length, prefix) occurs again are hashed in full
   and grouped by that hash.

All three aggregations combine on the map side, so a group that holds a third of
the rows reaches its reducer as one row for each map task.  Rows find their group
by an equi-join that adaptive execution may split on the row side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import body, discard, documents, every, quoted, resting_on, unused, written

PREFIX_CHARS = 64
#: Lengths that may be broadcast, 8 bytes each.  There are no more of them than the longest text has characters.
BROADCAST_LENGTHS = 1_000_000
#: Surviving (length, prefix) cells that may be broadcast: 16 bytes each, 3 MB in all.
BROADCAST_CELLS = 200_000
#: Texts with copies that may be broadcast: a hash of 64 characters and an id each.
BROADCAST_GROUPS = 500_000


def surviving_cells(docs: DataFrame, text_col: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """(n, p) of every length and prefix hash that two or more rows have, as a written table.

    The lengths are broadcast after a count, so rows of a frequent length stay where they
    are and are counted there first.  Beyond the bound rows are counted before they meet
    the lengths.
    """
    lengths = written(docs.select(F.length(body(text_col)).alias("n")).groupBy("n").agg(F.count("*").alias("rows")).where("rows > 1").select("n"))
    keyed = docs.select(F.length(body(text_col)).alias("n"), F.xxhash64(F.substring(body(text_col), 1, prefix)).alias("p"))
    counted = F.count("*").alias("rows")
    if lengths.count() <= BROADCAST_LENGTHS:
        cells = keyed.join(F.broadcast(lengths), "n", "left_semi").groupBy("n", "p").agg(counted)
    else:
        cells = keyed.groupBy("n", "p").agg(counted).join(lengths, "n", "left_semi")
    found = written(cells.where("rows > 1").select("n", "p"))
    discard(lengths)
    return found


def copy_groups(docs: DataFrame, cells: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """(text_sha256, n, keep_id, group_size) of every text that two or more rows have; cells: surviving_cells() of docs.

    keep_id is the largest id of the group; null ids count as rows and never win
    against an id.  Rows that repeat an id count each.
    """
    keyed = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body"), F.length(body(text_col)).alias("n"), F.xxhash64(F.substring(body(text_col), 1, prefix)).alias("p"))
    full = F.sha2(F.col("body"), 256).alias("text_sha256")
    if cells.count() <= BROADCAST_CELLS:
        cand = keyed.join(F.broadcast(cells), ["n", "p"], "left_semi").select("id", "n", full)
    else:  # too many cells to broadcast: hash first, so that no text is shuffled
        cand = keyed.select("id", "n", "p", full).join(cells, ["n", "p"], "left_semi")
    groups = cand.groupBy("text_sha256", "n").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return written(groups.where("group_size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text is the empty text; all empty texts are copies of each other.  Of
    equal texts the largest id stays; if rows repeat an id they share its verdict.
    Other columns of docs are ignored.  An empty table gives an empty result.
    """
    cells = surviving_cells(docs, text_col, prefix)
    found = copy_groups(docs, cells, id_col, text_col, prefix)
    discard(cells)
    groups = F.broadcast(found) if found.count() <= BROADCAST_GROUPS else found
    rows = docs.select(F.col(id_col).alias("id"), F.length(body(text_col)).alias("n"), F.sha2(body(text_col), 256).alias("text_sha256"))
    keep = F.coalesce("keep_id", "id")
    out = rows.join(groups, ["text_sha256", "n"], "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
    return resting_on(out, found)


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True, prefix: int = PREFIX_CHARS) -> DataFrame:
    """docs, all columns, without the copies that exact_dedup() drops; decided row by row.

    A row goes only if a row with its text stays.  Rows that repeat both the id and the
    text of the row that stays go only if `repeats` is off: then one row of each text is
    left.  Of rows without an id one stays where no row with an id has the text, in
    either case.  Columns of any name and type pass through.

    Only texts whose length and prefix hash occur again are hashed in full.
    """
    cells = surviving_cells(docs, text_col, prefix)
    found = copy_groups(docs, cells, id_col, text_col, prefix)
    n, p, cell, sha, keep, copied, row, rank = unused(docs, "__n", "__p", "__cell", "__sha", "__keep", "__copied", "__row", "__rank")
    keyed = docs.select(*every(docs), F.length(body(text_col)).alias(n), F.xxhash64(F.substring(body(text_col), 1, prefix)).alias(p))
    if cells.count() <= BROADCAST_CELLS:
        keyed = keyed.join(F.broadcast(cells.select(F.col("n").alias(n), F.col("p").alias(p), F.lit(True).alias(cell))), [n, p], "left")
    else:  # too many cells to broadcast: hash all texts, so that none is shuffled for this
        keyed = keyed.withColumn(cell, F.lit(True))
    # a text without a copy gets a key that no digest equals, and that spreads such rows
    full = F.when(F.col(cell), F.sha2(body(text_col), 256)).otherwise(F.hex(p))
    groups = found.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(copied))
    few = groups.count() <= BROADCAST_GROUPS
    told = keyed.select(*every(docs), full.alias(sha)).join(F.broadcast(groups) if few else groups, sha, "left")
    one = F.col(copied).isNull()
    if repeats:
        one = one | (F.col(id_col) == F.col(keep))
    chosen = told.where(F.col(copied) & F.col(id_col).eqNullSafe(F.col(keep)))
    if repeats:
        chosen = chosen.where(F.col(keep).isNull())
    # combines on the map side, so a text that is repeated often reaches its reducer as one row for each task
    hashed = F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if "map<" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema])
    picked = chosen.select(sha, F.struct(*every(docs)).alias(row), hashed.alias(rank)).groupBy(sha).agg(F.min_by(row, rank).alias(row)).select(f"{row}.*")
    return resting_on(told.where(one).select(*every(docs)).union(picked), cells, found)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
