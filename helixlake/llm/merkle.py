"""Merkle manifest of a dataset: a root for each group of rows, one root over all groups, and a proof for each row.

A row is a leaf, and every two consecutive nodes become the hash of their hex texts; a
node without a partner becomes the hash of its own.  Leaves of a group are numbered in
the order of their ids by range partitions, so no group meets in one task, and are
dealt in aligned blocks of 2**BITS.

1. One pass over each block gives its root.  Roots of blocks are the nodes of the next
   round, until each group has one block: a round for every BITS levels.
2. Going down again, each block is traversed leaf by leaf: a treehash stack for each
   level prepares the sibling that is needed next, and every leaf takes a bounded number
   of steps, so a task holds a few nodes for each level beside the block's leaves.
   The path above the block is the same for all its leaves and is appended.

Only digests are shuffled, never the rows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, documents, quoted, resting_on, written

BITS = 12
#: Ranges of a group that may be broadcast: one row for each group and range partition.
BROADCAST_RANGES = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: list[Column]) -> Column:
    """sha256 (hex) of values one after the other: `-` for null, else their bytes' number, `:` and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def parent(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node above two hex digests; right may be missing, and then left may be."""
    if left is None:
        return None
    return hashlib.sha256(left + (right or b"")).hexdigest().encode()


class Treehash:
    """Builds the node of one level from its first leaf on, one step at a time, on a stack of a node for each level."""

    def __init__(self, leaves: list[bytes], level: int):
        self.leaves, self.level, self.stack, self.done = leaves, level, [], True

    def start(self, leaf: int) -> None:
        self.at, self.stack, self.done = leaf, [], leaf >= len(self.leaves)
        if self.done:
            self.stack.append((0, None))

    def low(self) -> int:
        """The level of the next step's node: the lowest goes first."""
        return 1 << 30 if self.done else self.stack[-1][0] if self.stack else self.level

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, right = stack.pop()
            stack[-1] = (level + 1, parent(stack[-1][1], right))
        else:
            stack.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at += 1
        self.done = len(stack) == 1 and stack[0][0] == self.level


def treehash(leaves: list[bytes], height: int, keep: dict | None = None) -> bytes:
    """The root of a block of that height; keep gets the first two nodes of each level, by (level, number)."""
    stack: list[tuple[int, int, bytes | None]] = []
    for i in range(1 << height):
        level, number, node = 0, i, leaves[i] if i < len(leaves) else None
        while True:
            if keep is not None and number < 2:
                keep[level, number] = node
            if not (stack and stack[-1][0] == level):
                break
            _, number, left = stack.pop()
            level, number, node = level + 1, number // 2, parent(left, node)
        stack.append((level, number, node))
    return stack[0][2]


def traverse(leaves: list[bytes], height: int) -> Iterator[list[str]]:
    """The path of each leaf in turn: for each level `<` or `>` and the sibling to its left or right, or `` for none."""
    first: dict = {}
    treehash(leaves, height, first)
    siblings = [first.get((h, 1)) for h in range(height)]
    stacks = [Treehash(leaves, h) for h in range(height)]
    for h, s in enumerate(stacks):
        s.stack = [(h, first[h, 0])]
    low = [s.low() for s in stacks]
    for leaf in range(len(leaves)):
        yield [("<" if leaf >> h & 1 else ">") + x.decode() if x else "" for h, x in enumerate(siblings)]
        for h in range(height):
            if (leaf + 1) % (1 << h):
                break
            siblings[h] = stacks[h].stack[0][1]
            stacks[h].start((leaf + 1 + (1 << h)) ^ (1 << h))
            low[h] = stacks[h].low()
        for _ in range(2 * height - 1):
            if (least := min(low)) == 1 << 30:
                break
            h = low.index(least)
            stacks[h].step()
            low[h] = stacks[h].low()


def levels(n: int, bits: int) -> int:
    """Levels of a block in a tree of n leaves."""
    return min(bits, (n - 1).bit_length())


def _ordered(block: pa.Table) -> tuple[pa.Table, list[bytes]]:
    block = block.take(pc.sort_indices(block["pos"]))
    return block, [x.encode() for x in block["digest"].to_pylist()]


def block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """(g, pos, n, digest) of the roots of blocks of nodes (g, pos, n, digest), as a written table."""

    def root(block: pa.Table) -> pa.Table:
        block, leaves = _ordered(block)
        n, pos = block["n"][0].as_py(), block["pos"][0].as_py()
        top = treehash(leaves, levels(n, bits)).decode()
        return pa.table({"g": block["g"][:1], "pos": pa.array([pos >> bits]), "n": pa.array([-(-n >> bits)]), "digest": [top]})

    blocks = nodes.select("g", "pos", "n", "digest", F.shiftright("pos", bits).alias("block")).groupBy("g", "block")
    return written(blocks.applyInArrow(root, "g string, pos long, n long, digest string"))


def with_paths(nodes: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """nodes, all columns, with what their block has in upper, and their path within the block before upper's path."""
    own, more = nodes.columns, [c for c in upper.columns if c not in ("g", "pos", "path")]

    def appended(block: pa.Table, above: pa.Table) -> pa.Table:
        block, leaves = _ordered(block)
        rest = above["path"][0].as_py()
        paths = [p + rest for p in traverse(leaves, levels(block["n"][0].as_py(), bits))]
        found = {c: block[c] for c in own} | {"path": pa.array(paths, pa.list_(pa.string()))}
        same = pa.array(np.zeros(block.num_rows, np.int64))
        return pa.table(found | {c: above[c].take(same) for c in more})

    kinds = dict(upper.dtypes)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in nodes.dtypes), "path array<string>", *(f"`{c}` {kinds[c]}" for c in more)])
    left = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("g", "block")
    right = upper.withColumnRenamed("pos", "block").groupBy("g", "block")
    return left.cogroup(right).applyInArrow(appended, schema)


def upper_paths(nodes: DataFrame, bits: int) -> DataFrame:
    """(g, pos, path, top) of each block of nodes: the path from its root to the top of its group, as a written table."""
    roots = block_roots(nodes, bits)
    if (roots.agg(F.max("n")).first()[0] or 0) <= 1:
        return resting_on(roots.select("g", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top")), roots)
    above = upper_paths(roots, bits)
    out = written(with_paths(roots, above, bits).select("g", "pos", "path", "top"))
    discard(roots, above)
    return out


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, their place from 0 in their group g by the order of columns, and n, the rows of the group.

    Rows are sorted by range partitions; what meets are counts, one for each group and partition.
    """
    spread = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = written(spread.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = F.sum("rows").over(W.partitionBy("g").orderBy("part")) - F.col("rows")
    ranges = written(counts.select("g", "part", "first", before.alias("before"), F.sum("rows").over(W.partitionBy("g")).alias("n")))
    few = ranges.count() <= BROADCAST_RANGES
    told = placed.join(F.broadcast(ranges) if few else ranges, ["g", "part"])
    out = written(told.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n"))
    discard(placed, ranges)
    return out


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, claims: Column | None = None, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: id, group, leaf, claimed, proof, subroot, root.

    A leaf is the digest() of the given columns.  proof lists, from the leaf up to the
    root over all groups, `<` or `>` and the sibling to the left or right, or an empty
    text at a level without one.  `claims` is a leaf that is held against the
    proof by folded(), the row's own unless given.

    Groups are ordered by name, bytewise, null first; rows by id, null first, and by leaf
    where ids are equal, so repeated rows are leaves of their own.  Null and empty values
    differ; other columns are ignored, texts may be of any length, and an empty table has
    no row and no root.
    """
    leaf = digest([quoted(c) for c in columns])
    name = F.when(quoted(group_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), quoted(group_col).cast("string")))
    rows = docs.select(name.alias("g"), quoted(id_col).alias("id"), quoted(group_col).alias("name"), leaf.alias("digest"), (leaf if claims is None else claims).alias("claimed"))
    leaves = numbered(rows, "id", "digest")
    upper = upper_paths(leaves, bits)
    subroots = numbered(upper.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("top").alias("digest")), "of")
    crown = upper_paths(subroots, bits)
    tops = written(with_paths(subroots, crown, bits).select(F.col("of").alias("g"), F.col("path").alias("crown"), F.col("top").alias("root")))
    whole = written(upper.join(tops, "g").select("g", "pos", F.concat("path", "crown").alias("path"), F.col("top").alias("subroot"), "root"))
    discard(upper, subroots, crown, tops)
    out = with_paths(leaves, whole, bits)
    return resting_on(out.select(F.col("id").alias(id_col), F.col("name").alias(group_col), F.col("digest").alias("leaf"), "claimed", F.col("path").alias("proof"), "subroot", "root"), leaves, whole)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof of manifest() lead to."""
    rest = lambda s: F.substring(s, 2, 64)
    both = lambda h, s: F.when(s.startswith("<"), F.concat(rest(s), h)).otherwise(F.concat(h, rest(s)))
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(both(h, s), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof of manifest(), one after the other."""
    return F.translate(F.array_join(proof, ""), "<>", "")


def op11_merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir).select(*COLUMNS)
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.when(changed, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    claims = digest([more if c == "n_chars" else F.col(c) for c in COLUMNS])
    found = manifest(docs, claims=claims)
    root = folded(F.col("claimed"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    parts = [n_chars if c == "n_chars" else c for c in COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen(({p})::varchar)::varchar || ':' || ({p})::varchar, '-')" for p in parts) + ")"


#: The same sums level by level; crc32 bit by bit.
OP11_SQL = f"""
WITH RECURSIVE
b AS (
  SELECT *, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k::int) & 1)::bigint)))),
      lambda x, y: xor(x >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384::bigint ELSE 0::bigint END)), 4294967295::bigint) AS crc
  FROM documents),
d AS (SELECT doc_id, g, {_sql_leaf("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_sql_leaf("n_chars + 1")} ELSE {_sql_leaf("n_chars")} END AS claimed FROM b),
l AS (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS lvl, pos, n, leaf AS h FROM l
  UNION ALL SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM sub
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
r AS (SELECT h AS root FROM u WHERE n = 1),
low AS (SELECT l.rid, string_agg(t.h, '' ORDER BY t.lvl) AS s FROM l JOIN t ON t.g = l.g AND t.n > 1 AND t.pos = xor(l.pos >> t.lvl, 1) GROUP BY l.rid),
high AS (SELECT sub.g, string_agg(u.h, '' ORDER BY u.lvl) AS s FROM sub JOIN u ON u.n > 1 AND u.pos = xor(sub.pos >> u.lvl, 1) GROUP BY sub.g),
f AS (SELECT rid, g, 0 AS lvl, pos, n, claimed AS h FROM l
  UNION ALL SELECT f.rid, f.g, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END)
  FROM f LEFT JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.pos = xor(f.pos, 1) WHERE f.n > 1),
k AS (SELECT f.rid, 0 AS lvl, sub.pos, sub.n, f.h FROM f JOIN sub USING (g) WHERE f.n = 1
  UNION ALL SELECT k.rid, k.lvl + 1, k.pos // 2, (k.n + 1) // 2, sha256(CASE WHEN k.pos % 2 = 1 THEN u.h || k.h ELSE k.h || coalesce(u.h, '') END)
  FROM k LEFT JOIN u ON u.lvl = k.lvl AND u.pos = xor(k.pos, 1) WHERE k.n > 1)
SELECT l.doc_id, l.leaf, sub.subroot, r.root, sha256(coalesce(low.s, '') || coalesce(high.s, '')) AS proof_sha256, k.h AS folded_root, k.h = r.root AS verified
FROM l JOIN sub ON sub.g = l.g CROSS JOIN r LEFT JOIN low ON low.rid = l.rid LEFT JOIN high ON high.g = l.g JOIN k ON k.rid = l.rid AND k.n = 1
"""
