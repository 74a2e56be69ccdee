"""The strain mixture as relations: presence (fam, strain) and depth (fam, y)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import connected
from .tables import grouped_quantiles, kept, quantiles, released, running, shuffled


def families(nodes: DataFrame) -> DataFrame:
    """(fam, y) of the graph's nodes."""
    return nodes.select(F.col("nid").alias("fam"), F.col("weight").cast("double").alias("y"))


def gram(presence: DataFrame) -> DataFrame:
    """(s, t, g): in how many families two strains occur together, s <= t."""
    a, b = presence.select("fam", F.col("strain").alias("s")), presence.select("fam", F.col("strain").alias("t"))
    return a.join(b, "fam").where("s <= t").groupBy("s", "t").agg(F.count("*").alias("g"))


def rhs(presence: DataFrame, depth: DataFrame) -> DataFrame:
    return presence.join(depth, "fam").groupBy("strain").agg(F.sum("y").alias("b"))


#: Slack of bounds on sizes, which are products with a decimal share.
ROUNDING = 1e-9
#: Share of a fence that a depth may lie above it, as both are rounded.
AT_FENCE = 1e-12


def equal_strains(presence: DataFrame) -> DataFrame:
    """(strain, like, n): the smallest strain with the same families, told by two sums of 64-bit hashes and their number."""
    total = lambda x: F.sum(x.cast("decimal(20,0)"))
    signed = presence.groupBy("strain").agg(F.count("*").alias("n"), total(F.xxhash64("fam")).alias("p"), total(F.xxhash64(F.lit(1), F.xxhash64("fam"), "fam")).alias("q"))
    least = signed.groupBy("n", "p", "q").agg(F.min("strain").alias("like"))
    return signed.join(least, ["n", "p", "q"]).select("strain", "like", "n")


def candidate_strains(presence: DataFrame, least: float) -> DataFrame:
    """(s, t, ns, nt) of strains that may agree by `least`, s < t: of like size, and with enough families in common among the rarest of both.

    Two sets that agree by that share a family among their first n - ceil(least * n) + 1
    in any one order of all families; here the rarest come first.  Families that are not among
    those of both lie behind the first ones of one of the two, so what a pair shares there and
    the longer of the rests bound what it shares at all.
    """
    counts = presence.groupBy("fam").agg(F.count("*").alias("_c"))
    order = W.partitionBy("strain").orderBy("_c", "fam")
    placed = presence.join(counts, "fam").select("strain", "fam", F.row_number().over(order).alias("_i"), F.count("*").over(W.partitionBy("strain")).alias("_n"))
    rest = lambda n: F.greatest(F.ceil(F.lit(least) * n - ROUNDING) - 1, F.lit(0))
    first = placed.where(F.col("_i") <= F.col("_n") - rest(F.col("_n")))
    a = first.select("fam", F.col("strain").alias("s"), F.col("_n").alias("ns"))
    b = first.select("fam", F.col("strain").alias("t"), F.col("_n").alias("nt"))
    sized = F.least("ns", "nt") >= F.lit(least) * F.greatest("ns", "nt") - ROUNDING
    met = a.join(b, "fam").where((F.col("s") < F.col("t")) & sized).groupBy("s", "t", "ns", "nt").agg(F.count("*").alias("_m"))
    most = F.least(F.col("_m") + F.greatest(rest(F.col("ns")), rest(F.col("nt"))), "ns", "nt")
    return met.where(most * (1 + least) >= F.lit(least) * (F.col("ns") + F.col("nt")) - ROUNDING).select("s", "t", "ns", "nt")


def similar_sets(presence: DataFrame, least: float) -> DataFrame:
    """(s, t, jaccard) of strains whose families agree by at least `least`, s < t; the families of candidates alone are counted."""
    pairs = candidate_strains(presence, least)
    own = pairs.join(presence.select(F.col("strain").alias("s"), "fam"), "s")
    both = own.join(presence.select(F.col("strain").alias("t"), "fam"), ["t", "fam"]).groupBy("s", "t", "ns", "nt").agg(F.count("*").alias("g"))
    jaccard = F.col("g") / (F.col("ns") + F.col("nt") - F.col("g"))
    return both.select("s", "t", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


def similar_strains(presence: DataFrame, least: float = 0.95) -> DataFrame:
    """(s, t, jaccard) of strains whose families agree by at least `least`, s < t.

    Strains of the same families are compared once; their pairs are put back.
    """
    like = kept(equal_strains(presence))
    one = presence.join(like.where("strain = like").select("strain"), "strain", "left_semi")
    found = similar_sets(one, least)
    of = lambda c: like.select(F.col("like").alias(f"_{c}"), F.col("strain").alias(c))
    across = found.select(F.col("s").alias("_s"), F.col("t").alias("_t"), "jaccard").join(of("s"), "_s").join(of("t"), "_t")
    ordered = across.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), "jaccard")
    same = of("s").join(of("t"), F.col("_s") == F.col("_t")).where("s < t").select("s", "t", F.lit(1.0).alias("jaccard"))
    return ordered.unionByName(same)


def collapse(presence: DataFrame, least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Presence of groups of like strains (single linkage), and (strain, component)."""
    like = kept(equal_strains(presence))
    one = presence.join(shuffled(like.where("strain = like").select("strain")), "strain", "left_semi")
    pairs = similar_sets(one, least).select(F.col("s").alias("a"), F.col("t").alias("b"))
    groups = connected(pairs, like.where("strain = like").select(F.col("strain").alias("node")))
    members = kept(like.join(groups, F.col("like") == F.col("node")).select("strain", "component"))
    released(like)
    return presence.join(shuffled(members), "strain").select("fam", F.col("component").alias("strain")).distinct(), members


def grouped_fence(depth: DataFrame, group: str) -> DataFrame:
    """fence() of each group of families, by its own depths; a group without a positive depth keeps those of 0."""
    q = grouped_quantiles(depth.where("y > 0"), group, "y", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    top = q.select(group, F.when(F.col("q3") > F.col("q1"), F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).otherwise(20 * F.col("q2")).alias("_top"))
    return depth.join(top, group, "left").where((F.col("y") <= F.col("_top") * (1 + AT_FENCE)) | (F.col("y") == 0)).select(*depth.columns)


def fence(depth: DataFrame) -> DataFrame:
    """Families whose depth is no outlier: at most q3 + 3 IQR of the positive depths, or 20 medians if the IQR is 0."""
    q1, q2, q3 = quantiles(depth.where("y > 0"), "y", [0.25, 0.5, 0.75])
    if q2 is None:
        return depth.where("y = 0")
    top = q3 + 3 * (q3 - q1) if q3 > q1 else 20 * q2
    return depth.where((F.col("y") <= top * (1 + AT_FENCE)) | (F.col("y") == 0))


def ordered(depth: DataFrame) -> DataFrame:
    """depth with fam_ord: the place of a family by id."""
    return running(depth, "fam", F.lit(1), "_upto").withColumn("fam_ord", (F.col("_upto") - 1).cast("bigint")).drop("_upto")


def fold_of(place: Column, n: int, folds: int = 5, seed: int = 0, block: int = 1 << 20) -> Column:
    """The draw of NumPy's seeded generator at a place below n.

    The driver passes over the draws once and keeps the generator's state before each
    block of them; a task draws only the blocks that its rows need, one at a time.
    """
    rng, states = np.random.default_rng(seed), []
    for _ in range(0, n, block):
        states.append(rng.bit_generator.state)
        rng.integers(0, folds, size=block)

    @F.pandas_udf("long")
    def draw(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, fold = -1, np.zeros(0, np.int64)
        for part in series:
            at = part.to_numpy()
            out = np.zeros(len(at), np.int64)
            for b in np.unique(at // block):
                if b != held:
                    own = np.random.default_rng(seed)
                    own.bit_generator.state = states[b]
                    held, fold = b, own.integers(0, folds, size=block)
                mine = at // block == b
                out[mine] = fold[at[mine] % block]
            yield pd.Series(out)

    return draw(place)


def seeded_folds(depth: DataFrame, folds: int = 5, seed: int = 0, block: int = 1 << 20) -> DataFrame:
    """depth (with fam_ord) with fold: the fam_ord-th draw of NumPy's seeded generator."""
    return depth.withColumn("fold", fold_of(F.col("fam_ord"), depth.count(), folds, seed, block))


def fold_moments(presence: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, s, t, g, b): Gram pieces by fold; b is set where s = t."""
    rows = presence.join(folds.select("fam", "fold", "y"), "fam")
    a = rows.select("fam", "fold", "y", F.col("strain").alias("s"))
    b = presence.select("fam", F.col("strain").alias("t"))
    both = a.join(b, "fam").where("s <= t")
    return both.groupBy("fold", "s", "t").agg(F.count("*").alias("g"), F.sum(F.when(F.col("s") == F.col("t"), F.col("y"))).alias("b"))


def deviance(presence: DataFrame, folds: DataFrame, models: DataFrame, floor: float | str) -> DataFrame:
    """(fold, k, error): mean Poisson deviance of held-out families under models (fold, k, strain, x).

    Families without a carrier in the model have the floor as their expectation: a number,
    or the name of a column of folds.
    """
    tried = models.select("fold", "k").distinct()
    mu = presence.join(folds.select("fam", "fold"), "fam").join(models.where("strain is not null"), ["fold", "strain"]).groupBy("fold", "k", "fam").agg(F.sum("x").alias("mu"))
    least = F.col(floor) if isinstance(floor, str) else F.lit(floor)
    rows = folds.select("fam", "fold", "y", least.alias("_floor")).join(tried, "fold").join(mu, ["fold", "k", "fam"], "left")
    m = F.coalesce("mu", F.lit(0.0)) + F.col("_floor")
    y = F.col("y")
    each = 2 * (F.when(y > 0, y * F.log(y / m)).otherwise(F.lit(0.0)) - (y - m))
    return rows.groupBy("fold", "k").agg((F.sum(each) / F.count("*")).alias("error"))


def out_of_reach(presence: DataFrame, depth: DataFrame) -> DataFrame:
    """(fam) of families that have strains, but none with a covered family: no model expects them, so all give them the same error."""
    near = presence.join(shuffled(depth.where("y > 0").select("fam")), "fam", "left_semi").select("strain").distinct().withColumn("_near", F.lit(True))
    return presence.join(near, "strain", "left").groupBy("fam").agg(F.max("_near").alias("_near")).where("_near is null").select("fam")


def unmoved_error(presence: DataFrame, folds: DataFrame, floor: float | str) -> DataFrame:
    """(fold, unmoved): the part of deviance() that is the same in all models, by the families out of reach; inside the fence."""
    least = F.col(floor) if isinstance(floor, str) else F.lit(floor)
    rows = folds.join(out_of_reach(presence, folds).withColumn("_out", F.lit(True)), "fam", "left")
    return rows.groupBy("fold").agg((F.sum(F.when(F.col("_out"), 2 * least).otherwise(F.lit(0.0))) / F.count("*")).alias("unmoved"))


def shell_priority(nodes: DataFrame, presence: DataFrame) -> DataFrame:
    """(strain, priority): covered shell families of each strain."""
    shell = nodes.where("partition = 'S' and weight > 0").select("nid")
    hits = presence.join(shell, presence["fam"] == shell["nid"]).groupBy("strain").agg(F.count("*").alias("priority"))
    return presence.select("strain").distinct().join(hits, "strain", "left").select("strain", F.coalesce("priority", F.lit(0)).alias("priority"))
