"""Gene content of resolved strains: observed, imputed and reassigned families."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .graph import neighbours

#: Subsets of components are listed for at most this many components (4095 subsets).
MOST_COMPONENTS = 12
TIE = 1e-9


def carriers(presence: DataFrame, members: DataFrame) -> DataFrame:
    """(nid, component): families that some member of a component carries."""
    return presence.join(members.select("strain", "component"), "strain").select("nid", "component").distinct()


def observed(nodes: DataFrame, carried: DataFrame, abundance: DataFrame) -> DataFrame:
    """Covered families, shared among their carriers by abundance; evenly if all abundances are zero."""
    w = W.partitionBy("nid")
    rows = nodes.where("weight > 0").select("nid", "weight").join(carried, "nid").join(abundance, "component")
    total = F.sum("a").over(w)
    share = F.when(total > 0, F.col("weight") * F.col("a") / total).otherwise(F.col("weight") / F.count("*").over(w))
    return rows.select("component", F.col("nid").alias("family"), share.alias("abundance"), F.lit("observed").alias("status"))


def imputed(nodes: DataFrame, edges: DataFrame, carried: DataFrame, abundance: DataFrame, least: float = 0.5) -> DataFrame:
    """Uncovered families whose neighbours within a carrier are covered often enough."""
    near = neighbours(edges)
    empty = nodes.where("weight = 0").select("nid").join(carried, "nid")
    other = carried.select(F.col("nid").alias("other"), "component")
    weights = nodes.select(F.col("nid").alias("other"), F.col("weight").alias("w"))
    rows = empty.join(near, "nid").join(other, ["other", "component"]).join(weights, "other")
    share = rows.groupBy("nid", "component").agg((F.count_if(F.col("w") > 0) / F.count("*")).alias("share"))
    good = share.where((F.col("share") >= least) & (F.col("share") > 0)).join(abundance, "component")
    return good.select("component", F.col("nid").alias("family"), (F.col("a") * F.col("share")).alias("abundance"), F.lit("imputed").alias("status"))


def subsets(abundance: DataFrame) -> list[tuple[float, int, list[int], list]]:
    """(total, size, places, components) of every non-empty subset of the components, at most 4095."""
    rows = sorted((r["component"], r["a"]) for r in abundance.select("component", "a").limit(MOST_COMPONENTS + 1).collect())
    if len(rows) > MOST_COMPONENTS:
        raise ValueError(f"more than {MOST_COMPONENTS} components")
    out = []
    for mask in range(1, 1 << len(rows)):
        places = [i for i in range(len(rows)) if mask >> i & 1]
        out.append((float(sum(rows[i][1] for i in places)), len(places), places, [rows[i][0] for i in places]))
    return out


def reassigned(nodes: DataFrame, edges: DataFrame, carried: DataFrame, abundance: DataFrame, most: float = 0.5) -> DataFrame:
    """Covered families without a carrier, given to the subset of components whose abundances fit best.

    Among subsets that fit equally well, the one with the most support from carriers of
    neighbouring families wins, then the smaller, then the one with the first places.
    The totals of the subsets are an array in each row's reach, so a row is passed over
    them once and only subsets that fit best become rows.
    """
    near, spark = neighbours(edges), nodes.sparkSession
    orphans = nodes.where("weight > 0").select("nid", "weight").join(carried.select("nid"), "nid", "left_anti")
    listed = subsets(abundance)
    kind = dict(carried.dtypes)["component"]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(listed)], f"i int, total double, size int, places array<int>, parts array<{kind}>")
    totals = F.split(F.lit(",".join(repr(t) for t, *_ in listed)), ",").cast("array<double>")
    miss = F.transform(totals, lambda t: F.abs(F.col("weight") - t))
    fits = F.transform(totals, lambda t, i: F.when(F.abs(F.col("weight") - t) <= F.col("least") + TIE, i))
    tied = orphans.withColumn("least", F.array_min(miss)).select("nid", "weight", F.explode(F.array_compact(fits)).alias("i"))
    tied = tied.join(F.broadcast(table), "i").withColumn("miss", F.abs(F.col("weight") - F.col("total")))  # the table has at most 4095 rows
    support = orphans.select("nid").join(near, "nid").join(carried.select(F.col("nid").alias("other"), "component"), "other").groupBy("nid", "component").agg(F.count("*").alias("n"))
    voted = tied.select("nid", "i", F.explode("parts").alias("component")).join(support, ["nid", "component"], "left")
    votes = voted.groupBy("nid", "i").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("votes"))
    best = tied.join(votes, ["nid", "i"]).groupBy("nid").agg(F.min_by(F.struct("weight", "total", "size", "parts", "miss"), F.struct(-F.col("votes"), "size", "places")).alias("b")).select("nid", "b.*")
    chosen = best.where(F.col("miss") / F.greatest("weight", "total") <= most)
    parts = chosen.select("nid", "weight", "total", "size", F.explode("parts").alias("component")).join(abundance, "component")
    share = F.when(F.col("total") > 0, F.col("weight") * F.col("a") / F.col("total")).otherwise(F.col("weight") / F.col("size"))
    return parts.select("component", F.col("nid").alias("family"), share.alias("abundance"), F.lit("reassigned").alias("status"))


def subset_totals(amounts: np.ndarray) -> np.ndarray:
    """The total of each subset of amounts by the bits of its number; 0 for the empty one."""
    out = np.zeros(1)
    for a in amounts:
        out = np.concatenate([out, out + a])
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def best_subsets(weight: pd.Series, amounts: pd.Series) -> pd.Series:
    """The numbers of the non-empty subsets of a row's amounts whose totals are nearest to its weight."""
    known: dict[bytes, np.ndarray] = {}
    out = []
    for w, a in zip(weight, amounts, strict=True):
        a = np.asarray(a, float)
        if (key := a.tobytes()) not in known:
            known[key] = subset_totals(a)[1:]
        miss = np.abs(w - known[key])
        out.append((np.flatnonzero(miss <= miss.min() + TIE) + 1).tolist())
    return pd.Series(out)


def reassigned_by_species(nodes: DataFrame, edges: DataFrame, carried: DataFrame, abundance: DataFrame, most: float = 0.5) -> DataFrame:
    """reassigned() for the families of many species: nid and component are structs (g, id), g the species.

    Each row carries the abundances of its species' components, so no table of subsets is
    made; subsets that fit equally well become rows.
    """
    near = neighbours(edges)
    listed = abundance.groupBy(F.col("component.g").alias("g")).agg(F.sort_array(F.collect_list(F.struct("component", "a"))).alias("of"))  # at most MOST_COMPONENTS of a species, or an error
    few = F.when(F.size("of") <= MOST_COMPONENTS, F.col("of")).otherwise(F.raise_error(F.lit(f"more than {MOST_COMPONENTS} components")))
    listed = listed.select("g", few.alias("of"))
    orphans = nodes.where("weight > 0").select("nid", "weight").join(carried.select("nid"), "nid", "left_anti")
    rows = orphans.join(listed, F.col("nid.g") == F.col("g")).withColumn("fit", F.explode(best_subsets("weight", F.transform("of", lambda x: x["a"]))))
    place = F.filter(F.sequence(F.lit(0), F.size("of") - 1), lambda i: F.col("fit").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    tied = rows.withColumn("places", place)
    tied = tied.withColumn("total", F.aggregate("places", F.lit(0.0), lambda acc, i: acc + F.get("of", i)["a"])).withColumn("parts", F.transform("places", lambda i: F.get("of", i)["component"]))
    tied = tied.select("nid", "weight", "fit", "places", "total", "parts", F.size("places").alias("size"), F.abs(F.col("weight") - F.col("total")).alias("miss"))
    support = orphans.select("nid").join(near, "nid").join(carried.select(F.col("nid").alias("other"), "component"), "other").groupBy("nid", "component").agg(F.count("*").alias("n"))
    voted = tied.select("nid", "fit", F.explode("parts").alias("component")).join(support, ["nid", "component"], "left")
    votes = voted.groupBy("nid", "fit").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("votes"))
    best = tied.join(votes, ["nid", "fit"]).groupBy("nid").agg(F.min_by(F.struct("weight", "total", "size", "parts", "miss"), F.struct(-F.col("votes"), "size", "places")).alias("b")).select("nid", "b.*")
    chosen = best.where(F.col("miss") / F.greatest("weight", "total") <= most)
    parts = chosen.select("nid", "weight", "total", "size", F.explode("parts").alias("component")).join(abundance, "component")
    share = F.when(F.col("total") > 0, F.col("weight") * F.col("a") / F.col("total")).otherwise(F.col("weight") / F.col("size"))
    return parts.select("component", F.col("nid").alias("family"), share.alias("abundance"), F.lit("reassigned").alias("status"))


def assign_by_species(nodes: DataFrame, edges: DataFrame, presence: DataFrame, members: DataFrame, abundance: DataFrame, least: float = 0.5, most: float = 0.5) -> DataFrame:
    """assign() for many species at once: ids are structs (g, id), g the species."""
    carried = carriers(presence, members)
    seen = observed(nodes, carried, abundance)
    return seen.unionByName(imputed(nodes, edges, carried, abundance, least)).unionByName(reassigned_by_species(nodes, edges, carried, abundance, most))


def assign(nodes: DataFrame, edges: DataFrame, presence: DataFrame, members: DataFrame, abundance: DataFrame, least: float = 0.5, most: float = 0.5) -> DataFrame:
    """component, family, abundance, status of all families that can be given to a component."""
    carried = carriers(presence, members)
    seen = observed(nodes, carried, abundance)
    return seen.unionByName(imputed(nodes, edges, carried, abundance, least)).unionByName(reassigned(nodes, edges, carried, abundance, most))


def observed_depth(genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Presence (fam, strain) and depth (fam, y) of the observed and reassigned families, to solve again."""
    rows = genes.where("status in ('observed', 'reassigned')")
    return rows.select(F.col("family").alias("fam"), F.col("component").alias("strain")).distinct(), rows.groupBy(F.col("family").alias("fam")).agg(F.sum("abundance").alias("y"))


def status_counts(genes: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = ("observed", "reassigned", "imputed")
    return genes.groupBy(*(by or []), "component").agg(F.count("*").alias("n_genes"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names])
