"""Similarity search of sketches, and gathering of a minimum set cover."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept, once, released

SCORES = ("jaccard", "containment", "max_containment")
_GATHERED = "query string, round int, name string, f_query double, f_match double, shared long"
#: Pairs (hash, match) of one query that gather_sample() hands to one task, and matches that it does.
GROUP_PAIRS, MOST_MATCHES = 500_000, 4096


def shared_hashes(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query, name, shared, n_query for every pair that shares a hash; one equi-join, for which the index may be restricted to hashes of queries."""
    nq = queries.groupBy("query").agg(F.count("*").alias("n_query"))
    return queries.join(index.select("name", "h"), "h").groupBy("query", "name").agg(F.count("*").alias("shared")).join(nq, "query")


#: (name, n_match) of an index, or what makes it for names (name).
Sizes = DataFrame | Callable[[DataFrame], DataFrame]


def overlaps(queries: DataFrame, index: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """query, name, shared, n_query, n_match for every pair that shares a hash.

    sizes (name, n_match) of the index are counted unless given.
    """
    return _sized(shared_hashes(queries, index), index, sizes)


def _sized(shared: DataFrame, index: DataFrame, sizes: Sizes | None) -> DataFrame:
    if callable(sizes):
        shared = kept(shared)
        sizes = sizes(shared.select("name").distinct())
    nm = index.groupBy("name").agg(F.count("*").alias("n_match")) if sizes is None else sizes
    return shared.join(nm, "name").select("query", "name", "shared", "n_query", "n_match")


def search(queries: DataFrame, index: DataFrame, mode: str = "containment", threshold: float = 0.01, digits: int = 4, sizes: Sizes | None = None) -> DataFrame:
    """query, name, score, coverage, match_containment of all matches at or above the threshold.

    coverage is the Jaccard likeness of the two sketches, match_containment the share
    of the match that the query holds.  Sizes that are made for names are made for
    matches alone: no Jaccard likeness is above the containment.
    """
    if mode not in SCORES:
        raise ValueError(f"unknown score {mode!r}")
    shared = shared_hashes(queries, index)
    if mode != "max_containment":
        shared = shared.where(F.col("shared") / F.col("n_query") >= threshold)
    both = _sized(shared, index, sizes)
    jaccard = F.col("shared") / (F.col("n_query") + F.col("n_match") - F.col("shared"))
    score = {"jaccard": jaccard, "containment": F.col("shared") / F.col("n_query"), "max_containment": F.col("shared") / F.least("n_query", "n_match")}[mode]
    return both.where((score >= threshold) & (score > 0)).select(
        "query", "name", F.round(score, digits).alias("score"), F.round(jaccard, digits).alias("coverage"), F.round(F.col("shared") / F.col("n_match"), digits).alias("match_containment")
    )


def _cover(threshold: float, done: int = 0, uncovered: int | None = None, bound: tuple[int, str] | None = None):
    """A greedy cover of one group; with a bound (count, name), only as long as the best of the group comes before it."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = int(pdf["n_query"].iloc[0])
        held = {name: set(part) for name, part in pdf.groupby("name")["h"]}
        size = dict(zip(pdf["name"], pdf["n_match"], strict=True))
        sample, out = pdf["query"].iloc[0], []
        left = set(pdf["h"])
        remaining = whole if uncovered is None else uncovered
        while held and remaining:
            scores = {}
            for name, hs in held.items():
                hs &= left
                scores[name] = len(hs)
            best = min(scores, key=lambda n: (-scores[n], n))
            if not scores[best] or scores[best] / remaining < threshold or bound and (-scores[best], best) > (-bound[0], bound[1]):
                break
            out.append((sample, done + len(out) + 1, best, round(scores[best] / whole, 4), round(scores[best] / size[best], 4), scores[best]))
            remaining -= scores[best]
            left -= held.pop(best)
        return pd.DataFrame(out, columns=["query", "round", "name", "f_query", "f_match", "shared"])

    return gather


def gather(queries: DataFrame, index: DataFrame, threshold: float = 0.05, exclude: DataFrame | None = None, sizes: Sizes | None = None) -> DataFrame:
    """Greedy cover of each query: in every round the match that holds most of what is left.

    The share that the threshold bounds has what is left as its denominator.  Matches in
    `exclude` (name) never take part.  Equal overlaps go to the smaller name.  Each
    query is covered in one group of its own, which holds the hashes of the query
    that some match has, never the index: for many queries of a bounded size, such as
    reads.  A whole sample is one for gather_sample().  With sizes, the index may be restricted to hashes of queries.
    """
    nq = queries.groupBy("query").agg(F.count("*").alias("n_query"))
    pairs = queries.join(index.select("name", "h"), "h")
    if exclude is not None:
        pairs = pairs.join(exclude.select("name").distinct(), "name", "left_anti")
    if callable(sizes):
        pairs = kept(pairs)
        sizes = sizes(pairs.select("name").distinct())
    nm = index.groupBy("name").agg(F.count("*").alias("n_match")) if sizes is None else sizes
    rows = pairs.join(nq, "query").join(nm, "name")
    return rows.groupBy("query").applyInPandas(_cover(threshold), _GATHERED)


def without(pairs: DataFrame, counts: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """pairs (name, h) without the hashes that the named matches hold, and counts (name, shared) lowered by the pairs that went."""
    covered = pairs.where(F.col("name").isin(names)).select("h").distinct().withColumn("_gone", F.lit(True))
    told = kept(pairs.join(covered, "h", "left"))
    fewer = told.where("_gone").groupBy("name").agg(F.count("*").alias("_n"))
    left = F.col("shared") - F.coalesce("_n", F.lit(0))
    lowered = kept(counts.join(fewer, "name", "left").select("name", left.alias("shared")).where("shared > 0"))
    rest = kept(told.where("_gone is null").select("name", "h"))
    released(told, pairs, counts)
    return rest, lowered


def gather_sample(query: DataFrame, index: DataFrame, threshold: float = 0.05, exclude: DataFrame | None = None, sizes: Sizes | None = None) -> DataFrame:
    """gather() of one query of any size, lazily; with sizes, the index may be restricted to hashes of the query.

    What a match shares with the rest of the query only falls, so its last count is a
    bound.  One task covers the hashes of the best matches by that count, GROUP_PAIRS pairs
    at most, for as many rounds as its best comes before the bound of all others.
    Then the covered hashes leave the pairs and the counts are lowered by what went: a
    join for many rounds.  A match with more pairs than that is taken by its count alone.
    """
    spark = query.sparkSession
    query, index = once(query.select("query", "h")), once(index.select("name", "h").distinct())
    first = query.select("query").first()
    label, whole = first["query"] if first else None, query.count()
    pairs = query.select("h").distinct().join(index, "h")
    if exclude is not None:
        pairs = pairs.join(exclude.select("name").distinct(), "name", "left_anti")
    pairs = kept(pairs.select("name", "h"))
    counts = kept(pairs.groupBy("name").agg(F.count("*").alias("shared")))
    rounds, remaining = [], whole
    while remaining:
        best = counts.orderBy(F.desc("shared"), "name").limit(MOST_MATCHES + 1).collect()
        if not best or best[0]["shared"] / remaining < threshold:
            break
        taken, size = 1, best[0]["shared"]
        while taken < min(len(best), MOST_MATCHES) and size + best[taken]["shared"] <= GROUP_PAIRS:
            size, taken = size + best[taken]["shared"], taken + 1
        bound = (best[taken]["shared"], best[taken]["name"]) if taken < len(best) else None
        own = pairs.where(F.col("name").isin([r["name"] for r in best[:taken]])) if size <= GROUP_PAIRS else None
        if own is None:
            name, shared = best[0]["name"], best[0]["shared"]
            new = [(label, len(rounds) + 1, name, round(shared / whole, 4), 0.0, shared)]
        else:
            rows = own.select(F.lit(label).alias("query"), "h", "name", F.lit(whole).alias("n_query"), F.lit(1).alias("n_match"))
            new = [tuple(r) for r in rows.groupBy("query").applyInPandas(_cover(threshold, len(rounds), remaining, bound), _GATHERED).orderBy("round").collect()]
        rounds += new
        remaining -= sum(r[-1] for r in new)
        if bound is None and own is not None:
            break
        pairs, counts = without(pairs, counts, [r[2] for r in new])
    if rounds:  # f_match: sizes are told for the chosen alone
        names = kept(spark.createDataFrame([(r[2],) for r in rounds], "name string"))  # as a file its size is known, and it is broadcast to the sequences
        nm = sizes(names) if callable(sizes) else index.groupBy("name").agg(F.count("*").alias("n_match")) if sizes is None else sizes
        held = {r["name"]: r["n_match"] for r in nm.join(F.broadcast(names), "name", "left_semi").collect()}
        rounds = [(*r[:4], round(r[5] / held[r[2]], 4), r[5]) for r in rounds]
        released(names)
    released(query, index, pairs, counts)
    return spark.createDataFrame(rounds, _GATHERED)


def gather_rounds(query: DataFrame, index: DataFrame, rounds: int, sizes: Sizes | None = None) -> DataFrame:
    """round, name, f_query, f_match of the first rounds of gather() for one query of any size."""
    found = gather_sample(query, index, 0.0, sizes=sizes)
    return found.where(F.col("round") <= rounds).select("round", "name", "f_query", "f_match")
