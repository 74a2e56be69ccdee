"""Profiles of many species at once, in a number of jobs that does not depend on how many there are.

Ids of families and strains are structs (g, id), g the species, so one join or
aggregation serves all species.  Forward selection goes in lock step: a round asks
each species for its next strain, by one group of its strains, and counts the Gram
columns of all chosen strains in one pass over presence.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import mixture as M
from ..operators import solve as S
from ..operators.tables import grouped_quantiles, kept, ranked, released, shuffled
from .profile import Options, Profile, strain_rows


def pair(value: str) -> Column:
    return F.struct(F.col("species").alias("g"), F.col(value).alias("id"))


def _id(column: str) -> Column:
    return F.col(f"{column}.id")


@dataclass
class Profiles(Mapping):
    """Profiles by species, as tables: profiles[species] fetches one."""

    species: list[str]
    #: species, step, candidate, residual, error, accepted, reason, x, left, r2: the candidates in order.
    trace: DataFrame
    #: species, place, strain, x, ra: the strains of each profile.
    strains: DataFrame
    #: species, strain, component.
    members: DataFrame
    #: species, component, family, abundance, status.
    genes: DataFrame

    def __iter__(self) -> Iterator[str]:
        return iter(self.species)

    def __len__(self) -> int:
        return len(self.species)

    def __getitem__(self, species: str) -> Profile:
        if species not in self.species:
            raise KeyError(species)
        own = lambda df: df.where(F.col("species") == species).drop("species")
        trace, rows = own(self.trace).orderBy("step").collect(), own(self.strains).orderBy("place").collect()
        found = S.Selection([r["strain"] for r in rows], np.array([r["x"] for r in rows]))
        if trace:
            found.residual, found.r2 = trace[0]["left"], trace[0]["r2"]
            found.steps = [S.Step(r["candidate"], r["residual"], r["error"], r["accepted"], r["reason"]) for r in trace]
        return Profile(found, own(self.members), own(self.genes)) if rows else Profile(found, None, None)

    def table(self) -> DataFrame:
        """The strains of all species: species, anchor, members, abundance, ra and counts of genes."""
        return strain_rows(self.strains.select("species", F.col("strain").alias("component"), F.col("x").alias("abundance"), "ra"), self.members, self.genes, ["species"])

    def write(self, folder: str) -> None:
        """strains.tsv, genes.tsv and selection.tsv, with a folder for each species."""

        def tsv(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").partitionBy("species").option("sep", "\t").option("header", True).csv(f"{folder}/{name}")

        tsv(self.table().repartition("species").sortWithinPartitions("species", F.desc("ra"), "anchor"), "strains.tsv")
        tsv(self.genes.select("species", F.col("component").alias("strain"), F.col("family").alias("family_id"), F.format_string("%.6f", "abundance").alias("abundance"), "status"), "genes.tsv")
        steps = self.trace.select("species", "step", "candidate", F.format_string("%.6f", "residual").alias("residual"), F.format_string("%.6f", "error").alias("cv_error"), "accepted", F.col("reason").alias("stop_reason"))
        tsv(steps.repartition("species").sortWithinPartitions("species", "step"), "selection.tsv")


def _state(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[int], np.ndarray]:
    """The strains of a species in order, the places of those chosen, and their Gram columns."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    order = pdf.index[pdf["place"].notna()]
    order = [int(i) for i in sorted(order, key=lambda i: pdf["place"][i])]
    held = np.array(pdf["columns"].tolist(), float).reshape(len(pdf), -1)[:, : len(order)].T
    return pdf, order, held


def _chooser(most: int):
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, order, held = _state(pdf)
        if len(order) >= min(most, len(pdf)):
            return pdf.head(0)[["g", "id"]].assign(number=0)
        j = S.next_column(pdf["d"].to_numpy(float), pdf["b"].to_numpy(float), float(pdf["yty"][0]), held, order, pdf["priority"].to_numpy())
        return pdf.loc[[j], ["g", "id"]].assign(number=len(order))

    return choose


def _chosen(pdf: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, pd.DataFrame]:
    """Names, Gram matrix and right side of the chosen strains of a species, in order, and its rows."""
    pdf = pdf.sort_values("place").reset_index(drop=True)
    n = len(pdf)
    g = np.array(pdf["columns"].tolist(), float).reshape(n, -1)[:, :n]
    return pdf["id"].tolist(), g, pdf["b"].to_numpy(float), pdf


def _fold_models(strains: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """fold, k, id, x of the models without each fold; pieces (f, rows, s, t, n, b) by fold."""
    if strains.empty:
        return pd.DataFrame({"g": [], "f": [], "k": [], "id": [], "x": []})
    names, g, b, _ = _chosen(strains)
    at, parts = {s: i for i, s in enumerate(names)}, {}
    sizes = dict(zip(pieces["f"], pieces["rows"], strict=True))
    for f, s, t, n, y in pieces[["f", "s", "t", "n", "b"]].itertuples(index=False):
        if pd.isna(n):
            continue
        gf, bf = parts.setdefault(f, (np.zeros_like(g), np.zeros_like(b)))
        i, j = at[s], at[t]
        gf[i, j] = gf[j, i] = n
        if i == j:
            bf[i] = 0.0 if pd.isna(y) else y
    total = sum(sizes.values())
    used = sorted(f for f, n in sizes.items() if 0 < n < total)
    rows = [(strains["g"].iloc[0], f, k, None if i is None else names[i], x) for f, k, i, x in S.fold_models(g, b, parts, used)]
    return pd.DataFrame(rows, columns=["g", "f", "k", "id", "x"])


def _stepwise(paired: bool, least_gain: float):
    def solve(strains: pd.DataFrame, errors: pd.DataFrame) -> pd.DataFrame:
        names = ["species", "step", "candidate", "residual", "error", "accepted", "reason", "x", "left", "r2"]
        if strains.empty:
            return pd.DataFrame([], columns=names)
        labels, g, b, pdf = _chosen(strains)
        found = {(k, f): e for k, f, e in errors[["k", "f", "error"]].itertuples(index=False)}
        used = sorted(set(errors["f"]))
        listed = [[found[k, f] for f in used if (k, f) in found] for k in range(len(labels) + 1)]
        unmoved = errors.drop_duplicates("f")["unmoved"].mean() if len(errors) else 0.0
        result = S.stepwise(g, b, float(pdf["yty"][0]), float(pdf["tss"][0]), labels, listed, paired, least_gain, float(unmoved))
        x = dict(zip(result.labels, result.x, strict=True))
        rows = [(pdf["g"][0], i, s.candidate, s.residual, s.error, s.accepted, s.reason, x.get(s.candidate), result.residual, result.r2) for i, s in enumerate(result.steps, 1)]
        return pd.DataFrame(rows, columns=names).astype({"error": float, "x": float})

    return solve


def _refit(pdf: pd.DataFrame) -> pd.DataFrame:
    """g, place, id and x of the strains of a species, solved once more; pieces (s, t, n, b, yty, tss)."""
    names = sorted(pdf["s"][pdf["s"] == pdf["t"]])
    at, g, b = {s: i for i, s in enumerate(names)}, np.zeros((len(names),) * 2), np.zeros(len(names))
    for s, t, n, y in pdf[["s", "t", "n", "b"]].itertuples(index=False):
        g[at[s], at[t]] = g[at[t], at[s]] = n
        if s == t:
            b[at[s]] = y
    found = S.finish(g, b, float(pdf["yty"].iloc[0]), float(pdf["tss"].iloc[0]), names, list(range(len(names))))
    return pd.DataFrame({"g": pdf["g"].iloc[0], "place": range(len(found.labels)), "id": found.labels, "x": found.x})


def _squares(depth: DataFrame) -> DataFrame:
    """g, yty and tss of the families of each species."""
    total = depth.groupBy(F.col("fam.g").alias("g")).agg(F.count("*").alias("n"), F.sum("y").alias("t"), F.sum(F.col("y") * F.col("y")).alias("yty"))
    return total.select("g", "yty", (F.col("yty") - F.col("t") * F.col("t") / F.col("n")).alias("tss"))


def forward_all(inside: DataFrame, depth: DataFrame, priority: DataFrame, k_max: int) -> DataFrame:
    """The chosen strains of all species: g, id, place, d, b, yty, tss, priority, columns (of the Gram matrix, in order).

    presence inside the fence (fam, strain), depth (fam, y), priority (strain, priority).
    """
    sums = inside.join(shuffled(depth), "fam").groupBy("strain").agg(F.count("*").cast("double").alias("d"), F.sum("y").alias("b"))
    kind = dict(sums.select(_id("strain").alias("id")).dtypes)["id"]
    state = sums.join(priority, "strain", "left").join(_squares(depth), F.col("strain.g") == F.col("g"))
    state = kept(state.select("g", _id("strain").alias("id"), "d", "b", F.coalesce("priority", F.lit(0)).alias("priority"), "yty", "tss", F.lit(None).cast("int").alias("place"), F.array().cast("array<double>").alias("columns")))
    most = state.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    for _ in range(min(k_max, most)):
        now = kept(state.groupBy("g").applyInPandas(_chooser(k_max), f"g string, id {kind}, number int"))
        own = inside.join(now.select(F.struct("g", "id").alias("strain")), "strain", "left_semi").select("fam")
        counts = inside.join(own, "fam", "left_semi").groupBy("strain").agg(F.count("*").cast("double").alias("n"))
        counts = counts.select(F.col("strain.g").alias("g"), _id("strain").alias("id"), "n")
        grown = state.join(counts, ["g", "id"], "left").join(now, ["g", "id"], "left")
        grown = kept(grown.select(*[c for c in state.columns if c not in ("place", "columns")], F.coalesce("place", "number").alias("place"), F.array_append("columns", F.coalesce("n", F.lit(0.0))).alias("columns")))
        released(state, now)
        state = grown
    out = kept(state.where("place is not null"))
    released(state)
    return out


def select_all(presence: DataFrame, depth: DataFrame, priority: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """The trace of Profiles and (strain, component), of all species at once; see profile.select() for one."""
    live = depth.where("y > 0").select(F.col("fam.g").alias("g")).distinct()
    live = kept(live.join(presence.select(F.col("fam.g").alias("g")).distinct(), "g", "left_semi"))
    within = lambda df: df.join(live, F.col("fam.g") == F.col("g"), "left_semi")
    grouped, members = M.collapse(shuffled(kept(within(presence))), options.merge_jaccard)
    depth = kept(M.grouped_fence(within(depth).withColumn("g", F.col("fam.g")), "g"))
    inside = kept(grouped.join(shuffled(depth.select("fam")), "fam", "left_semi"))
    strains = forward_all(inside, depth, priority, options.k_max)
    kind = dict(strains.dtypes)["id"]
    chosen = kept(inside.join(strains.select(F.struct("g", "id").alias("strain")), "strain", "left_semi"))
    placed = ranked(depth, "g", "fam")
    draws = placed.agg(F.max("n")).first()[0] or 0
    middle = grouped_quantiles(depth.where("y > 0"), "g", "y", {"q": 0.5})
    floor = F.when(F.col("q") > 0, 0.01 * F.col("q")).otherwise(1e-6)
    folds = placed.withColumn("f", M.fold_of(F.col("place"), draws, options.cv_folds)).join(middle, "g", "left")
    folds = kept(folds.select("fam", F.struct("g", "f").alias("fold"), "y", floor.alias("floor")))
    pieces = M.fold_moments(chosen, folds).select("fold", F.col("s.id").alias("s"), F.col("t.id").alias("t"), F.col("g").alias("n"), "b")
    pieces = folds.groupBy("fold").agg(F.count("*").alias("rows")).join(pieces, "fold", "left").select(F.col("fold.g").alias("g"), F.col("fold.f").alias("f"), "rows", "s", "t", "n", "b")
    models = kept(strains.groupBy("g").cogroup(pieces.groupBy("g")).applyInPandas(_fold_models, f"g string, f long, k int, id {kind}, x double"))
    tried = models.select(F.struct("g", "f").alias("fold"), "k", F.when(F.col("id").isNotNull(), F.struct("g", "id")).alias("strain"), "x")
    errors = M.deviance(chosen, folds, tried, "floor").join(M.unmoved_error(inside, folds, "floor"), "fold").select(F.col("fold.g").alias("g"), F.col("fold.f").alias("f"), "k", "error", "unmoved")
    schema = f"species string, step int, candidate {kind}, residual double, error double, accepted boolean, reason string, x double, left double, r2 double"
    trace = kept(strains.groupBy("g").cogroup(errors.groupBy("g")).applyInPandas(_stepwise(options.stop_rule == "cv_paired", options.cv_min_gain), schema))
    released(live, depth, inside, strains, chosen, placed, folds, models)
    return trace, members


def refitted_all(genes: DataFrame, strains: DataFrame) -> DataFrame:
    """strains (g, place, id, x) solved once more on the observed and reassigned families; a species where nothing is left keeps its own."""
    presence, depth = A.observed_depth(genes)
    presence, depth = kept(presence), kept(depth)
    kind = dict(strains.dtypes)["id"]
    gram = M.gram(presence).join(M.rhs(presence, depth).withColumnRenamed("strain", "s"), "s")
    pieces = gram.select(F.col("s.g").alias("_g"), F.col("s.id").alias("s"), F.col("t.id").alias("t"), F.col("g").alias("n"), "b").withColumnRenamed("_g", "g").join(_squares(depth), "g")
    new = kept(pieces.groupBy("g").applyInPandas(_refit, f"g string, place int, id {kind}, x double"))
    out = kept(new.unionByName(strains.join(new.select("g"), "g", "left_anti").select("g", "place", "id", "x")))
    released(presence, depth, new)
    return out


def profile_all(nodes: DataFrame, edges: DataFrame, presence: DataFrame, options: Options = Options(), species: list[str] | None = None) -> Profiles:
    """Profiles of the species of annotated graphs: nodes, edges and presence, each with a column species.

    Rows without a species are passed over.  A species without a covered family, or
    without presence, has an empty profile.  `species` are the names to answer for; all of
    the nodes where it is not given, whose names alone are fetched.
    """
    if species is None:
        species = sorted(r["species"] for r in nodes.where("species is not null").select("species").distinct().collect())
    graph = kept(nodes.where("species is not null").withColumn("nid", pair("nid")))
    ids = shuffled(graph)
    ends = kept(edges.where("species is not null").select(pair("src").alias("src"), pair("dst").alias("dst")))
    held = kept(presence.where("species is not null").select(pair("nid").alias("nid"), pair("strain").alias("strain")).distinct())
    fam = shuffled(held.select(F.col("nid").alias("fam"), "strain"))
    trace, members = select_all(fam, M.families(ids), M.shell_priority(ids, fam), options)
    strains = kept(trace.where("x is not null").select(F.col("species").alias("g"), F.col("step").alias("place"), F.col("candidate").alias("id"), "x"))

    def given(chosen: DataFrame) -> DataFrame:
        table = chosen.select(F.struct("g", "id").alias("component"), F.col("x").alias("a"))
        own = members.join(table.select("component"), "component", "left_semi")
        return kept(A.assign_by_species(ids, ends, held, own, table, options.impute_min_frac, options.reassign_max_residual))

    genes = given(strains)
    if options.refine:
        strains, first, old = refitted_all(genes, strains), strains, genes
        genes = given(strains)
        released(first, old)
    released(graph, ends, held)
    total = F.sum("x").over(W.partitionBy("g"))  # at most k_max strains of a species
    shares = strains.select(F.col("g").alias("species"), "place", F.col("id").alias("strain"), "x", F.when(total > 0, F.col("x") / total).otherwise(F.col("x")).alias("ra"))
    return Profiles(
        list(species), trace, shares, members.select(F.col("strain.g").alias("species"), _id("strain").alias("strain"), _id("component").alias("component")),
        genes.select(F.col("component.g").alias("species"), _id("component").alias("component"), _id("family").alias("family"), "abundance", "status"),
    )
