"""The profiling plan: detection, mapping, selection, gene content and its files."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime
from html import escape
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import VERSION
from ..operators import assign as A
from ..operators import mixture as M
from ..operators import solve as S
from ..operators.tables import kept, quantiles, released, shuffled

#: Strains that refitted() solves for at once.
MOST_REFITTED = 64


@dataclass(frozen=True)
class Options:
    stop_rule: str = "cv_paired"
    k_max: int = 12
    merge_jaccard: float = 0.95
    cv_folds: int = 5
    cv_min_gain: float = 0.02
    refine: bool = True
    impute_min_frac: float = 0.5
    reassign_max_residual: float = 0.5


@dataclass
class Profile:
    selection: S.Selection
    members: DataFrame | None
    genes: DataFrame | None


class Selector(Protocol):
    """Chooses strains of a mixture: presence (fam, strain), depth (fam, y), priority by strain."""

    def __call__(self, presence: DataFrame, depth: DataFrame, priority: dict, options: Options) -> tuple[S.Selection, DataFrame | None]: ...


class Assigner(Protocol):
    """Gives families to components: nodes, edges, presence, (strain, component), (component, a)."""

    def __call__(self, nodes: DataFrame, edges: DataFrame, presence: DataFrame, members: DataFrame, abundance: DataFrame, least: float, most: float) -> DataFrame: ...


def moments(presence: DataFrame, depth: DataFrame) -> tuple[list, np.ndarray, np.ndarray, float, float]:
    """Labels, the Gram matrix' diagonal, b, y'y and the squares about the mean: one row for each strain is collected."""
    rows = sorted(presence.join(depth, "fam").groupBy("strain").agg(F.count("*").alias("n"), F.sum("y").alias("b")).collect())
    n, total, squares = depth.agg(F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
    squares = squares or 0.0
    return [r["strain"] for r in rows], np.array([r["n"] for r in rows], float), np.array([r["b"] for r in rows], float), squares, squares - (total or 0.0) ** 2 / max(1, n)


def gram_column(presence: DataFrame, labels: list, j: int) -> np.ndarray:
    """In how many families each strain occurs together with strain j."""
    own = presence.where(F.col("strain") == labels[j]).select("fam")
    counts = {r["strain"]: r["count"] for r in presence.join(own, "fam", "left_semi").groupBy("strain").count().collect()}
    return np.array([counts.get(s, 0) for s in labels], float)


def refitted(presence: DataFrame, depth: DataFrame) -> S.Selection:
    """All strains of a small mixture, such as the chosen ones, solved once more."""
    labels, diagonal, b, yty, tss = moments(presence, depth)
    if len(labels) > MOST_REFITTED:
        raise ValueError(f"more than {MOST_REFITTED} strains to solve for at once")
    g = np.array([gram_column(presence, labels, j) for j in range(len(labels))]).reshape(len(labels), len(labels))
    return S.finish(g, b, yty, tss, labels, list(range(len(labels))))


def select(presence: DataFrame, depth: DataFrame, priority: dict, options: Options = Options()) -> tuple[S.Selection, DataFrame | None]:
    """Collapse, fence, order, cross-validate and solve.  Returns the selection and (strain, component).

    Of the Gram matrix only the diagonal and the columns of the chosen strains are
    collected, and of the folds only the pieces among those: k_max strains at most.
    """
    if depth.where("y > 0").isEmpty() or presence.isEmpty():
        return S.Selection(), None
    grouped, members = M.collapse(presence, options.merge_jaccard)
    depth = M.fence(depth).persist()
    inside = grouped.join(depth.select("fam"), "fam", "left_semi").persist()
    labels, diagonal, b, yty, tss = moments(inside, depth)
    columns: dict[int, np.ndarray] = {}

    def column(j: int) -> np.ndarray:
        columns[j] = gram_column(inside, labels, j)
        return columns[j]

    order = S.forward(diagonal, b, yty, column, np.array([priority.get(s, 0) for s in labels]), options.k_max)
    g, b = np.array([columns[j][order] for j in order]).reshape(len(order), len(order)), b[order]
    names = [labels[j] for j in order]
    at = {s: i for i, s in enumerate(names)}
    kind = dict(inside.dtypes)["strain"]
    chosen = inside.where(F.col("strain").isin(names)).persist()
    folds = M.seeded_folds(M.ordered(depth), options.cv_folds).persist()
    pieces = {}
    for r in M.fold_moments(chosen, folds).collect():  # at most folds * k_max * (k_max + 1) / 2 rows
        gf, bf = pieces.setdefault(r["fold"], (np.zeros_like(g), np.zeros_like(b)))
        i, j = at[r["s"]], at[r["t"]]
        gf[i, j] = gf[j, i] = r["g"]
        if i == j:
            bf[i] = r["b"] or 0.0
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    used = sorted(f for f, n in sizes.items() if 0 < n < total)
    models = [(f, k, None if i is None else names[i], x) for f, k, i, x in S.fold_models(g, b, pieces, used)]
    (middle,) = quantiles(depth.where("y > 0"), "y", [0.5])
    floor = 0.01 * middle if middle else 1e-6
    table = depth.sparkSession.createDataFrame(models, f"fold long, k int, strain {kind}, x double")  # at most folds * k_max**2 rows
    found = {(r["k"], r["fold"]): r["error"] for r in M.deviance(chosen, folds, table, floor).collect()}
    errors = [[found[k, f] for f in used if (k, f) in found] for k in range(len(order) + 1)]
    unmoved = [r["unmoved"] for r in M.unmoved_error(inside, folds, floor).where(F.col("fold").isin(used)).collect()]
    result = S.stepwise(g, b, yty, tss, names, errors, options.stop_rule == "cv_paired", options.cv_min_gain, float(np.mean(unmoved)) if unmoved else 0.0)
    for df in (depth, inside, chosen, folds):
        df.unpersist()
    return result, members


def profile(
    nodes: DataFrame, edges: DataFrame, presence: DataFrame, options: Options = Options(),
    exclude: Iterable = (), selector: Selector | None = None, assigner: Assigner | None = None,
) -> Profile:
    """Strains of one annotated graph and their genes; presence has (nid, strain).

    Strains in `exclude` are held out of the candidates only (leave-one-out): nodes and
    weights stay, so families that they alone carry become orphans of the others.
    The graph is made once and kept, and so are the genes, since each is read many times.
    """
    graph, presence = kept(nodes), kept(presence)
    nodes = shuffled(graph)
    fam = presence.select(F.col("nid").alias("fam"), "strain").distinct()
    if out := list(exclude):
        fam = fam.where(~F.col("strain").isin(out))
    depth = M.families(nodes)
    priority = {r["strain"]: r["priority"] for r in M.shell_priority(nodes, fam).collect()}
    selection, members = (selector or select)(fam, depth, priority, options)
    if members is None or not selection.labels:
        released(graph, presence)
        return Profile(selection, None, None)
    edges = kept(edges)
    spark = nodes.sparkSession
    kind = dict(presence.dtypes)["strain"]

    def given() -> DataFrame:
        table = spark.createDataFrame([(s, float(x)) for s, x in zip(selection.labels, selection.x, strict=True)], f"component {kind}, a double")
        own = members.join(table.select("component"), "component", "left_semi")
        return kept((assigner or A.assign)(nodes, edges, presence, own, table, options.impute_min_frac, options.reassign_max_residual))

    genes = given()
    if options.refine:
        new = refitted(*A.observed_depth(genes))
        if new.labels:
            selection.labels, selection.x = new.labels, new.x
            first, genes = genes, given()
            released(first)
    released(graph, edges, presence)
    return Profile(selection, members, genes)


def strain_rows(table: DataFrame, members: DataFrame, genes: DataFrame, by: list[str]) -> DataFrame:
    """table (by, component, abundance, ra) with the members of each component and the numbers of its genes."""
    keys = [*by, "component"]
    names = members.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.col("strain").cast("string"))), ";").alias("members"))
    out = table.join(names, keys).join(A.status_counts(genes, by), keys, "left").na.fill(0)
    return out.select(*by, F.col("component").alias("anchor"), "members", "abundance", "ra", "n_genes", "n_observed", "n_reassigned", "n_imputed")


def strains_table(p: Profile) -> DataFrame:
    """anchor, members, abundance, ra and counts of genes, by ra."""
    spark = p.genes.sparkSession
    kind = dict(p.genes.dtypes)["component"]
    rows = [(s, float(x), float(r)) for s, x, r in zip(p.selection.labels, p.selection.x, p.selection.ra, strict=True)]
    table = spark.createDataFrame(rows, f"component {kind}, abundance double, ra double")
    return strain_rows(table, p.members, p.genes, []).orderBy(F.desc("ra"), "anchor")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, by the file system that Spark knows the path by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _table(head: list[str], rows: Iterable[Iterable]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(f'<th>{escape(c)}</th>' for c in head)}</tr>{cells}</table>"


def report(sample: str, collection: str, panels: list[tuple[str, Profile, list[dict], int, int]]) -> str:
    """One HTML page: for each (species, profile, rows of its strains, reads mapped, reads in all) its figures, strains and selection."""
    body = []
    for species, p, strains, mapped, total in panels:
        share = f"{mapped:,} / {total:,} ({100 * mapped / total:.1f}%)" if total else "-"
        steps = [(i, s.candidate, f"{s.residual:.3f}", None if s.error is None else f"{s.error:.4f}", "kept" if s.accepted else "stopped", s.reason) for i, s in enumerate(p.selection.steps, 1)]
        body += [
            f"<section><h2>{escape(species)}</h2><p>{len(p.selection.labels)} strains, reads mapped: {share}</p><h3>Strains</h3>",
            _table(list(strains[0]) if strains else [], [r.values() for r in strains]), "<h3>Selection</h3>",
            _table(["step", "candidate", "residual", "cv error", "decision", "stop reason"], steps) if steps else "<p>No step was tried.</p>", "</section>",
        ]
    head = f"<!doctype html><meta charset=utf-8><title>{escape(sample)}</title><h1>{escape(sample)}</h1><p>{escape(collection)}, {len(panels)} species</p>"
    return head + ("".join(body) or "<p>No species was profiled.</p>")


def manifest(options: Options, **info) -> str:
    """A run's settings as TOML: when, with which version, on what and how; values of None are left out."""
    quoted = lambda v: json.dumps(v) if isinstance(v, (str, bool, list)) else repr(v)
    lines = [f'date = "{datetime.now():%Y-%m-%d %H:%M:%S}"', f'version = "{VERSION}"']
    lines += [f"{k} = {quoted(v)}" for k, v in info.items() if v is not None]
    return "\n".join([*lines, "", "[profile]", *(f"{k} = {quoted(v)}" for k, v in asdict(options).items()), ""])


def write_profile(p: Profile, folder: str, species: str, reads: tuple[int, int] = (0, 0), options: Options = Options(), **info) -> None:
    """strains.tsv and genes.tsv by Spark; selection.tsv, profile.json, report.html and run.toml for the small rest.

    reads are those mapped and those in all; info goes to run.toml.
    """
    spark = p.genes.sparkSession
    tsv = lambda df, name: df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{name}")
    strains = strains_table(p)
    tsv(strains.coalesce(1), "strains.tsv")
    tsv(p.genes.select(F.col("component").alias("strain"), F.col("family").alias("family_id"), F.format_string("%.6f", "abundance").alias("abundance"), "status"), "genes.tsv")
    steps = [asdict(s) for s in p.selection.steps]
    lines = ["step\tcandidate\tresidual\tcv_error\taccepted\tstop_reason"]
    lines += [f"{i}\t{s['candidate']}\t{s['residual']:.6f}\t{'' if s['error'] is None else format(s['error'], '.6f')}\t{s['accepted']}\t{s['reason'] or ''}" for i, s in enumerate(steps, 1)]
    rows = [r.asDict() for r in strains.collect()]  # one for each strain
    put_text(spark, f"{folder}/selection.tsv", "\n".join(lines) + "\n")
    put_text(spark, f"{folder}/profile.json", json.dumps({"species": species, "k": len(rows), "residual": p.selection.residual, "r2": p.selection.r2, "components": rows, "trace": steps}, default=str))
    put_text(spark, f"{folder}/report.html", report(species, info.get("collection", ""), [(species, p, rows, *reads)]))
    put_text(spark, f"{folder}/run.toml", manifest(options, species=species, **info))


def write_gather(gathered: DataFrame, path: str) -> None:
    """name, f_query, f_match and the running share of the query as tab-separated text, in the order of the rounds."""
    run = F.round(F.sum("f_query").over(W.partitionBy("query").orderBy("round").rowsBetween(W.unboundedPreceding, 0)), 4)
    rows = gathered.withColumn("cum_f_query", run).orderBy("query", "round").select("name", "f_query", "f_match", "cum_f_query")
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def detection(gathered: DataFrame) -> DataFrame:
    """genome, species, f_query, f_match and the running share of the query, in the order of the rounds."""
    run = F.sum("f_query").over(W.partitionBy("query").orderBy("round").rowsBetween(W.unboundedPreceding, 0))
    text = lambda c: F.format_string("%.6f", c)
    return gathered.select("query", "round", F.col("name").alias("genome"), F.substring_index("name", "@", 1).alias("species"), text(F.col("f_query")).alias("f_query"), text(F.col("f_match")).alias("f_match"), text(run).alias("cum_f_query"))


def candidates(gathered: DataFrame) -> DataFrame:
    """Species in the order in which rounds first name them."""
    return gathered.groupBy("query", F.substring_index("name", "@", 1).alias("species")).agg(F.min("round").alias("first_round"))
