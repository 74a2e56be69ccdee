"""Collections, releases and the policy on what is supported, as tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import version_key

COLLECTION = """name string, id bigint, releases array<struct<
  version: string, latest: boolean, ppanggolin_version: string, pangbank_wf_version: string,
  taxonomy_source: struct<name: string, version: string>, pangenome_count: bigint>>"""


def releases(collections: DataFrame, text_col: str) -> DataFrame:
    """name and release columns of collections given as JSON texts, oldest first within a name."""
    parsed = collections.select(F.from_json(text_col, COLLECTION).alias("c")).select("c.name", F.explode("c.releases").alias("r"))
    return parsed.select("name", "r.*").orderBy("name", version_key(F.col("version")))


def latest(rows: DataFrame) -> DataFrame:
    """The release of each name with the greatest version."""
    return rows.groupBy("name").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))


def verdicts(rows: DataFrame, name: str, policy: DataFrame, default: str = "unsupported") -> DataFrame:
    """rows with the verdict that a small policy table (name, verdict) has on a column."""
    table = policy.select(F.col("name").alias(name), "verdict")
    return rows.join(table, name, "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def fetch_plan(wanted: DataFrame, present: DataFrame, force: bool = False) -> DataFrame:
    """label and action (present or fetch) of wanted files; with `force`, all are fetched again."""
    have = present.select("label").distinct().withColumn("_h", F.lit(not force))
    return wanted.join(have, "label", "left").select("label", F.when(F.col("_h"), "present").otherwise("fetch").alias("action"))


def outcomes(plan: DataFrame, tried: DataFrame) -> DataFrame:
    """label and outcome of a plan: present, fetched or failed, as the last of tried (label, attempt, error) says, or pending where none was made."""
    last = tried.groupBy("label").agg(F.max_by(F.struct(F.col("error").isNull().alias("ok"), "error"), "attempt").alias("_t"))
    told = F.when(F.col("action") == "present", "present").when(F.col("_t.ok"), "fetched").when(F.col("_t").isNotNull(), "failed").otherwise("pending")
    return plan.join(last, "label", "left").select("label", told.alias("outcome"), F.when(told == "failed", F.col("_t.error")).alias("error"))


def tally(told: DataFrame) -> DataFrame:
    """One row: how many files were present, fetched, failed or are pending."""
    return told.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("present", "fetched", "failed", "pending")])


class Source(Protocol):
    """What a profile asks of a store of pangenomes: the tables of one species."""

    def tables(self, species: str) -> dict[str, DataFrame]: ...


def requested(tokens: str, names: dict[int, str]) -> list[str]:
    """The pangenomes of a comma-separated request, by name or number, once each in the order asked for."""
    known, out = set(names.values()), []
    for token in filter(None, (t.strip() for t in tokens.split(","))):
        name = names.get(int(token)) if token.isdigit() else token
        if name not in known:
            raise ValueError(f"no such pangenome: {token}")
        if name not in out:
            out.append(name)
    return out
