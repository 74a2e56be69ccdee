"""Stages of a run that are kept on disk, and made again only if what they are made of has changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import VERSION

#: Names of parts of a plan whose text does not tell what they compute.
OPAQUE = ("Python", "ScalaUDF", "ScalaAggregator", "MapIn", "FlatMap", "MapElements", "MapPartitions", "MapGroups", "CoGroup")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def file_states(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    """(path, size, time of the last change) of files, by one listing of each folder."""
    jvm, out, folders = spark._jvm, [], {}
    for f in files:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        folders.setdefault(at.getParent().toString(), set()).add(at.getName())
    for folder, names in folders.items():
        at, fs = _hadoop(spark, folder)
        out += [(f"{folder}/{s.getPath().getName()}", s.getLen(), s.getModificationTime()) for s in fs.listStatus(at) if s.getPath().getName() in names]
    return sorted(out)


def content(df: DataFrame) -> list[str]:
    """The number of rows, and two sums of their hashes, whatever their order."""
    cells = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    h = F.xxhash64(*cells) if cells else F.lit(0)
    row = df.select(h.alias("h"), F.xxhash64(F.lit(1), h, *cells).alias("j")).agg(F.count("*"), *[F.sum(F.col(c).cast("decimal(20,0)")) for c in "hj"]).first()
    return [str(x) for x in row]


def fingerprint(df: DataFrame) -> str:
    """What a DataFrame is made of, equal in any session: its plan over files, with the state of those files, or else its rows.

    A plan that reads files alone, by Spark's own expressions, is known by its text and by
    the names, sizes and times of its files, and nothing is read.  Other plans,
    such as rows of the driver or Python functions, are run once for their content.
    """
    if known := vars(df).get("_stage_key"):
        return known
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    text = plan.canonicalized().toString()
    of_files = all(leaves.apply(i).nodeName() == "LogicalRelation" for i in range(leaves.size()))
    if of_files and (files := df.inputFiles()) and not any(x in plan.toJSON() for x in OPAQUE):
        told = ["files", text, *map(str, file_states(df.sparkSession, files))]
    else:
        told = ["rows", *content(df)]
    return hashlib.sha256("\n".join([df.schema.json(), *told]).encode()).hexdigest()


class Stages:
    """Named tables in a folder, by what each is made of.

    A table is written under a name of its own, with a manifest beside it, and takes its
    final name in one rename, so a stage is there as a whole or not at all (on a file
    system that renames atomically).  Tables of other inputs stay beside it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: list[tuple[DataFrame, str]] = []

    def _told(self, x: object) -> str:
        if not isinstance(x, DataFrame):
            return repr(x)
        for df, key in self._known:
            if df is x:
                return key
        self._known.append((x, fingerprint(x)))
        return self._known[-1][1]

    def __call__(self, name: str, make: Callable[[], DataFrame], made_of: tuple = ()) -> DataFrame:
        """The table of a stage, read if it was made of the same before: DataFrames and settings."""
        told = [self._told(x) for x in made_of]
        key = hashlib.sha256("\n".join([name, VERSION, *told]).encode()).hexdigest()
        path = f"{self.folder}/{name}-{key[:24]}"
        final, fs = _hadoop(self.spark, path)
        if not fs.exists(final):
            making, _ = _hadoop(self.spark, f"{self.folder}/.making-{uuid.uuid4().hex}")
            make().write.parquet(f"{making}/data")
            note = {"stage": name, "key": key, "made_of": told, "version": VERSION, "made": datetime.now(timezone.utc).isoformat(timespec="seconds")}
            out = fs.create(_hadoop(self.spark, f"{making}/manifest.json")[0], True)
            out.write(bytearray(json.dumps(note).encode()))
            out.close()
            if fs.exists(final) or not fs.rename(making, final):  # another run was first
                fs.delete(making, True)
        df = self.spark.read.parquet(f"{path}/data")
        df._stage_key = key
        return df
