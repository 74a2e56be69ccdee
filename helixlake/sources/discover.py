"""Finding sequence files: folders, lists of files, and lists of pangenomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names of genomes.
GENOMES = "{*.fna*,*.fa*,*.fasta*,*.gb*,*.gbff*}"


def listed(spark: SparkSession, folder: str, pattern: str = GENOMES, recursive: bool = True) -> DataFrame:
    """path and length of a folder's files, once each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", "length").distinct()


def file_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The paths that a text file names, one a line; blank lines do not count, and a path that does not exist is an error.

    Each folder that is named is listed once; names go through the driver a folder at a time, and it keeps none of them.
    """
    named = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    folder = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for r in named.groupBy(folder.alias("folder")).agg(F.collect_set("path").alias("paths")).toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(r["folder"] or ("/" if r["paths"][0].startswith("/") else "."))
        fs = at.getFileSystem(conf)
        have = {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()
        if missing := sorted(p for p in r["paths"] if p.rpartition("/")[2] not in have):
            raise FileNotFoundError(f"a listed file does not exist: {missing[0]}")
    return named


def bank_lines(lines: DataFrame) -> DataFrame:
    """(pangenome, path) of lines `id path...`; a line without a path or an id given twice is an error."""
    parts = lines.select(F.split(F.trim(F.col(lines.columns[0])), r"\s+").alias("p")).where("p[0] <> ''")
    short = F.raise_error(F.concat(F.lit("a line has no path: "), F.col("p")[0]))
    twice = F.raise_error(F.concat(F.lit("an id is given twice: "), F.col("pangenome")))
    rows = parts.select(F.when(F.size("p") >= 2, F.col("p")[0]).otherwise(short).alias("pangenome"), F.col("p").alias("p"))
    counted = rows.groupBy("pangenome").agg(F.count("*").alias("n"), F.first("p").alias("p"))
    checked = counted.select(F.when(F.col("n") == 1, F.col("pangenome")).otherwise(twice).alias("pangenome"), "p")
    return checked.select("pangenome", F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("path"))


def bank_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(pangenome, path) of a folder whose sub-folders are pangenomes."""
    files = listed(spark, folder)
    base = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return files.select(base.alias("pangenome"), "path")
