"""A corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents: every column passes through as it is, whatever its name and type (the
secret scan alone changes text and n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.exact_dedup import keep_one_copy
from helixlake.llm.language_id import UNDETERMINED, identify_rows, trained
from helixlake.llm.near_dedup import keep_representatives
from helixlake.llm.packing import pack_documents
from helixlake.llm.secrets import masked
from helixlake.llm.shared import discard, documents, every, quoted, unused, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not undetermined; the model is learned from all rows of `documents`.

    A low score is no evidence against a text: short texts, texts of rare words and texts
    that many related languages share all have one.  So only texts without a letter go,
    null and empty ones included.  Each row is judged by its own text, ids play no part.
    """
    model = trained(documents(spark, sf_dir))
    (out,) = unused(docs, "told")
    told = identify_rows(docs, model, out=out)
    return told.where(quoted(out)["lang_pred"] != UNDETERMINED).select(*every(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the largest id.

    Null is the empty text.  A row goes only if an equal text stays, also where ids are
    repeated or missing.
    """
    return keep_one_copy(docs, repeats=False)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by the operator's own sets: the one with the smallest id.

    Null texts, empty ones and those without words stay; rows that share an id, or have
    none, are decided one by one.
    """
    return keep_representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret found is replaced by the name of its kind, and n_chars follows.

    Nulls and texts without a secret stay as they are; each row is masked by its own text.
    """
    clean = masked(docs)
    if "n_chars" not in docs.columns:
        return clean
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed).otherwise(F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a null or empty text is one end mark, each row is packed."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Trained models, similarity joins and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next reads it.

    An empty table passes through all stages; a stage's input is deleted once its result is written.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        last, out = docs, stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = written(out)
        discard(last, out)
