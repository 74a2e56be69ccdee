"""Session helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbatch import slices


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of our own only in local mode, where none is set."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            have = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            have = tempfile.mkdtemp(prefix="spark-checkpoint-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(have)
    return have


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder, and read again.

    Cuts the lineage: what follows does not recompute df, and a lost executor
    costs only its unfinished tasks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return on_disk(out, path)


_LEFT: dict[str, SparkSession] = {}


def on_disk(df: DataFrame, *paths: str) -> DataFrame:
    """df, which reads files of these paths: discard(df) deletes them, and the end of the driver's Python does."""
    if not _LEFT:
        atexit.register(_delete_left)
    _LEFT.update(dict.fromkeys(paths, df.sparkSession))
    df._written_to = paths
    return df


def resting_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads tables of written(): discard(df) deletes them."""
    df._written_to = tuple(p for t in tables for p in vars(t).get("_written_to", ()))
    return df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _LEFT.pop(path, None)


def _delete_left() -> None:
    for path, spark in list(_LEFT.items()):
        if spark.sparkContext._jsc is not None:  # a stopped session can't reach the folder
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, or that a result rests on, and that nothing will read again."""
    for df in tables:
        for path in vars(df).get("_written_to", ()):
            _delete(df.sparkSession, path)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(docs: DataFrame) -> list[Column]:
    return [quoted(c) for c in docs.columns]


def unused(docs: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that docs, in any case of letters, does not have."""
    have = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name.lower() in have:
            name += "_"
        return name

    return [free(s) for s in stems]


def single_threaded(spark: SparkSession) -> None:
    """Python workers from now on leave matrix products to one thread each; the tasks are the parallel part."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(name, "1")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def body(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def answers(docs: DataFrame, id_col: str, text_col: str, columns: dict[str, str], make: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """The id of each row and what make()(texts) returns for its text, a list or array for each column.

    The ids pass through as Arrow arrays, whatever their type, nulls included.  Null
    texts count as empty.  Texts are handed over in slices of bounded size.
    """
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                got = [pa.array(x, kinds[k]) for x, k in zip(answer(texts[a:b]), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *got], names=[id_col, *columns])

    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} {k}" for c, k in columns.items())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(mapped, schema)
