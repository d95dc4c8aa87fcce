"""Shared plumbing: column mapping over Arrow batches, staged tables, table reading."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of an Arrow batch at most; texts are long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir; on a single machine, else, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/tiergraph-shared"
    return where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tiergraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # a C library without it


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its worker's freed memory back when it ends, as workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def others(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of a frame that an operator's own columns do not replace (names compare without case)."""
    taken = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in taken]


def named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_batches(spark: SparkSession) -> None:
    for key, default, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1), BATCH_BYTES)):
        if int(spark.conf.get(key, default).rstrip("bB")) > most:
            spark.conf.set(key, str(most))


def map_text(
    df: DataFrame,
    text: str,
    fn: Callable[[pa.Array], list],
    made: list[tuple[str, T.DataType]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from the text column, batch by batch, one output row per input row.

    fn gets the text array of a batch and returns one array or list per made column.  Columns in `keep`
    (default: all) go through unchanged; a made column replaces an input column of the same name.
    """
    spark = df.sparkSession
    small_batches(spark)
    names = [n for n, _ in made]
    keep = [c for c in others(df, names) if keep is None or c in keep]
    at = keep.index(text) if text in keep else -1
    chosen = [F.col(named(c)) for c in keep]
    if at < 0:
        chosen.append(F.col(named(text)).cast("string").alias("__text__"))
    source = df.select(*chosen)
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, t) for n, t in made])
    arrow = [to_arrow_type(t) for _, t in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(len(keep))]
            out = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(fn(batch.column(at if at >= 0 else len(keep))), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + [x.cast(t) for x, t in zip(out, arrow, strict=True)], names=[*keep, *names])

    return source.mapInArrow(released(run), schema)
