"""Helpers shared by the training-data operators: tables, shared scratch space, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session leaves it unset, as in tests, a folder under the warehouse is used; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder once and returns it read from there: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its store, as Spark would read it: one without a scheme lies in the default store, which needn't be a local disk."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


def discard(df: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def private(taken: list[str], name: str) -> str:
    """A column name that begins with ``name`` and that none of ``taken`` is, in any case of letters."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def given_apart(df: DataFrame, made: list[str]) -> DataFrame:
    """``df`` with its columns that clash with names an operator adds kept as ``<name>_given``."""
    taken = [*df.columns, *made]
    for c in df.columns:
        if c.lower() in {m.lower() for m in made}:
            new = private(taken, f"{c}_given")
            taken.append(new)
            df = df.withColumnRenamed(c, new)
    return df


def with_rows(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``docs`` stored with a key of its own for every row, and that column's name: ids may be null or repeated, and no key changes when the table is read again."""
    key = private(docs.columns, "_row")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), tag), key


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into small ones, so that what a worker derives from one stays small; a worker that is done gives unused memory back."""
    for batch in batches:
        width = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, chars // width))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def crc32_mod(doc_id, n: int):
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % F.lit(n)


def held_out(column: str, n: int, remainder: int):
    """Rows that no model may learn from; a null id is held out as well."""
    return F.coalesce(crc32_mod(column, n) == remainder, F.lit(True))
