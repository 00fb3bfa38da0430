"""Idempotent micro-batch sinks.

A micro-batch that is run again after a failure must not count twice. The file sinks write each
batch to its own ``batch_id`` folder and replace that folder when the batch comes back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BatchFn = Callable[[DataFrame, int], None]


def write_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def batch_table(folder: str) -> BatchFn:
    """``foreachBatch`` function: one folder per batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, folder)
    return write


def read_table(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All batches of a table, with ``batch_id``."""
    reader = spark.read.option("basePath", folder)
    return (reader.schema(schema) if schema else reader).parquet(folder)


def routed_tables(folder: str, route: str = "route") -> BatchFn:
    """``foreachBatch`` function: one folder per batch and route."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.write.mode("overwrite").partitionBy(route)
         .parquet(f"{folder}/batch_id={batch_id}"))
    return write


def jdbc_rows(url: str, table: str, batch_size: int = 100, batch_column: str = "batch_id",
              delete_batch: Callable[[int], None] | None = None, **options: str) -> BatchFn:
    """``foreachBatch`` function that appends to a database table.

    Rows carry their ``batch_id``. Spark's writer has no upsert, so a batch that is run again would
    be appended twice: pass ``delete_batch`` to remove what an earlier attempt left behind, or
    deduplicate on ``id`` when reading.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if delete_batch is not None:
            delete_batch(batch_id)
        jdbc_writer(batch.withColumn(batch_column, F.lit(batch_id)), url, table, batch_size,
                    **options).save()
    return write


def jdbc_writer(rows: DataFrame, url: str, table: str, batch_size: int = 100, **options: str):
    return (rows.write.format("jdbc").mode("append")
            .options(url=url, dbtable=table, batchsize=str(batch_size), **options))
