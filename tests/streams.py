"""Helpers that feed tables to streams, file by file."""

from __future__ import annotations

import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, order: str, files: int) -> tuple[str, str]:
    """Write ``df`` as ``files`` parquet files in ascending ``order``; folder and schema."""
    folder = tempfile.mkdtemp(prefix="staged-")
    bounds = df.approxQuantile(order, [i / files for i in range(1, files)], 0.0) if files > 1 else []
    edges = [float("-inf"), *bounds, float("inf")]
    table = df.toArrow()
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        values = pc.cast(table[order], "float64")
        part = table.filter(pc.and_(pc.greater_equal(values, low), pc.less(values, high)))
        pq.write_table(part, Path(folder) / f"part-{i:03d}.parquet")
        time.sleep(0.01)
    return folder, df.schema


def stream(spark, source, per_trigger: int = 1) -> DataFrame:
    folder, schema = source
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
            .parquet(folder))


def run(df: DataFrame, mode: str = "append", seconds: int = 120):
    """Run to the end of the input; rows of the memory sink (append or last update)."""
    name = f"out_{time.time_ns()}"
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="ckpt-"))
         .trigger(availableNow=True).start())
    try:
        assert q.awaitTermination(seconds), "stream did not end in time"
    finally:
        q.stop()
    return df.sparkSession.table(name)


def run_batches(df: DataFrame, fn, seconds: int = 120, checkpoint: str | None = None) -> None:
    q = (df.writeStream.foreachBatch(fn)
         .option("checkpointLocation", checkpoint or tempfile.mkdtemp(prefix="ckpt-"))
         .trigger(availableNow=True).start())
    try:
        assert q.awaitTermination(seconds), "stream did not end in time"
    finally:
        q.stop()
