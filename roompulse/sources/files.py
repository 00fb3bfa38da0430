"""Text lines, staged Kafka records and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roompulse import schemas as S


def read_lines(spark: SparkSession, folder: str, streaming: bool = True,
               files_per_trigger: int | None = None, with_time: bool = False) -> DataFrame:
    """Lines of the text files of a folder, in column ``value``; ``with_time`` adds when their file was ``written`` (epoch ms)."""
    reader = (spark.readStream if streaming else spark.read).format("text")
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(folder)
    if not with_time:
        return lines
    return lines.select("value", F.unix_millis("_metadata.file_modification_time").alias("written"))


def read_staged(spark: SparkSession, folder: str, layout: dict[str, str] | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; by default they have the columns of Kafka records."""
    reader = spark.readStream.schema(S.ddl(layout or S.KAFKA_RECORD))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational database, read anew by every action on it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
