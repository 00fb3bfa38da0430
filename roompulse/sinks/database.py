"""Rows to a database table, each micro-batch once.

Tasks stage their rows under a token of their own; the driver then moves all of a micro-batch's rows and records the
micro-batch in one transaction. What is run again finds the record and moves nothing, and rows of lost tasks have a
token that no commit names. It needs three tables: ``<table>``, ``<table>_staged`` (its columns and ``token``) and
``<table>_epochs`` (``job``, ``epoch``).
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from roompulse.sinks.tables import BatchFn

FORMAT = "roompulse_database"
FLUSH_MS = 2_000        # how often a job with this sink runs a micro-batch
BATCH_ROWS = 100        # rows of one statement


@dataclass
class Staged(WriterCommitMessage):
    token: str
    rows: int


class DatabaseTable(DataSource):
    """Write-only source; options ``connect`` (``module:function`` or ``module:function:argument``, makes a DB-API connection),
    ``table``, ``job``, ``epoch``, and if need be ``mark`` (how the driver writes a parameter) and ``batchsize``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> "EpochWriter":
        return EpochWriter(schema.names, dict(self.options))


class EpochWriter(DataSourceWriter):
    def __init__(self, columns: list[str], options: dict[str, str]):
        missing = [n for n in ("connect", "table", "job", "epoch") if n not in options]
        if missing:
            raise ValueError(f"options are missing: {missing}")
        self.columns, self.connect, self.table = columns, options["connect"], options["table"]
        self.job, self.epoch = options["job"], int(options["epoch"])
        self.mark, self.size = options.get("mark", "?"), int(options.get("batchsize", BATCH_ROWS))

    def _open(self):
        module, function, *argument = self.connect.split(":", 2)
        return closing(getattr(importlib.import_module(module), function)(*argument))

    def _marks(self, n: int) -> str:
        return ", ".join([self.mark] * n)

    def write(self, iterator: Iterator[Row]) -> Staged:
        token, rows = uuid.uuid4().hex, 0
        insert = (f"INSERT INTO {self.table}_staged ({', '.join([*self.columns, 'token'])}) "
                  f"VALUES ({self._marks(len(self.columns) + 1)})")
        with self._open() as connection:
            while some := [(*row, token) for row in islice(iterator, self.size)]:
                connection.cursor().executemany(insert, some)
                rows += len(some)
            connection.commit()
        return Staged(token, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        names = ", ".join(self.columns)
        with self._open() as connection:
            cursor = connection.cursor()
            cursor.execute(f"SELECT 1 FROM {self.table}_epochs WHERE job = {self.mark} AND epoch = {self.mark}",
                           (self.job, self.epoch))
            fresh = cursor.fetchone() is None
            if fresh:
                cursor.execute(f"INSERT INTO {self.table}_epochs (job, epoch) VALUES ({self._marks(2)})", (self.job, self.epoch))
            for message in filter(None, messages):
                if fresh:
                    cursor.execute(f"INSERT INTO {self.table} ({names}) SELECT {names} FROM {self.table}_staged "
                                   f"WHERE token = {self.mark}", (message.token,))
                cursor.execute(f"DELETE FROM {self.table}_staged WHERE token = {self.mark}", (message.token,))
            connection.commit()

    def abort(self, messages: list[Staged | None]) -> None:
        with self._open() as connection:
            for message in filter(None, messages):
                connection.cursor().execute(f"DELETE FROM {self.table}_staged WHERE token = {self.mark}", (message.token,))
            connection.commit()


def database_rows(spark: SparkSession, connect: str, table: str, job: str, **options: str) -> BatchFn:
    """``foreachBatch`` function that writes each micro-batch of ``job`` to a table once."""
    spark.dataSource.register(DatabaseTable)

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.write.format(FORMAT).mode("append")
         .options(connect=connect, table=table, job=job, epoch=str(batch_id), **options).save())
    return write
