"""Gifts on a stream whose dimension is a stream too."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roompulse import schemas as S
from roompulse.operators.parsing import parse_lines
from roompulse.plans.gifts import rewards


class GiftLookup(StatefulProcessor):
    """Facts and versions of one gift (and salt): the last written version is kept, facts wait until there is one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "written bigint, name string, score double")
        self.waiting = handle.getListState("waiting", "id string, anchor string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.version.get()
        before = known
        for row in rows:
            if row.is_fact:
                if known is None:
                    self.waiting.appendValue((row.id, row.anchor))
                else:
                    yield self._out(key, row.id, row.anchor, known)
            elif known is None or self._age(row) >= self._age(known):
                known = (row.written, row.name, row.score)
        if known is not None and known != before:
            self.version.update(known)
            if before is None:
                for fact, anchor in self.waiting.get():
                    yield self._out(key, fact, anchor, known)
                self.waiting.clear()

    @staticmethod
    def _age(version) -> tuple:
        """Versions of one file are told apart by their values."""
        written, name, score = (version.written, version.name, version.score) if isinstance(version, Row) else version
        return written, name or "", score

    @staticmethod
    def _out(key, fact, anchor, version) -> Row:
        return Row(id=fact, anchor=anchor, gift=key[0], gifts=1, gift_name=version[1], score=version[2])

    def close(self) -> None:
        pass


def gift_facts_stream(events: DataFrame, lines: DataFrame, salts: int = 8) -> DataFrame:
    """Each gift with its name and score, as soon as a line of the gift has been read. Append mode.

    ``lines`` is a stream of gift lines with ``written`` (see :func:`roompulse.sources.files.read_lines`): the version written
    last holds for the gifts that come after it, over restarts too. Gifts of an id without a line wait in the state
    and none is lost. Facts of one gift are spread over ``salts`` tasks; the few lines are copied to all of them.
    """
    facts = rewards(events).select(
        F.col(S.GIFT).alias("gift"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(True).alias("is_fact"),
        "id", F.col(S.ANCHOR).alias("anchor"))
    dim = parse_lines(lines, S.GIFT_LINE, keep=["written"]).clean.select(
        F.col("id").alias("gift"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("is_fact"),
        "written", "name", "score")
    out = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "anchor", "gift")] + [
        T.StructField("gifts", T.IntegerType()), T.StructField("gift_name", T.StringType()), T.StructField("score", T.DoubleType())])
    found = facts.unionByName(dim, allowMissingColumns=True).groupBy("gift", "salt").transformWithState(
        GiftLookup(), out, "Append", "None")
    return found.withColumnsRenamed({"anchor": S.ANCHOR, "gift": S.GIFT})
