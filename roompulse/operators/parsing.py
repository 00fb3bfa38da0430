"""From raw records to typed rows, with every bad record kept in a quarantine.

JSON scalars are read as text and then converted. A schema with number types would refuse numbers that
arrive as text, which change-logs send as a rule, and each refusal costs a parser error.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.functions.columns import record_id

_TEXTUAL = ("string", "map<string,string>")


class Parsed(NamedTuple):
    """Two views of one input; each input record feeds exactly one of them."""

    clean: DataFrame
    bad: DataFrame


def _once(value: Column) -> Column:
    """Compute ``value`` a single time per row.

    Spark merges adjacent projections and would repeat an expensive parse for every field that is
    read from it; it does not merge across a generator.
    """
    return F.explode(F.array(value))


def _typed(text: Column, kind: str) -> Column:
    if kind in _TEXTUAL:
        return text
    if kind == "timestamp":
        return F.coalesce(text.try_cast("timestamp"),
                          F.timestamp_millis(text.try_cast("bigint")))
    return text.try_cast(kind)


def _text_layout(layout: dict[str, str]) -> dict[str, str]:
    return {n: k if k in _TEXTUAL else "string" for n, k in layout.items()}


def _json(text: str, layout: str) -> Column:
    """Text to a record; null for text that is anything but one object.

    The parser stops after the first object, so it is given the text as the only element of a list: what follows an
    object then breaks the list or makes it longer. Text that does not end like an object is not parsed at
    all: breaking off is the usual damage, and a parser error costs far more than a parse.
    """
    one = F.concat(F.lit("["), F.col(text), F.lit("]"))
    return F.when(F.rtrim(F.col(text), F.lit(" \t\r\n")).endswith("}"),
                  F.from_json(one, f"array<struct<{layout}>>"))


def _only(records: str) -> Column:
    """The element of a list that holds one, else null."""
    return F.when(F.size(records) == 1, F.get(F.col(records), F.lit(0)))


def _broken(record: Column) -> Column:
    return record.isNull()


def _typed_once(record: Column, layout: dict[str, str]) -> tuple[Column, Column]:
    """All fields of a record converted as ``typed``, and whether one of them lost its text: no conversion is made twice."""
    typed = F.struct(*[_typed(record.getField(n), k).alias(n) for n, k in layout.items()])
    texts = {n: record.getField(n) for n, k in layout.items() if k not in _TEXTUAL}
    lost = [F.col("typed").getField(n).isNull() & t.isNotNull() & (F.trim(t) != "") for n, t in texts.items()]
    return _once(typed).alias("typed"), reduce(or_, lost)


def _faults(record: Column, layout: dict[str, str]) -> dict[str, Column]:
    """Per field, whether it holds text that is not of its type. Blank text counts as null."""
    out = {}
    for n, k in layout.items():
        if k not in _TEXTUAL:
            text = record.getField(n)
            out[n] = text.isNotNull() & _typed(text, k).isNull() & (F.trim(text) != "")
    return out


def _faulty(record: Column, layout: dict[str, str]) -> Column:
    return reduce(or_, _faults(record, layout).values())


def parse_events(raw: DataFrame, value: str = "value", with_record_id: bool = False) -> Parsed:
    """JSON text to behaviour events.

    ``with_record_id`` takes ``id`` from the Kafka position instead of from the text. ``"1"`` and
    ``1`` are the same number; unknown fields are ignored. Bad: text that is not a JSON object (also
    empty text and JSON ``null``) and numbers that cannot be read.
    """
    rec_id = record_id() if with_record_id else F.lit(None).cast("string")
    staged = (raw.select(F.col(value).cast("string").alias("raw"), rec_id.alias("record_id"))
              .select("*", _once(_json("raw", S.ddl(_text_layout(S.BEHAVIOR)))).alias("list"))
              .withColumn("e", _only("list")))
    event = F.col("e")
    broken, faulty = _broken(event), _faulty(event, S.BEHAVIOR)

    typed, lost = _typed_once(event, S.BEHAVIOR)
    columns = {n: F.col("typed").getField(n) for n in S.BEHAVIOR}
    if with_record_id:
        columns["id"] = F.col("record_id")
    for flag in ("isNew", "isN"):
        columns[flag] = F.coalesce(columns[flag], F.lit(0))
    clean = (staged.filter(~broken).select("record_id", "e", typed).filter(~lost)
             .select(*[c.alias(n) for n, c in columns.items()]))

    names = F.concat_ws(",", *[F.when(f, n) for n, f in _faults(event, S.BEHAVIOR).items()])
    bad = staged.filter(broken | faulty).select(
        "record_id", "raw",
        F.when(broken, "not a JSON object")
        .otherwise(F.concat(F.lit("unreadable: "), names)).alias("reason"))
    return Parsed(clean, bad)


def parse_changes(raw: DataFrame, layout: dict[str, str], value: str = "value",
                  keep_deletes: bool = True) -> Parsed:
    """Change-log envelopes ``{"type": ..., "data": [...]}`` to one typed row per element.

    Only INSERT, UPDATE and DELETE envelopes count; each row carries the ``type`` of its envelope.
    A DELETE row stays an ordinary row unless ``keep_deletes`` is false. An element with an
    unreadable field is left out of ``clean`` and puts its envelope into ``bad``.
    """
    fields = ", ".join(f"`{n}`: {k}" for n, k in _text_layout(layout).items())
    staged = (raw.select(F.col(value).cast("string").alias("raw"))
              .select("*", _once(_json("raw", f"`type` string, `data` array<struct<{fields}>>"))
                      .alias("list")).withColumn("e", _only("list")))
    event, element = F.col("e"), F.col("element")
    types = [t for t in S.CHANGE_TYPES if keep_deletes or t != "DELETE"]
    kept = event.getField("type").isin(types)
    typed, lost = _typed_once(element, layout)
    clean = (staged.filter(~_broken(event) & kept)
             .select(event.getField("type").alias("type"),
                     F.explode(event.getField("data")).alias("element"))
             .filter(element.isNotNull()).select("type", "element", typed).filter(~lost)
             .select(*[F.col("typed").getField(n).alias(n) for n in layout], "type"))
    bad = staged.filter(_broken(event) | kept).select(
        "raw",
        F.when(_broken(event), "not a JSON object")
        .when(event.getField("data").isNull(), "no data")
        .when(F.exists(event.getField("data"), lambda x: x.isNull() | _faulty(x, layout)),
              "unreadable element").alias("reason"),
    ).filter("reason is not null")
    return Parsed(clean, bad)


def parse_lines(raw: DataFrame, layout: dict[str, str], value: str = "value",
                separator: str = ",", keep: Sequence[str] = ()) -> Parsed:
    """Delimited text lines to typed columns, in the order of ``layout``; columns to ``keep`` are passed on."""
    text = F.col(value).cast("string")
    staged = raw.select(*keep, text.alias("raw"), _once(F.split(text, re.escape(separator), -1)).alias("f"))
    typed = {name: F.get(F.col("f"), F.lit(i)).try_cast(kind)
             for i, (name, kind) in enumerate(layout.items())}
    good = F.col("raw").isNotNull() & (F.size("f") >= len(layout))
    for name, kind in layout.items():
        if kind != "string":
            good = good & typed[name].isNotNull()
    clean = staged.filter(good).select(*[c.alias(n) for n, c in typed.items()], *keep)
    bad = staged.filter(F.coalesce(~good, F.lit(True))).select(
        "raw", F.lit("unreadable line").alias("reason"))
    return Parsed(clean, bad)
