"""Behaviour events as protobuf messages.

Uses Spark's own protobuf functions where the session has them on its class path. Otherwise
Arrow batches go through the Python protobuf runtime. Both read the same descriptor, which is
built from the field numbers in :mod:`roompulse.schemas`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S

MESSAGE = "BehaviorEvent"
_NUMBERS = {"double": "TYPE_DOUBLE", "bigint": "TYPE_INT64", "int": "TYPE_INT32"}
# Fixed value: lastUpdate travels as text.
WIRE = {name: "string" if name == "lastUpdate" else S.BEHAVIOR[name] for name in S.PROTO_TAGS}


@lru_cache(maxsize=1)
def descriptor_set() -> bytes:
    """Serialized descriptor of the message."""
    from google.protobuf import descriptor_pb2 as pb

    field = pb.FieldDescriptorProto
    file = pb.FileDescriptorProto(name="behavior_event.proto", syntax="proto3")
    message = file.message_type.add(name=MESSAGE)
    for name, tag in S.PROTO_TAGS.items():
        kind = WIRE[name]
        if kind.startswith("map"):
            entry = message.nested_type.add(name="PropertiesEntry")
            entry.options.map_entry = True
            for number, part in enumerate(("key", "value"), 1):
                entry.field.add(name=part, number=number, type=field.TYPE_STRING,
                                label=field.LABEL_OPTIONAL)
            message.field.add(name=name, number=tag, type=field.TYPE_MESSAGE,
                              label=field.LABEL_REPEATED,
                              type_name=f".{MESSAGE}.PropertiesEntry")
        else:
            # With presence: zeros and empty text are sent, and told from what was not sent. The wire format is the same.
            message.field.add(name=name, number=tag, label=field.LABEL_OPTIONAL, proto3_optional=True,
                              oneof_index=len(message.oneof_decl),
                              type=getattr(field, _NUMBERS.get(kind, "TYPE_STRING")))
            message.oneof_decl.add(name=f"_{name}")
    return pb.FileDescriptorSet(file=[file]).SerializeToString()


@lru_cache(maxsize=1)
def message_class():
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set()).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(MESSAGE))


def _spark_has_protobuf(df: DataFrame) -> bool:
    try:
        df.sparkSession._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(
            "org.apache.spark.sql.protobuf.CatalystDataToProtobuf")
        return True
    except Exception:
        return False


def encode_events(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events to one binary column ``value``, next to the ``keep`` columns.

    Fields the events lack, and nulls, are not sent.
    """
    fields = [n for n in S.PROTO_TAGS if n in events.columns]
    sent = events.select(*keep, *[F.col(n).cast(WIRE[n]).alias(n) for n in fields])
    if _spark_has_protobuf(events):
        from pyspark.sql.protobuf.functions import to_protobuf
        return sent.select(*keep, to_protobuf(
            F.struct(*fields), MESSAGE, binaryDescriptorSet=descriptor_set()).alias("value"))
    kept = [f"`{n}` {sent.schema[n].dataType.simpleString()}" for n in keep]
    return sent.mapInArrow(_encoder(fields, list(keep)), ", ".join([*kept, "value binary"]))


def decode_events(messages: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Binary messages to typed events; fields that were not sent are null (``isNew``: 0), also those that a sender
    without field presence left out because they were zero.

    A value that is not such a message fails the job, as a stream of the wrong type should.
    """
    layout = {n: k for n, k in S.BEHAVIOR.items() if n in S.PROTO_TAGS}
    if _spark_has_protobuf(messages):
        from pyspark.sql.protobuf.functions import from_protobuf
        got = messages.select(*keep, from_protobuf(
            value, MESSAGE, binaryDescriptorSet=descriptor_set()).alias("_e")).select(
                *keep, *[F.col(f"_e.{n}").alias(n) for n in layout])
    else:
        sent = messages.select(*keep, value)
        kept = [f"`{n}` {sent.schema[n].dataType.simpleString()}" for n in keep]
        wire = [f"`{n}` {WIRE[n]}" for n in layout]
        got = sent.mapInArrow(_decoder(list(layout), value, list(keep)), ", ".join([*kept, *wire]))
    typed = {n: F.col(n).cast(k) for n, k in layout.items()}
    typed["isNew"] = F.coalesce(typed["isNew"], F.lit(0))
    return got.select(*keep, *[c.alias(n) for n, c in typed.items()])


def _maps(column: pa.MapArray) -> list[dict | None]:
    """Rows of a map column, from its flat keys and values; offsets count from their start."""
    keys, items = column.keys.to_pylist(), column.items.to_pylist()
    ends = column.offsets.to_pylist()
    out = []
    for here, after, there in zip(ends, ends[1:], column.is_valid().to_pylist()):
        pairs = zip(keys[here:after], items[here:after])
        out.append({k: v for k, v in pairs if v is not None} if there else None)
    return out


def _encoder(fields: list[str], keep: list[str]):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = message_class()
        for batch in batches:
            columns = [_maps(batch.column(n)) if n == "properties" else batch.column(n).to_pylist()
                       for n in fields]
            out = [build(**{n: v for n, v in zip(fields, row) if v is not None}).SerializeToString()
                   for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], pa.array(out, pa.binary())], [*keep, "value"])
    return encode


_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}


def _decoder(fields: list[str], value: str, keep: list[str]):
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = message_class().FromString
        for batch in batches:
            read = [parse(v) for v in batch.column(value).to_pylist()]
            columns = []
            for n in fields:
                if n == "properties":
                    bags = [m.properties for m in read]
                    ends = [0, *accumulate(map(len, bags))]
                    columns.append(pa.MapArray.from_arrays(
                        pa.array(ends, pa.int32()),
                        pa.array([k for b in bags for k in b], pa.string()),
                        pa.array([b[k] for b in bags for k in b], pa.string())))
                else:
                    columns.append(pa.array([getattr(m, n) if m.HasField(n) else None for m in read], _ARROW[WIRE[n]]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], *columns], [*keep, *fields])
    return decode
