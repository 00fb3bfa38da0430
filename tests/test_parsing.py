"""Edge cases of reading raw records."""

import json

from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.functions.columns import event_date, event_hour, prop, record_id
from roompulse.functions.protobuf import decode_events, encode_events, message_class
from roompulse.operators.filters import lacking, only_event, only_prefix, route, with_props
from roompulse.operators.parsing import parse_changes, parse_events, parse_lines


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_events_good_and_bad(spark):
    raw = texts(
        spark,
        '{"deviceId":"d1","eventId":"appLaunch","timestamp":1000,"isNew":1,"properties":{"a":1,"b":"x"}}',
        '{"deviceId":7,"timestamp":"2000","latitude":"1.5","extra":{"deep":[1]}}',
        '{"deviceId":"d3","timestamp":""}',
        '{"deviceId":"d4","timestamp":"soon","isNew":"no"}',
        '{"deviceId":"d5","eventId":',
        '{"deviceId":"d6"} tail', '{"deviceId":"d8"} \n',
        "", "null", "[1]", "word", None)
    got = parse_events(raw)
    rows = {r["deviceId"]: r for r in got.clean.collect()}
    assert set(rows) == {"d1", "7", "d3", "d8"}
    assert got.clean.columns == list(S.BEHAVIOR)
    assert rows["d1"]["timestamp"] == 1000 and rows["d1"]["isNew"] == 1 and rows["d1"]["isN"] == 0
    assert rows["d1"]["properties"] == {"a": "1", "b": "x"}
    assert rows["7"]["timestamp"] == 2000 and rows["7"]["latitude"] == 1.5
    assert rows["d3"]["timestamp"] is None
    bad = {r["raw"]: r["reason"] for r in got.bad.collect()}
    assert bad.pop('{"deviceId":"d4","timestamp":"soon","isNew":"no"}') == "unreadable: timestamp,isNew"
    assert set(bad.values()) == {"not a JSON object"}
    assert set(bad) == {'{"deviceId":"d5","eventId":', '{"deviceId":"d6"} tail',
                        "", "null", "[1]", "word", None}


def test_record_id_replaces_id(spark):
    raw = spark.createDataFrame([(bytearray(b'{"id":"old","deviceId":"d"}'), "t", 3, 41)],
                                "value binary, topic string, partition int, offset bigint")
    assert parse_events(raw, with_record_id=True).clean.first()["id"] == "t-3-41"
    assert raw.select(record_id().alias("i")).first()["i"] == "t-3-41"


def envelope(kind, *rows):
    return json.dumps({"type": kind, "data": list(rows)})


def test_changes(spark):
    one = {"oid": 1, "total_money": 2.5, "status": 101, "update_time": "2021-11-01 10:00:00"}
    as_text = {"oid": "2", "total_money": "3", "status": "", "update_time": "1635760800000"}
    wrong = {"oid": "x", "update_time": "2021-11-01 10:00:00"}
    bad_date = {"oid": 4, "update_time": "whenever"}
    raw = texts(
        spark, envelope("INSERT", one, as_text), envelope("DELETE", one), envelope("TRUNCATE", one),
        envelope("UPDATE"), envelope("UPDATE", wrong, one), envelope("INSERT", bad_date),
        '{"type":"INSERT"}', '{"type":"INSERT","data":[{"oid":', "null", "", '{"data":[]}')
    got = parse_changes(raw, S.ORDER_MAIN)
    rows = sorted((r["oid"], r["type"], r["total_money"], r["status"]) for r in got.clean.filter(
        "status is not null").collect())
    assert rows == [(1, "DELETE", 2.5, 101), (1, "INSERT", 2.5, 101), (1, "UPDATE", 2.5, 101)]
    text = got.clean.filter("oid = 2").select("*", F.unix_millis("update_time").alias("ms")).first()
    assert (text["total_money"], text["status"], text["ms"]) == (3.0, None, 1635760800000)
    reasons = sorted(r["reason"] for r in got.bad.collect())
    assert reasons == ["no data", "not a JSON object", "not a JSON object", "not a JSON object",
                       "unreadable element", "unreadable element"]
    assert parse_changes(raw, S.ORDER_MAIN, keep_deletes=False).clean.filter(
        "type = 'DELETE'").count() == 0


def test_lines(spark):
    got = parse_lines(texts(spark, "1,rose,2.5", "2,ring,x", "3,car", "4,a,1,more", None),
                      S.GIFT_LINE)
    assert [tuple(r) for r in got.clean.orderBy("id").collect()] == [("1", "rose", 2.5), ("4", "a", 1.0)]
    assert got.bad.count() == 3
    dotted = parse_lines(texts(spark, "1|rose|2.5"), S.GIFT_LINE, separator="|")
    assert dotted.clean.first()["name"] == "rose"


def test_date_and_hour(spark):
    df = spark.createDataFrame([(1635782400000,)], "timestamp bigint")  # 2021-11-01 16:00 UTC
    assert tuple(df.select(event_date(), event_hour()).first()) == ("20211101", "16")
    assert tuple(df.select(event_date(zone="Asia/Shanghai"), event_hour(zone="Asia/Shanghai")).first()) \
        == ("20211102", "00")


def test_missing_property_is_kept_aside(spark):
    df = spark.sql("select 'liveEnter' eventId, map('anchor_id','1') properties union all "
                   "select 'liveEnter', map('other','1') union all select 'liveEnter', null")
    assert with_props(df, S.ANCHOR).count() == 1
    assert lacking(df, S.ANCHOR).count() == 2
    assert df.filter(prop("anchor_id").isNull()).count() == 2


def test_filters_and_routes_overlap(spark):
    df = spark.createDataFrame([("productView",), ("liveReward",), ("other",), (None,)], "eventId string")
    assert only_event(df, "liveReward").count() == 1
    assert only_prefix(df, "product").count() == 1
    both = route(df, {"a": F.col("eventId").startswith("product"), "b": F.col("eventId") == "productView"})
    assert sorted(r["route"] for r in both.collect()) == ["a", "b"]


def test_protobuf_round_trip(spark):
    rows = spark.sql("""select 'i' id, 'd' deviceId, cast(12.5 as double) latitude, cast(null as double) longitude,
        bigint(99) timestamp, map('anchor_id','3') properties, bigint(7) lastUpdate, 1 isNew, 'x' extra""")
    got = decode_events(encode_events(rows)).first()
    assert (got["id"], got["latitude"], got["longitude"], got["timestamp"], got["properties"],
            got["lastUpdate"], got["isNew"], got["eventId"]) == (
        "i", 12.5, None, 99, {"anchor_id": "3"}, 7, 1, None)
    assert "isN" not in got.asDict() and decode_events(encode_events(rows)).columns == [
        n for n in S.BEHAVIOR if n != "isN"]


def test_protobuf_keeps_zeros(spark):
    """Zeros and empty text come back as they were, nulls as nulls."""
    rows = [("a", 0.0, 0, "", 0), ("", -0.0, None, None, 1), (None, None, 5, "x", None)]
    events = spark.createDataFrame(rows, "id string, latitude double, timestamp bigint, city string, isNew int")
    back = decode_events(encode_events(events)).select(*events.columns)
    want = [(*r[:4], r[4] or 0) for r in rows]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, want))


def test_protobuf_wire_format():
    fields = {f.name: (f.number, f.type) for f in message_class().DESCRIPTOR.fields}
    assert {n: t for n, (t, _) in fields.items()} == S.PROTO_TAGS
    assert 23 not in S.PROTO_TAGS.values() and "isN" not in fields
    assert fields["lastUpdate"][1] == fields["id"][1]
    assert message_class()(id="a").SerializeToString() == b"\n\x01a"


def test_map_column_rows():
    import pyarrow as pa
    from roompulse.functions.protobuf import _maps
    column = pa.array([[("a", "1"), ("b", None)], None, [], [("c", "3")]], pa.map_(pa.string(), pa.string()))
    rows = [{"a": "1"}, None, {}, {"c": "3"}]
    for start in range(4):
        assert _maps(column.slice(start)) == rows[start:]


def test_each_field_is_converted_once(spark):
    """Of two wanted fields the plan holds the conversions of the record a single time."""
    import re
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    raw = spark.createDataFrame([('{"type":"INSERT","data":[{"id":"1","money":"2.5"}]}',)], "value string")
    plan = parse_changes(raw, S.ORDER_DETAIL).clean.select("id", "money")._jdf.queryExecution().optimizedPlan().toString()
    numbers = [k for k in S.ORDER_DETAIL.values() if k in ("bigint", "int", "double")]
    times = [k for k in S.ORDER_DETAIL.values() if k == "timestamp"]
    assert len(re.findall("try_cast", plan)) == len(numbers) + 2 * len(times)
    events = parse_events(raw).clean.select("latitude", "timestamp")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("try_cast", events)) == sum(k in ("bigint", "int", "double") for k in S.BEHAVIOR.values())
