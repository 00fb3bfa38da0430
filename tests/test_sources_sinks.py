"""Readers and writers, as far as they go without a broker or a database."""

import json
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roompulse import jobs
from roompulse import schemas as S
from roompulse import tables as D
from roompulse.config import JobConfig
from roompulse.functions.protobuf import decode_events
from roompulse.plans import etl, users
from roompulse.sinks import tables as sinks
from roompulse.sinks.database import EpochWriter, database_rows
from roompulse.sinks.kafka import routed_messages
from roompulse.sources import files, kafka
from tests.streams import run, run_batches

SF = "/root/testdata/sf0.001"


@pytest.fixture
def config(tmp_path):
    path = tmp_path / "job.properties"
    path.write_text(
        "# job\nkafka.input.topics=a,b\nkafka.product.output = product-log\n"
        "kafka.gift.output:gift-log\nbootstrap.servers=h1:9092,h2:9092\ncheckpoint.interval=30000\n"
        "checkpoint.path=hdfs://x/y\nsome.other=1\n")
    return JobConfig.from_properties(path)


def test_config(config):
    assert config.bootstrap_servers == "h1:9092,h2:9092"
    assert config.checkpoint_path == "hdfs://x/y"
    assert config.starting_offsets == "earliest"
    assert config.trigger == {"processingTime": "30000 milliseconds"}
    assert JobConfig().checkpoint_interval_ms == 60_000
    with pytest.raises(ValueError, match="kafka.input.main"):
        config.require("main_topic")


def test_kafka_options(config):
    assert kafka.kafka_options(config, max_offsets=5) == {
        "kafka.some.other": "1", "kafka.bootstrap.servers": "h1:9092,h2:9092", "subscribe": "a,b",
        "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5"}
    assert kafka.kafka_options(config, "x")["subscribe"] == "x"


def test_etl_from_staged_records_to_messages_and_back(spark, config):
    """Kafka-shaped files stream through parsing, routing and encoding; decoding gives the events."""
    folder = tempfile.mkdtemp() + "/in"
    (D.raw_behavior(spark, SF).withColumns({
        "key": F.lit(None).cast("binary"), "timestamp": F.current_timestamp(),
        "timestampType": F.lit(0)}).select(*S.KAFKA_RECORD).write.parquet(folder))
    records = files.read_staged(spark, folder)
    assert kafka.values_with_id(records).columns == ["id", "value"]
    clean = etl.clean_events(records).clean
    messages = run(routed_messages(etl.etl_route(clean), config))
    assert messages.columns == ["topic", "value"]
    want = etl.etl_route(etl.clean_events(D.raw_behavior(spark, SF)).clean)
    counts = {r["topic"]: r["count"] for r in messages.groupBy("topic").count().collect()}
    routes = {r["route"]: r["count"] for r in want.groupBy("route").count().collect()}
    assert counts == {"product-log": routes["product"], "gift-log": routes["gift"]}
    back = kafka.typed_events(messages)
    assert sorted(r[0] for r in back.select("id").collect()) == sorted(
        r[0] for r in want.select("id").collect())
    assert decode_events(messages).filter("properties['anchor_id'] is null").count() == 0


def test_replayed_batch_counts_once(spark):
    folder = tempfile.mkdtemp()
    write = sinks.batch_table(folder)
    write(spark.range(3), 0)
    write(spark.range(5), 1)
    write(spark.range(5), 1)
    assert sinks.read_table(spark, folder).count() == 8


def test_text_stream(spark):
    folder = tempfile.mkdtemp() + "/lines"
    D.groupon_main_lines(spark, SF).write.text(folder)
    assert run(files.read_lines(spark, folder)).count() == files.read_lines(
        spark, folder, streaming=False).count() == D.table(spark, SF, "orders").count()


def test_jdbc_rows_carry_their_batch(spark, monkeypatch):
    """No database here: the write itself is replaced, everything before it runs."""
    calls = []

    class Saved:
        def __init__(self, rows, *args, **options):
            self.seen = (rows.columns, rows.select("batch_id").distinct().collect()[0][0], args, options)

        def save(self):
            calls.append(self.seen)

    monkeypatch.setattr(sinks, "jdbc_writer", Saved)
    removed = []
    rows = users.user_event_rows(users.flag_new_users(D.behavior(spark, SF)))
    sinks.jdbc_rows("jdbc:x", "tb_user_event", delete_batch=removed.append, driver="d")(rows, 4)
    columns, batch, args, options = calls[0]
    assert columns == ["id", "deviceId", "eventId", "isNew", "os", "province", "channel",
                       "deviceType", "eventTime", "date", "hour", "batch_id"]
    assert (batch, args, options, removed) == (4, ("jdbc:x", "tb_user_event", 100), {"driver": "d"}, [4])


def test_console_sink(spark):
    folder = tempfile.mkdtemp() + "/lines"
    spark.range(3).selectExpr("string(id) value").write.text(folder)
    q = (files.read_lines(spark, folder).writeStream.format("console")
         .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    assert q.awaitTermination(60)


def test_routed_tables(spark):
    folder = tempfile.mkdtemp() + "/in"
    D.behavior(spark, SF).select("id", "eventId").write.parquet(folder)
    stream = spark.readStream.schema("id string, eventId string").parquet(folder)
    out = tempfile.mkdtemp()
    run_batches(etl.etl_route(stream), sinks.routed_tables(out))
    assert {r["route"] for r in sinks.read_table(spark, out).collect()} == {"product", "gift"}


def test_database_rows_count_once(spark, tmp_path):
    """A micro-batch that is run again, or whose first attempt staged rows and died, leaves its rows once."""
    file = tmp_path / "tables.json"
    write = database_rows(spark, f"tests.recording:connect:{file}", "users", "flags", batchsize="7")
    other = database_rows(spark, f"tests.recording:connect:{file}", "users", "other job")
    rows = lambda n: spark.range(n).select("id", F.concat(F.lit("d"), "id").alias("device"))
    write(rows(20), 0)
    lost = EpochWriter(["id", "device"], {"connect": f"tests.recording:connect:{file}", "table": "users", "job": "flags", "epoch": "1"})
    lost.write(iter([(900, "lost"), (901, "lost")]))     # its task ended, its commit never came
    for _ in range(2):
        write(rows(30), 1)
    other(rows(3), 0)
    tables = json.loads(file.read_text())
    assert Counter(r["id"] for r in tables["users"]) == Counter([*range(20), *range(30), *range(3)])
    assert sorted((r["job"], r["epoch"]) for r in tables["users_epochs"]) == [("flags", 0), ("flags", 1), ("other job", 0)]
    assert {r["device"] for r in tables["users_staged"]} == {"lost"}
    lost.abort([lost.write(iter([(902, "gone")]))])
    assert {r["device"] for r in json.loads(file.read_text())["users_staged"]} == {"lost"}


def test_job_writes_to_the_database_of_its_properties(spark, tmp_path):
    folder, file = str(tmp_path / "in"), tmp_path / "tables.json"
    (D.raw_behavior(spark, SF).withColumns({
        "key": F.lit(None).cast("binary"), "timestamp": F.current_timestamp(),
        "timestampType": F.lit(0)}).select(*S.KAFKA_RECORD).coalesce(2).write.parquet(folder))
    path = tmp_path / "job.properties"
    path.write_text(f"checkpoint.path={tmp_path}/progress\nsink.database.connect=tests.recording:connect:{file}\n"
                    "sink.database.table=user_events\n")
    given = jobs.Inputs(spark, JobConfig.from_properties(path), {}, lambda _: files.read_staged(spark, folder))
    for _ in range(2):      # started again, it adds nothing
        query = jobs.start("new-user-flags", given, availableNow=True)
        assert query.awaitTermination(120) and query.exception() is None
    want = users.flag_new_users(etl.clean_events(D.raw_behavior(spark, SF)).clean)
    got = json.loads(file.read_text())["user_events"]
    assert len(got) == want.count() and sum(r["isNew"] for r in got) == want.filter("isN = 1").count()
