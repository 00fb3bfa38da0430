"""Every job from staged records to its result table."""

import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roompulse import jobs
from roompulse import schemas as S
from roompulse import tables as D
from roompulse.config import JobConfig
from roompulse.functions.protobuf import encode_events
from roompulse.operators.parsing import parse_changes
from roompulse.plans import audience, etl, gifts, groupon, products, users
from roompulse.sinks.tables import read_table
from roompulse.sources.files import read_lines, read_staged
from roompulse.streaming.gifts import gift_facts_stream
from roompulse.streaming.metrics import gift_total_batches
from tests.streams import run_batches

SF = "/root/testdata/sf0.001"


def kafka_shaped(df, topic):
    """Rows with a ``value`` as Kafka records."""
    return df.select(F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
                     F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
                     F.monotonically_increasing_id().alias("offset"),
                     F.current_timestamp().alias("timestamp"), F.lit(0).alias("timestampType"))


@pytest.fixture(scope="module")
def world(spark):
    base = tempfile.mkdtemp()
    kafka_shaped(D.raw_behavior(spark, SF), "behavior").coalesce(1).write.parquet(f"{base}/behavior")
    kafka_shaped(encode_events(D.behavior(spark, SF)), "typed").write.parquet(f"{base}/typed")
    kafka_shaped(D.raw_order_main(spark, SF), "main").coalesce(1).write.parquet(f"{base}/main")
    kafka_shaped(D.raw_order_detail(spark, SF), "detail").coalesce(1).write.parquet(f"{base}/detail")
    (D.gift_lines(spark, SF).filter("value like '%,1'")
     .select(F.substring_index("value", ",", 3).alias("value")).write.text(f"{base}/gifts"))
    D.groupon_detail_lines(spark, SF).coalesce(1).write.text(f"{base}/groupon_detail")
    D.groupon_main_lines(spark, SF).coalesce(1).write.text(f"{base}/groupon_main")
    D.order_lines(spark, SF).coalesce(1).write.text(f"{base}/orders")
    D.order_main(spark, SF).withColumn("city", F.lit(None).cast("string")).withColumn(
        "type", F.lit("TABLE")).write.parquet(f"{base}/order_table")
    return base


def inputs(spark, base, topic="behavior"):
    config = JobConfig(input_topics=topic, main_topic="main", detail_topic="detail",
                       checkpoint_path=tempfile.mkdtemp())
    names = ("gifts", "groupon_detail", "groupon_main", "orders", "order_table")
    return jobs.Inputs(spark, config, {**{n: f"{base}/{n}" for n in names}, "results": tempfile.mkdtemp()},
                       lambda topics: read_staged(spark, f"{base}/{topics or topic}"))


def results(spark, job, given):
    query = jobs.start(job, given, availableNow=True)
    assert query.awaitTermination(120)
    got = read_table(spark, given.folder("results"))
    if job == "audience-valid":     # one row per room and change: the last holds
        got = got.groupBy(S.ANCHOR).agg(F.max_by("valid_total", "batch_id").alias("valid_total"))
    return got.drop("batch_id")


def clean(spark):
    return etl.clean_events(D.raw_behavior(spark, SF)).clean


def newest(df, time="timestamp"):
    return df.agg(F.max(time)).first()[0]


def closed_groupons(spark):
    makes = (D.groupon_detail_lines, D.groupon_main_lines, D.order_lines)
    limit = min(m(spark, SF).agg(F.max(F.split("value", ",")[0].cast("bigint"))).first()[0] for m in makes)
    return groupon.groupon_enriched(*[m(spark, SF) for m in makes]).filter(f"unix_millis(window.end) <= {limit}")


USER_ROWS = ["deviceId", "isNew", "eventTime", "channel"]
# The table form of each job's result and the columns to compare; ids tell the place in the staged file and stay out.
WANTED = {
    "quarantine": (lambda s: etl.clean_events(D.raw_behavior(s, SF)).bad, ["raw", "reason"]),
    "quarantine-details": (lambda s: parse_changes(D.raw_order_detail(s, SF), S.ORDER_DETAIL).bad, ["raw", "reason"]),
    "quarantine-orders": (lambda s: parse_changes(D.raw_order_main(s, SF), S.ORDER_MAIN).bad, ["raw", "reason"]),
    "new-user-flags": (lambda s: users.user_event_rows(users.flag_new_users(clean(s))), USER_ROWS),
    "new-user-flags-approx": (lambda s: users.user_event_rows(users.flag_new_users(clean(s))), USER_ROWS),
    "new-user-count": (lambda s: users.new_user_totals(clean(s)), ["dims", "deviceType", "releaseChannel", "new_users"]),
    "audience": (lambda s: audience.audience_totals(clean(s)), ["anchor_id", "online", "total"]),
    "audience-rows": (lambda s: audience.audience_running(clean(s)), ["anchor_id", "timestamp", "online", "total"]),
    "audience-valid": (lambda s: audience.audience_valid(clean(s), as_of=newest(audience.live_events(clean(s), S.ANCHOR, S.SESSION))),
                       ["anchor_id", "valid_total"]),
    "hot-products": (lambda s: products.hot_products(clean(s)).filter(
        F.col("window_end") <= newest(products.product_events(clean(s)))), ["product_id", "window_start", "count", "sort"]),
    "group-purchases": (closed_groupons, ["user", "groupon", "order_id", "category", "amount"]),
    "gift-facts": (lambda s: gifts.gift_facts(clean(s), gifts.gift_dimension(
        D.gift_lines(s, SF).filter("value like '%,1'"))).filter("score is not null"), ["anchor_id", "gift_id", "gifts", "gift_name", "score"]),
    "gifts": (lambda s: gifts.gift_totals(clean(s), gifts.gift_dimension(
        D.gift_lines(s, SF).filter("value like '%,1'"))), ["anchor_id", "gifts", "points"]),
}


@pytest.mark.parametrize("job", sorted(WANTED))
def test_job_equals_table_form(spark, world, job):
    make, columns = WANTED[job]
    got, want = results(spark, job, inputs(spark, world)), make(spark)
    assert want.count() > 0
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_every_job_is_compared():
    assert set(jobs.JOBS) == set(WANTED) | {"typed-events", "order-details", "audience-windows"}


def test_audience_windows_job(spark, world):
    """Windows of arrival: all rows arrive in one batch, whose window is still open, unless it fell between two."""
    got = results(spark, "audience-windows", inputs(spark, world))
    assert {"anchor_id", "window_start", "window_end", "online", "total"} <= set(got.columns)


def test_typed_events_job(spark, world):
    got = results(spark, "typed-events", inputs(spark, world, "typed"))
    assert got.count() == D.behavior(spark, SF).count()


def test_job_to_a_sink_of_choice(spark, world, capsys):
    seen = []
    given = inputs(spark, world)
    query = jobs.start("hot-products", given, sink=lambda batch, n: seen.append((batch.columns, batch.count())),
                       availableNow=True)
    assert query.awaitTermination(120)
    assert seen and all("sort" in columns for columns, _ in seen) and sum(n for _, n in seen) > 0
    query = jobs.start("audience", inputs_without_results(spark, world), availableNow=True)
    assert query.awaitTermination(120) and query.exception() is None
    assert "rows" in capsys.readouterr().out


def inputs_without_results(spark, base):
    given = inputs(spark, base)
    del given.folders["results"]
    return given


def test_gift_totals_follow_a_dimension_that_changes(spark):
    """A line written twice counts once; a new score holds for later gifts only."""
    lines, folder, seen = ["7,rose,1.0", "7,rose,2.0"], tempfile.mkdtemp(), []
    step = gift_total_batches(
        lambda: gifts.gift_dimension(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)),
        folder, lambda df, n: seen.append([tuple(r) for r in df.select("anchor_id", "gifts", "points").collect()]))
    batch = spark.createDataFrame([("1", S.LIVE_REWARD, {S.ANCHOR: "a", S.GIFT: "7"})],
                                  "id string, eventId string, properties map<string,string>")
    step(batch, 0)
    lines.append("7,rose,5.0")
    step(batch, 1)
    step(batch, 1)
    assert seen == [[("a", 1, 2.0)], [("a", 2, 7.0)], [("a", 2, 7.0)]]


def test_gifts_wait_for_their_line_over_restarts(spark):
    """Facts before the dimension are given out once it comes; a later file changes the score of later facts only."""
    base, checkpoint, seen = tempfile.mkdtemp(), tempfile.mkdtemp(), []
    layout = "id string, eventId string, properties map<string,string>"

    def step(facts, lines):
        if facts:
            spark.createDataFrame([(i, S.LIVE_REWARD, {S.ANCHOR: "a", S.GIFT: g}) for i, g in facts], layout).coalesce(
                1).write.mode("append").parquet(f"{base}/events")
        if lines:
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{base}/lines")
        df = gift_facts_stream(spark.readStream.schema(layout).parquet(f"{base}/events"),
                               read_lines(spark, f"{base}/lines", with_time=True), salts=2)
        new = []
        run_batches(df, lambda b, n: new.extend((r["id"], r["score"]) for r in b.collect()), checkpoint=checkpoint)
        seen.append(sorted(new))
    (Path(base) / "lines").mkdir()
    step([("1", "7"), ("2", "7"), ("3", "8")], [])
    step([], ["7,rose,1.0"])
    time.sleep(1.1)
    step([], ["7,rose,5.0", "bad line"])
    step([("4", "7"), ("5", "8")], [])
    step([], ["8,car,9.0"])
    assert seen == [[], [("1", 1.0), ("2", 1.0)], [], [("4", 5.0)], [("3", 9.0), ("5", 9.0)]]


def test_last_written_file_holds(spark):
    """Of several files of gift lines the one written last decides, whatever partition reads it."""
    folder = tempfile.mkdtemp()
    for name, score in (("z.txt", 1), ("a.txt", 2), ("m.txt", 3)):
        (Path(folder) / name).write_text(f"7,rose,{score}.0\n")
        time.sleep(0.05)
    dim = gifts.gift_dimension(read_lines(spark, folder, streaming=False, with_time=True))
    assert [tuple(r) for r in dim.collect()] == [("7", "rose", 3.0)]


def test_order_job_equals_lookup(spark, world):
    """Every detail whose window has closed comes out once, with its order from the window or from the table."""
    got = results(spark, "order-details", inputs(spark, world))
    raw = kafka_shaped(D.raw_order_detail(spark, SF), "detail")
    every = parse_changes(raw, S.ORDER_DETAIL).clean
    newest = every.agg(F.max(F.unix_millis("update_time"))).first()[0]
    want = every.filter(f"unix_millis(update_time) div 5000 * 5000 + 5000 <= {newest} - 2000")
    assert sorted((r["id"], r["amount"]) for r in got.collect()) == sorted((r["id"], r["amount"]) for r in want.collect())
    assert got.filter("found_by is null or main_oid <> order_id").count() == 0 and set(S.ORDER_DETAIL) <= set(got.columns)


def test_missing_folder_is_named(spark):
    with pytest.raises(ValueError, match="gifts"):
        jobs.Inputs(spark, JobConfig()).lines("gifts")
