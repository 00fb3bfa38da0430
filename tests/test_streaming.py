"""Streams give what the batch forms give on the same rows."""

import tempfile

import pytest
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse import tables as D
from roompulse.operators.filters import with_props
from roompulse.plans import audience, etl, gifts, groupon, orders, products, users
from roompulse.sinks.tables import batch_table, read_table, routed_tables
from roompulse.streaming import metrics as M
from roompulse.streaming import orders as O
from roompulse.streaming.scalable_bloom import Growth, SlicedBloom
from roompulse.streaming.stateful import bloom_seen_stream, first_rows_stream
from tests.streams import run, run_batches, staged, stream

SF = "/root/testdata/sf0.001"
HOUR, DAY = 3_600_000, 86_400_000


def bag(df, columns=None):
    columns = sorted(columns or df.columns)
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


@pytest.fixture(scope="module")
def events(spark):
    return D.behavior(spark, SF).withColumn("isNew", F.lit(1))


@pytest.fixture(scope="module")
def source(events):
    return staged(events, "timestamp", 4)


@pytest.mark.parametrize("salts", [1, 3])
def test_first_seen(spark, events, source, salts):
    got = run(M.flag_new_users_stream(stream(spark, source), salts))
    want = users.flag_new_users(events)
    assert bag(got, ["id", "deviceId", "isN"]) == bag(want, ["id", "deviceId", "isN"])


def test_first_seen_bloom(spark, events, source):
    """With few devices the growing filter misses none: the flags are the exact ones."""
    got = run(M.flag_new_users_approx_stream(stream(spark, source)))
    want = users.flag_new_users(events)
    assert bag(got, ["id", "deviceId", "isN"]) == bag(want, ["id", "deviceId", "isN"])


def test_growing_bloom_filter_on_a_stream(spark):
    """One type, one part, many pages, three micro-batches of which the last repeats: no device is flagged twice."""
    devices = spark.range(30_000).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("d"), F.col("id") % 20_000).alias("deviceId"),
        F.lit("x").alias("deviceType"), F.col("id").alias("timestamp"))
    rows = bloom_seen_stream(stream(spark, staged(devices, "timestamp", 3)), "deviceType", "deviceId", ["timestamp", "id"],
                             Growth(parts=1))
    got = run(rows)
    new = got.filter("isN = 1")
    assert got.count() == 30_000 and new.select("deviceId").distinct().count() == new.count()
    assert 20_000 * 0.97 <= new.count() <= 20_000 and new.filter("timestamp >= 20000").count() == 0


class _Kept(dict):
    def get(self, slice_, page):
        return super().get((slice_, page))

    def put(self, slice_, page, bits):
        self[slice_, page] = bits


@pytest.mark.parametrize("keys,parts", [(2_000_000, 256), (150_000, 1)])
def test_filter_grows_with_its_keys(keys, parts):
    """Two million devices of one type: below 3 % are missed, none comes back as new, and a call reads few pages."""
    import numpy as np
    hashes = np.random.default_rng(keys).integers(-2**63, 2**63, keys).tolist()
    growth, new, known = Growth(parts=parts), 0, 0
    for part in range(parts):
        own = [h for h in hashes[part * (keys // parts):(part + 1) * (keys // parts)]]
        pages, size = _Kept(), (1, 0)
        for some in (own[:len(own) // 2], own[len(own) // 2:]):
            bloom = SlicedBloom(growth, pages, *size, cached=64)
            new += sum(map(bloom.add, some))
            bloom.save()
            size = bloom.slices, bloom.filled
        bloom = SlicedBloom(growth, pages, *size)
        known += sum(bloom.add(h) for h in own[:200])
        assert len(pages) < 1 << size[0]
    assert new >= 0.97 * (keys // parts * parts) and known == 0


def test_pages_are_read_when_touched():
    pages, reads = _Kept(), []
    bloom = SlicedBloom(Growth(), pages)
    for h in range(20_000):
        bloom.add(h * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    bloom.save()
    pages.get = lambda s, p: reads.append((s, p)) or dict.get(pages, (s, p))
    SlicedBloom(Growth(), pages, bloom.slices, bloom.filled).add(12345)
    assert len(reads) == len(set(reads)) <= bloom.slices and len(pages) > 20


def test_first_rows(spark, events, source):
    rows = stream(spark, source).filter(F.col("eventId") == S.APP_LAUNCH)
    got = run(first_rows_stream(rows, "deviceId", "id"))
    assert bag(got, ["deviceId"]) == bag(
        users.flag_new_users(events).filter("isN = 1"), ["deviceId"])


def _last(folder, spark, keys, values):
    """Update-mode rows that arrived last per key."""
    table = read_table(spark, folder)
    return (table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
            .select(*keys, "v.*"))


@pytest.mark.parametrize("make,keys,values", [
    (audience.audience_totals, ["anchor_id"], ["online", "total"]),
    (lambda e: users.new_by(e, "deviceType"), ["deviceType"], ["new_users"]),
    (lambda e: users.new_by(e, "releaseChannel"), ["releaseChannel"], ["new_users"]),
    (users.new_user_totals_exploded, ["dims", "deviceType", "releaseChannel"], ["new_users"]),
])
def test_update_mode_totals(spark, events, source, make, keys, values):
    folder = tempfile.mkdtemp()
    q = (make(stream(spark, source)).writeStream.outputMode("update")
         .foreachBatch(batch_table(folder)).option("checkpointLocation", tempfile.mkdtemp())
         .trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    assert bag(_last(folder, spark, keys, values)) == bag(make(events), keys + values)


def test_exploded_totals_equal_grouping_sets(events):
    assert bag(users.new_user_totals_exploded(events)) == bag(users.new_user_totals(events))


def test_gift_totals(spark, events, source):
    dim = gifts.gift_dimension(D.gift_lines(spark, SF), version="version")
    folder = tempfile.mkdtemp()
    q = (gifts.gift_totals(stream(spark, source), dim).writeStream.outputMode("update")
         .foreachBatch(batch_table(folder)).option("checkpointLocation", tempfile.mkdtemp())
         .trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    assert bag(_last(folder, spark, ["anchor_id"], ["gifts", "points"])) == bag(
        gifts.gift_totals(events, dim))


def test_gift_dimension_is_read_per_batch(spark, source):
    loads = []

    def load():
        loads.append(1)
        score = float(len(loads))
        return spark.range(100).select(F.col("id").cast("string").alias("id"),
                                       F.lit("g").alias("name"), F.lit(score).alias("score"))

    folder = tempfile.mkdtemp()
    run_batches(stream(spark, source), M.gift_batches(load, batch_table(folder)))
    got = read_table(spark, folder).groupBy("batch_id").agg(F.collect_set("score").alias("s"))
    assert {r["batch_id"]: r["s"] for r in got.collect()} == {0: [1.0], 1: [2.0], 2: [3.0], 3: [4.0]}


def test_windows_carry_totals(spark, events, source):
    """One row per closed window, equal to the table form: windows of several micro-batches, many closed at once."""
    got = run(M.audience_windowed_stream(stream(spark, source), HOUR, 0))
    newest = audience.live_events(events, S.ANCHOR).agg(F.max("timestamp")).first()[0]
    want = audience.audience_windowed(events, HOUR).filter(F.col("window_end") <= newest)
    assert want.count() > 100 and bag(got) == bag(want, got.columns)


def test_windows_of_arrival_carry_totals(spark, events, source):
    """Totals never start again: the last closed window of a room holds all that arrived before the open ones."""
    folder = tempfile.mkdtemp()
    run_batches(M.audience_windowed_stream(stream(spark, source), 1), batch_table(folder))
    got = read_table(spark, folder)
    assert got.count() == got.select(S.ANCHOR, "window_start").distinct().count() > 0
    last = got.groupBy(S.ANCHOR).agg(F.max_by("total", "window_start").alias("total"), F.max("total").alias("most"))
    assert last.filter("total <> most").count() == 0
    edge = events.withColumn("t", F.col("timestamp").cast("double")).approxQuantile("t", [0.75], 0.0)[0]
    three = audience.audience_totals(events.filter(F.col("timestamp") < edge))
    totals = {r[S.ANCHOR]: r["total"] for r in three.collect()}
    rooms = {r[S.ANCHOR]: r["total"] for r in last.collect()}
    assert all(rooms[a] >= 0.9 * t for a, t in totals.items() if t > 10)


def test_running_audience_replay(spark, events):
    """A batch that is run again gives the same rows and leaves the same totals."""
    folder, state = tempfile.mkdtemp(), tempfile.mkdtemp()
    step = M.running_audience_batches(state, batch_table(folder))
    half = events.agg(F.percentile_approx("timestamp", 0.5)).first()[0]
    parts = [events.filter(F.col("timestamp") <= half), events.filter(F.col("timestamp") > half)]
    for number in (0, 1, 1):
        step(parts[number], number)
    assert bag(read_table(spark, folder).drop("batch_id")) == bag(audience.audience_running(events))


def test_idle_side_holds_the_join_back_and_loses_nothing(spark):
    """A join side without rows keeps windows open; details come out once it moves on."""
    from roompulse.plans.orders import order_window_join
    def frame(rows, columns):
        return spark.createDataFrame(rows, columns).withColumn("update_time", F.timestamp_millis("t")).drop("t")
    detail = frame([(1, 1, 1000), (2, 2, 9_000), (3, 3, 30_000)], "id bigint, order_id bigint, t bigint")
    idle = frame([(9, 500)], "oid bigint, t bigint")
    moved = frame([(9, 500), (1, 2_000), (8, 40_000)], "oid bigint, t bigint")
    d = staged_by_time(detail, 1)
    held = run(order_window_join(stream(spark, d), stream(spark, staged_by_time(idle, 1)), delay_ms=0))
    assert held.count() == 0
    went = run(order_window_join(stream(spark, d), stream(spark, staged_by_time(moved, 1)), delay_ms=0))
    assert sorted(tuple(r) for r in went.select("id", "main_oid").collect()) == [(1, 1), (2, None)]


def test_running_audience_per_row(spark, events, source):
    folder, state = tempfile.mkdtemp(), tempfile.mkdtemp()
    run_batches(stream(spark, source), M.running_audience_batches(state, batch_table(folder)))
    assert bag(read_table(spark, folder).drop("batch_id")) == bag(audience.audience_running(events))


def _valid(spark, source, dwell, **more):
    folder = tempfile.mkdtemp()
    run_batches(M.audience_valid_stream(stream(spark, source), dwell, **more), batch_table(folder))
    return _last(folder, spark, [S.ANCHOR], ["valid_total"])


def test_valid_audience(spark, events, source):
    assert bag(_valid(spark, source, DAY)) == bag(audience.audience_valid(events, DAY))


def test_valid_audience_of_rows_in_any_order(spark, events):
    """Files hold times of all the range: late rows count, and late leaves take counts back."""
    mixed = events.withColumn("_o", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double"))
    source = staged(mixed, "_o", 4)
    assert bag(_valid(spark, source, DAY)) == bag(audience.audience_valid(events, DAY))
    # Kept as long as rows are late: the same; the state of older cells goes.
    span = events.agg(F.max("timestamp") - F.min("timestamp")).first()[0]
    assert bag(_valid(spark, source, DAY, keep_ms=span)) == bag(audience.audience_valid(events, DAY))


def test_valid_audience_of_crowded_sessions(spark):
    """Dense events of few sessions, ties in time, gaps of exactly the dwell time, enters that stay open."""
    import random
    rng = random.Random(9)
    rows = []
    for i in range(400):
        t = 1_000_000 + rng.choice([rng.randrange(0, 3000), rng.randrange(0, 30) * 100])
        rows.append((str(i), rng.choice([S.LIVE_ENTER, S.LIVE_ENTER, S.LIVE_LEAVE]), t, {S.ANCHOR: rng.choice("ab"), S.SESSION: rng.choice("xyz")}))
    rows.append(("z", S.LIVE_LEAVE, 1_010_000, {S.ANCHOR: "c", S.SESSION: "x"}))
    frame = spark.createDataFrame(rows, "id string, eventId string, timestamp bigint, properties map<string,string>")
    for seed in range(2):
        source = staged(frame.withColumn("_o", F.rand(seed)), "_o", 5)
        assert bag(_valid(spark, source, 100)) == bag(audience.audience_valid(frame, 100, 1_000))


def test_hot_products(spark, events, source):
    folder = tempfile.mkdtemp()
    run_batches(M.product_counts_stream(stream(spark, source), 10 * HOUR, HOUR),
                M.ranked_batches(batch_table(folder)))
    got = read_table(spark, folder).drop("batch_id")
    newest = events.filter(F.col("eventId").startswith("product")).agg(F.max("timestamp")).first()[0]
    want = products.hot_products(events, 10 * HOUR, HOUR).filter(F.col("window_end") <= newest)
    assert got.count() > 0
    assert bag(got) == bag(want, got.columns)


def test_routes_to_tables(spark, events, source):
    folder = tempfile.mkdtemp()
    routed = etl.etl_route(stream(spark, source)).select("id", "route")
    run_batches(routed, routed_tables(folder))
    got = read_table(spark, folder).select("id", "route")
    assert bag(got) == bag(etl.etl_route(events).select("id", "route"))


def test_order_window_join(spark):
    detail = D.order_detail(spark, SF).drop("ingest_batch")
    main = D.order_main(spark, SF)
    d, m = staged_by_time(detail), staged_by_time(main)
    got = run(orders.order_window_join(stream(spark, d), stream(spark, m), 90 * DAY, 0)
              .withColumn("start", F.unix_millis("window.start")).drop("window"))
    want = orders.order_window_join(detail, main, 90 * DAY).withColumn(
        "start", F.unix_millis("window.start")).drop("window")
    # Windows that end before both inputs have moved past them are complete.
    limit = min(x.agg(F.max(F.unix_millis("update_time"))).first()[0] for x in (detail, main))
    closed = f"start + {90 * DAY} <= {limit}"
    assert got.count() > 0
    assert bag(got.filter(closed)) == bag(want.filter(closed))


def staged_by_time(df, files=4, time="update_time"):
    folder, _ = staged(df.withColumn("_o", F.unix_millis(time).cast("double")), "_o", files)
    return folder, df.schema


KEYS = ["id", "sku", "order_id", "money", "update_time"]


@pytest.fixture(scope="module")
def late_orders(spark):
    """Details in three files, ranges of order ids, so that times are mixed and many rows come late; orders of even ids."""
    detail = D.order_detail(spark, SF).withColumn("ingest_batch", F.expr("order_id div 500"))
    folder, schema = staged(detail, "ingest_batch", 3)
    assert detail.select("ingest_batch").distinct().count() == 3
    return detail, D.order_main(spark, SF).filter("oid % 2 = 0"), (folder, schema)


def _enriched(spark, source, main, salts, work, out, per_trigger=1):
    details = O.order_details_stream(stream(spark, source, per_trigger), stream(spark, main), 90 * DAY, 2_000, salts)
    run_batches(details, O.lookup_batches(lambda: D.order_main(spark, SF), batch_table(out)), checkpoint=work)
    return read_table(spark, out).drop("batch_id")


@pytest.mark.parametrize("salts", [1, 5])
def test_order_details_in_one_query(spark, late_orders, salts):
    """One table, each detail once, equal to the table form; windows that are still open wait."""
    detail, main, source = late_orders
    work, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    got = _enriched(spark, source, staged_by_time(main, 1), salts, work, out)
    want = orders.order_detail_enriched(detail, main, D.order_main(spark, SF), 90 * DAY, 2_000)
    newest = detail.agg(F.max(F.unix_millis("update_time"))).first()[0]
    closed = f"late or update_time - pmod(update_time, {90 * DAY}) + {90 * DAY} <= {newest} - 2000"
    columns = [*KEYS, "late", "found_by", "main_oid", "main_total_money", "main_update_time", "main_create_time"]
    assert bag(got, columns) == bag(want.filter(closed), columns)
    assert got.filter("late").count() > 100 and got.filter("found_by = 'window'").count() > 0
    # Started again without new rows: nothing comes out twice.
    again = _enriched(spark, source, staged_by_time(main, 1), salts, work, out)
    assert again.count() == got.count()


def test_order_details_of_a_hot_order(spark):
    """A third of all details belong to one order and window; they are spread over the salts and none is lost."""
    rows = [(i, 7 if i % 3 == 0 else 1_000 + i, 1_000 + i % 4_000) for i in range(900)] + [(10_000, 1, 90_000)]
    frame = lambda rows, names: spark.createDataFrame(rows, names).withColumn(
        "update_time", F.timestamp_millis("t")).drop("t")
    detail, main = frame(rows, "id bigint, order_id bigint, t bigint"), frame(
        [(7, 1_500), (7, 2_500), (8, 60_000)], "oid bigint, t bigint")
    joined = O.order_details_stream(stream(spark, staged_by_time(detail, 1)), stream(spark, staged_by_time(main, 1)), 5_000, 0)
    got = run(joined)
    hot = got.filter("order_id = 7")
    assert hot.count() == 600 and hot.filter("main_oid = 7").count() == 600
    assert sorted(r["id"] for r in got.filter("main_oid is null").collect()) == [i for i in range(900) if i % 3]


def test_rows_without_time_or_order(spark):
    detail = spark.createDataFrame([(1, None, 1_000), (2, 5, None), (3, 5, 1_000), (4, 6, 50_000)], "id bigint, order_id bigint, t bigint")
    main = spark.createDataFrame([(5, 1_000), (None, 1_000), (6, None)], "oid bigint, t bigint")
    timed = lambda df: df.withColumn("update_time", F.timestamp_millis("t")).drop("t")
    folders = []
    for df in (detail, main):
        folders.append((tempfile.mkdtemp() + "/in", timed(df).schema))
        timed(df).coalesce(1).write.parquet(folders[-1][0])
    got = run(O.order_details_stream(*[stream(spark, f) for f in folders], 5_000, 0))
    assert sorted(tuple(r) for r in got.select("id", "main_oid", "late").collect()) == [(1, None, False), (2, None, True), (3, 5, False)]


def test_lookup_leaves_met_rows_alone(spark):
    """The scan of the order table gets the range of missed ids; rows that met an order take no part in the join."""
    folder = tempfile.mkdtemp() + "/orders"
    spark.range(10_000).select(F.col("id").alias("oid"), F.timestamp_millis("id").alias("update_time")).write.parquet(folder)
    rows = spark.createDataFrame([(1, 40, None, None), (2, 60, None, None), (3, 9_999, 9_999, 5), (4, None, None, None)],
                                 "id bigint, order_id bigint, main_oid bigint, main_update_time bigint")
    filled = orders.fill_missed(rows, spark.read.parquet(folder))
    assert sorted(tuple(r) for r in filled.select("id", "main_oid", "found_by").collect()) == [
        (1, 40, "lookup"), (2, 60, "lookup"), (3, 9_999, "window"), (4, None, None)]
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(oid,40), LessThanOrEqual(oid,60)" in plan
    all_met = orders.fill_missed(rows.filter("id = 3"), spark.read.parquet(folder))
    assert all_met.count() == 1


def test_groupon_lines(spark):
    def lines(make, time_field=0):
        df = make(spark, SF).withColumn("_o", F.split("value", ",")[time_field].cast("double"))
        folder, schema = staged(df, "_o", 3)
        return folder, df.drop("_o").schema
    makes = (D.groupon_detail_lines, D.groupon_main_lines, D.order_lines)
    got = run(groupon.groupon_enriched(*[stream(spark, lines(m)) for m in makes], 30 * DAY, 0)
              .withColumn("start", F.unix_millis("window.start")).drop("window"))
    want = groupon.groupon_enriched(*[m(spark, SF) for m in makes], 30 * DAY).withColumn(
        "start", F.unix_millis("window.start")).drop("window")
    limit = min(m(spark, SF).agg(F.max(F.split("value", ",")[0].cast("bigint"))).first()[0]
                for m in makes)
    closed = f"start + {30 * DAY} <= {limit}"
    assert got.count() > 0
    assert bag(got.filter(closed)) == bag(want.filter(closed))
