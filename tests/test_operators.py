"""Operators on small fixtures: hand-checked cases, brute force, skewed keys, odd partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse import tables
from roompulse.functions.bloom import BloomShape, bit_columns, bits_of, bucket_column
from roompulse.operators.dwell import valid_visits
from roompulse.operators.firstseen import flag_first_seen, flag_first_seen_bloom
from roompulse.operators.late import flag_late
from roompulse.operators.ranking import top_k
from roompulse.operators.running import running_totals
from roompulse.operators.windows import sliding_counts
from roompulse.plans import audience, gifts, groupon, orders, products, users


def events(spark, rows):
    """Rows of (id, eventId, timestamp, properties, deviceId)."""
    return spark.createDataFrame(
        rows, "id string, eventId string, timestamp bigint, properties map<string,string>, "
              "deviceId string")


def live(spark, *rows):
    return events(spark, [(f"{i:04d}", S.LIVE_ENTER if kind == "+" else S.LIVE_LEAVE, ts,
                           {S.ANCHOR: room, S.SESSION: who}, who)
                          for i, (kind, ts, room, who) in enumerate(rows)])


def result(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def skewed(n=600, seed=1):
    """Rows of which a third belong to one key."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(5_000), f"{i:05d}",
             rng.choice([1, -1])) for i in range(n)]


# --- running totals ----------------------------------------------------------------------------

@pytest.mark.parametrize("widths", [[100], [1000, 10], [10_000], [1]])
@pytest.mark.parametrize("how,inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_running_totals_against_brute_force(spark, widths, how, inclusive):
    rows = skewed(300)
    df = spark.createDataFrame(rows, "k string, ts bigint, id string, v int").repartition(7)
    got = running_totals(df, ["k"], ["ts", "id"], {"r": F.col("v")},
                         [F.floor(F.col("ts") / w) for w in widths], how, inclusive)
    want = []
    for k, ts, i, v in rows:
        before = [x[3] for x in rows if x[0] == k and (x[1], x[2]) < (ts, i)] + ([v] if inclusive else [])
        want.append((i, sum(before) if how == "sum" else max(before, default=None)))
    assert dict(result(got, "id", "r")) == dict(want)


def test_running_totals_spread_a_hot_key(spark):
    """The rows of one key are ranked by key and cell together, not by key alone."""
    df = spark.createDataFrame(skewed(), "k string, ts bigint, id string, v int")
    got = running_totals(df, ["k"], ["ts", "id"], {"r": F.col("v")}, [F.floor(F.col("ts") / 100)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    rows_window = [line for line in plan.splitlines() if "Window [sum" in line and "id#" in line]
    assert rows_window and all("_cell0" in line for line in rows_window)


def test_audience_leave_before_enter_and_reenter(spark):
    df = live(spark, ("-", 10, "a", "u1"), ("+", 20, "a", "u1"), ("+", 30, "a", "u2"),
              ("+", 70_000, "a", "u1"), ("+", 5, "b", "u9"))
    assert result(audience.audience_running(df), S.ANCHOR, "timestamp", "online", "total") == [
        ("a", 10, -1, 0), ("a", 20, 0, 1), ("a", 30, 1, 2), ("a", 70_000, 2, 3), ("b", 5, 1, 1)]
    assert result(audience.audience_totals(df), S.ANCHOR, "online", "total") == [("a", 2, 3), ("b", 1, 1)]
    assert result(audience.audience_windowed(df, 60_000, windows_per_cell=1),
                  S.ANCHOR, "window_start", "online", "total") == [
        ("a", 0, 1, 2), ("a", 60_000, 2, 3), ("b", 0, 1, 1)]


def test_answers_do_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    df = live(spark, *[(rng.choice("+-"), rng.randrange(400_000), f"r{rng.randrange(3)}",
                        f"u{rng.randrange(20)}") for _ in range(400)])
    plans = (lambda d: audience.audience_running(d), lambda d: audience.audience_valid(d, cell_ms=60_000),
             lambda d: audience.audience_windowed(d, 10_000))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for make in plans:
            seen = set()
            for parts, shuffles in ((1, 1), (5, 3), (13, 17)):
                spark.conf.set("spark.sql.shuffle.partitions", shuffles)
                out = make(df.repartition(parts, "id"))
                seen.add(tuple(result(out, *sorted(out.columns))))
            assert len(seen) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


# --- dwell -------------------------------------------------------------------------------------

@pytest.mark.parametrize("cell_ms", [None, 1, 1_000, 60_000, 10**9])
def test_dwell_limits(spark, cell_ms):
    df = live(spark, ("+", 0, "a", "u1"), ("-", 60_000, "a", "u1"),        # exactly: no
              ("+", 0, "a", "u2"), ("-", 60_001, "a", "u2"),               # 1 ms more: yes
              ("+", 0, "a", "u3"), ("+", 10, "a", "u3"),                   # replaced, then open
              ("-", 0, "a", "u4"), ("+", 0, "b", "u5"), ("-", 1, "b", "u5"), ("-", 0, "c", "u6"))
    cell_ms = audience.HOUR if cell_ms is None else cell_ms
    assert result(audience.audience_valid(df, cell_ms=cell_ms), S.ANCHOR, "valid_total") == [("a", 1), ("b", 0)]
    assert result(audience.audience_valid(df, cell_ms=cell_ms, as_of=60_010), S.ANCHOR, "valid_total") \
        == [("a", 1), ("b", 0)]
    assert result(audience.audience_valid(df, cell_ms=cell_ms, as_of=60_011), S.ANCHOR, "valid_total") \
        == [("a", 2), ("b", 0)]


@pytest.mark.parametrize("cell_ms", [0, 50])
def test_dwell_against_brute_force(spark, cell_ms):
    rng = random.Random(3)
    rows = [(f"s{0 if i % 3 == 0 else rng.randrange(9)}", rng.randrange(3_000), f"{i:04d}",
             rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, ts bigint, id string, e boolean")
    got = valid_visits(df, ["s"], "e", "ts", ["ts", "id"], dwell_ms=15, cell_ms=cell_ms)
    enters = valid = 0
    for s in {r[0] for r in rows}:
        line = sorted((r[1:] for r in rows if r[0] == s), key=lambda r: r[:2])
        for here, after in zip(line, [*line[1:], None]):
            enters += here[2]
            valid += here[2] and (after is None or after[0] - here[0] > 15)
    total = got.agg(F.sum("enters"), F.sum("valid")).first()
    assert tuple(total) == (enters, valid)


# --- first seen --------------------------------------------------------------------------------

def test_first_seen_ties_and_null_keys(spark):
    df = spark.createDataFrame([("d1", 5, "b"), ("d1", 5, "a"), ("d1", 1, "z"), ("d2", 5, "c"),
                                (None, 1, "n")], "deviceId string, timestamp bigint, id string")
    got = flag_first_seen(df, "deviceId", ["timestamp", "id"], "id")
    assert result(got, "id", "isN") == [("a", 0), ("b", 0), ("c", 1), ("n", 0), ("z", 1)]


def test_bloom_equals_filling_a_filter_in_order(spark):
    shape = BloomShape(expected=60, false_positives=0.3, buckets=4)
    rng = random.Random(9)
    rows = [(f"t{0 if i % 3 else rng.randrange(4)}", f"d{rng.randrange(250)}", i, f"{i:05d}")
            for i in range(900)]
    df = spark.createDataFrame(rows, "g string, d string, ts bigint, id string")
    got = flag_first_seen_bloom(df, "g", "d", ["ts", "id"], "id", shape)
    buckets = dict(result(df.select("d", bucket_column(F.col("d"), shape).alias("b")).distinct(), "d", "b"))
    filters, want = {}, {}
    for g, d, ts, i in rows:
        bits = filters.setdefault((g, buckets[d]), set())
        own = bits_of(d, shape)
        want[i] = int(not bits.issuperset(own))
        bits.update(own)
    assert dict(result(got, "id", "isN")) == want
    exact = flag_first_seen(df.withColumn("gd", F.concat("g", "d")), "gd", ["ts", "id"], "id")
    flags, truth = dict(result(got, "id", "isN")), dict(result(exact, "id", "isN"))
    assert all(flags[i] <= truth[i] for i in truth) and sum(flags.values()) < sum(truth.values())


def test_bloom_shape_and_bits():
    shape = BloomShape(100_000)
    assert shape.hashes == 5 and 729_844 <= shape.bits < 729_844 + 32
    assert all(0 <= b < shape.bucket_bits for b in bits_of("device", shape))


def test_bloom_misses_stay_within_the_wanted_rate(spark):
    shape = BloomShape(expected=5_000, buckets=8)
    df = spark.range(5_000).select(F.lit("t").alias("g"), F.concat(F.lit("d"), "id").alias("d"),
                                   F.col("id").alias("ts"), F.col("id").cast("string").alias("id"))
    flagged = flag_first_seen_bloom(df, "g", "d", ["ts", "id"], "id", shape).agg(F.sum("isN")).first()[0]
    assert 5_000 * 0.97 < flagged <= 5_000


def test_bloom_is_sized_for_its_keys(spark):
    """Two million devices of one type beside a small one."""
    df = spark.range(2_000_000).select(
        F.when(F.col("id") < 50, "small").otherwise("large").alias("g"), F.concat(F.lit("d"), "id").alias("d"),
        F.col("id").alias("ts"), F.col("id").cast("string").alias("id"))
    got = dict(result(flag_first_seen_bloom(df, "g", "d", ["ts", "id"], "id").groupBy("g").agg(
        F.sum("isN").alias("n")), "g", "n"))
    assert got["small"] >= 45 and 1_999_950 * 0.97 < got["large"] <= 1_999_950


def test_first_launch_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([("d1", 5, None), ("d1", 7, "b"), ("d2", 1, "x"), ("d2", 1, "x"), ("d3", 1, "x")],
                               "deviceId string, timestamp bigint, id string")
    for got in (flag_first_seen(df, "deviceId", ["timestamp", "id"], "id"),
                flag_first_seen_bloom(df.withColumn("g", F.lit("g")), "g", "deviceId", ["timestamp", "id"], "id")):
        flags = {}
        for r in got.collect():
            flags.setdefault(r["deviceId"], []).append(r["isN"])
        assert {k: sorted(v) for k, v in flags.items()} == {"d1": [0, 1], "d2": [0, 1], "d3": [1]}


def test_null_times_stay_in_joins_and_out_of_windows(spark):
    detail = spark.createDataFrame([(1, 7, None), (2, 7, "1970-01-01 00:00:01"), (3, 8, None)],
                                   "id bigint, order_id bigint, t string").withColumn(
        "update_time", F.to_timestamp("t")).drop("t").withColumn("ingest_batch", F.lit(0))
    main = spark.createDataFrame([(7, "1970-01-01 00:00:02")], "oid bigint, t string").withColumn(
        "update_time", F.to_timestamp("t")).drop("t")
    assert result(orders.order_window_join(detail, main), "id", "main_oid") == [(1, None), (2, 7), (3, None)]
    got = orders.order_detail_enriched(detail, main, main)
    assert result(got, "id", "main_oid", "found_by") == [(1, 7, "lookup"), (2, 7, "window"), (3, None, None)]
    df = live(spark, ("+", None, "a", "u1"), ("+", 5, "a", "u2"))
    assert result(audience.audience_windowed(df), S.ANCHOR, "window_start", "total") == [("a", 0, 1)]


def test_open_enters_count_once_they_have_lasted(spark):
    df = live(spark, ("+", 0, "a", "u1"), ("+", 60_000, "a", "u2"), ("+", 60_001, "a", "u3"))
    assert result(audience.audience_valid(df), S.ANCHOR, "valid_total") == [("a", 1)]


def test_gift_lines_without_version(spark, tmp_path):
    lines = spark.createDataFrame([(v,) for v in ("7,rose,1.0", "8,car,3.0", "7,rose,2.0")], "value string").coalesce(1)
    assert result(gifts.gift_dimension(lines), "id", "name", "score") == [("7", "rose", 2.0), ("8", "car", 3.0)]
    df = events(spark, [("1", S.LIVE_REWARD, 1, {S.ANCHOR: "a", S.GIFT: "7"}, "d")])
    assert result(gifts.gift_totals(df, gifts.gift_dimension(lines)), S.ANCHOR, "gifts", "points") == [("a", 1, 2.0)]


def test_python_bits_equal_column_bits(spark):
    shape = BloomShape(expected=500, buckets=3)
    df = spark.createDataFrame([("a",), ("device-ü",), ("",)], "k string")
    for r in df.select("k", bit_columns(F.col("k"), shape).alias("b"),
                       bucket_column(F.col("k"), shape).alias("n")).collect():
        assert sorted(r["b"]) == [r["n"] * shape.bucket_bits + b for b in bits_of(r["k"], shape)]


def test_new_user_totals(spark):
    df = spark.createDataFrame(
        [("appLaunch", "x", "c1", 1), ("appLaunch", "x", "c2", 0), ("appLaunch", "y", "c1", 1),
         ("appLaunch", None, "c1", 1), ("other", "x", "c1", 1)],
        "eventId string, deviceType string, releaseChannel string, isNew int")
    assert result(users.new_by(df, "releaseChannel"), "releaseChannel", "new_users") == [("c1", 3), ("c2", 0)]
    got = {tuple(r) for r in users.new_user_totals(df).collect()}
    assert got == {("deviceType", "x", None, 1), ("deviceType", "y", None, 1), ("deviceType", None, None, 1),
                   ("releaseChannel", None, "c1", 3), ("releaseChannel", None, "c2", 0),
                   ("both", "x", "c1", 1), ("both", "x", "c2", 0), ("both", "y", "c1", 1),
                   ("both", None, "c1", 1)}


# --- windows and ranking -----------------------------------------------------------------------

@pytest.mark.parametrize("size,slide", [(100, 10), (100, 100), (100, 30)])
def test_sliding_counts_against_brute_force(spark, size, slide):
    rows = [(k, 1_000 + ts) for k, ts, _, _ in skewed(200)]
    got = sliding_counts(spark.createDataFrame(rows, "k string, ts bigint"), ["k"], "ts", size, slide)
    want = {}
    for k, ts in rows:
        start = ts - ts % slide
        while start > ts - size:
            want[k, start, start + size] = want.get((k, start, start + size), 0) + 1
            start -= slide
    assert {tuple(r[:3]): r[3] for r in got.select("k", "window_start", "window_end", "count").collect()} == want


def test_top_k_ties_and_short_groups(spark):
    df = spark.createDataFrame([("g", "d", 1), ("g", "a", 2), ("g", "c", 2), ("g", "b", 2), ("h", "a", 9)],
                               "g string, p string, n int")
    assert result(top_k(df, ["g"], [F.desc("n"), "p"]), "g", "sort", "p") == [
        ("g", 1, "a"), ("g", 2, "b"), ("g", 3, "c"), ("h", 1, "a")]


def test_hot_products_with_missing_property(spark):
    df = events(spark, [("1", "productView", 30_000, {S.CATEGORY: "c", S.PRODUCT: "p"}, "d"),
                        ("2", "productView", 30_000, {S.CATEGORY: "c"}, "d"),
                        ("3", "liveEnter", 30_000, {S.CATEGORY: "c", S.PRODUCT: "p"}, "d")])
    got = products.hot_products(df)
    assert got.count() == 10 and {r["count"] for r in got.collect()} == {1}


# --- joins -------------------------------------------------------------------------------------

def test_group_purchase_sample(spark):
    def lines(*rows):
        return spark.createDataFrame([(r,) for r in rows], "value string")
    detail = lines("1001,u1646,p201,o1002", "5001,u1647,p202,o1003")
    main = lines("1000,p201,1,phone", "5001,p202,1,phone")
    order = lines("1002,o1002,101,2000.0", "5002,o1003,101,3000.0")
    got = groupon.groupon_enriched(detail, main, order)
    assert result(got, "user", "groupon", "order_id", "groupon_status", "category", "order_status", "amount") == [
        ("u1646", "p201", "o1002", "1", "phone", "101", 2000.0),
        ("u1647", "p202", "o1003", "1", "phone", "101", 3000.0)]


def test_group_purchase_misses_doubles_and_window_edges(spark):
    def lines(*rows):
        return spark.createDataFrame([(r,) for r in rows], "value string")
    detail = lines("4999,u1,p1,o1", "5000,u2,p1,o2", "100,u3,p9,o3", "bad line")
    main = lines("0,p1,1,a", "10,p1,2,a", "5000,p7,1,b")
    order = lines("5000,o1,101,1.0", "5001,o2,102,2.0", "1,o3,103,x")
    got = groupon.groupon_enriched(detail, main, order).collect()
    assert {(r["user"], r["groupon_status"], r["order_status"]) for r in got} == {
        ("u1", "1", None), ("u1", "2", None), ("u2", None, "102"), ("u3", None, None)}
    assert len(got) == 4


def order_frames(spark):
    detail = spark.sql("""select id, order_id, sku, timestamp_millis(t) update_time, b ingest_batch from values
        (1L, 1L, 7L, 1000L, 0L), (2L, 1L, 8L, 20000L, 0L), (3L, 2L, 7L, 1500L, 1L), (4L, 9L, 7L, 21000L, 1L),
        (5L, 3L, 7L, 17000L, 1L) as x(id, order_id, sku, t, b)""")
    main = spark.sql("""select oid, total_money, timestamp_millis(t) update_time from values
        (1L, 10.0D, 2000L), (1L, 11.0D, 3000L), (2L, 20.0D, 1000L), (3L, 30.0D, 18000L) as x(oid, total_money, t)""")
    return detail, main


def test_late_details_are_looked_up(spark):
    detail, main = order_frames(spark)
    lookup = main.groupBy("oid").agg(F.max("total_money").alias("total_money"),
                                     F.max("update_time").alias("update_time"))
    got = orders.order_detail_enriched(detail, main, lookup)
    # Newest of batch 0 is 20000, so windows that end at 18000 or earlier are closed for batch 1.
    rows = [tuple(r) for r in got.select("id", "late", "main_total_money", "found_by").collect()]
    assert sorted(rows, key=repr) == [
        (1, False, 10.0, "window"), (1, False, 11.0, "window"), (2, False, 11.0, "lookup"),
        (3, True, 20.0, "lookup"), (4, False, None, None), (5, False, 30.0, "window")]


def test_watermark_passes_through_batch_cells(spark):
    rows = [(b, b * 7 % 50) for b in range(40)]
    df = spark.createDataFrame(rows, "b bigint, ts bigint")
    from roompulse.operators.late import watermarks_by_batch
    got = watermarks_by_batch(df, "b", "ts", 2, batches_per_cell=3)
    want = [(b, max((t for c, t in rows if c < b), default=None)) for b, _ in rows]
    assert result(got.filter("b > 0"), "b", "watermark") == [(b, m - 3) for b, m in want if m is not None]
    assert got.filter("b = 0").first()["watermark"] is None


def test_flag_late_by_watermark_rule(spark):
    df = spark.createDataFrame([(0, 10_000), (1, 4_999), (1, 5_000), (1, 10_001)], "b bigint, ts bigint")
    got = flag_late(df, "b", "ts", 5_000, 2_000)
    assert result(got, "b", "ts", "late") == [
        (0, 10_000, False), (1, 4_999, True), (1, 5_000, False), (1, 10_001, False)]


def test_gifts_and_their_dimension(spark):
    rows = [(f"{i}", S.LIVE_REWARD, i, {S.ANCHOR: "a" if i % 3 else "b", S.GIFT: f"{i % 4}"}, "d")
            for i in range(30)] + [("x", S.LIVE_REWARD, 1, {S.ANCHOR: "a"}, "d")]
    df = events(spark, rows)
    lines = spark.createDataFrame([(v,) for v in ("0,rose,1,1", "0,rose2,5,2", "1,car,2,1", "oops")], "value string")
    dim = gifts.gift_dimension(lines, version="v")
    assert result(dim, "id", "name", "score") == [("0", "rose2", 5.0), ("1", "car", 2.0)]
    small = result(gifts.gift_totals(df, dim), S.ANCHOR, "gifts", "points")
    facts = gifts.gift_facts(df, dim)
    assert facts.count() == 30 and facts.filter("gift_name is null").count() == 14
    want = {}
    for r in rows[:30]:
        n, p = want.get(r[3][S.ANCHOR], (0, 0.0))
        want[r[3][S.ANCHOR]] = (n + 1, p + {"0": 5.0, "1": 2.0}.get(r[3][S.GIFT], 0.0))
    assert {a: (n, p) for a, n, p in small} == want


def test_hot_order_is_split_in_the_join(spark):
    """A third of all details belong to one order: adaptive execution splits its partition."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.shuffle.partitions": "16"}
    held = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        detail = spark.range(0, 120_000, 1, 8).select(
            "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("order_id"),
            F.repeat(F.col("id").cast("string"), 5).alias("note"),
            F.timestamp_millis(F.lit(1_000)).alias("update_time"))
        main = spark.range(0, 120_000, 1, 8).select(
            F.col("id").alias("oid"), F.timestamp_millis(F.lit(2_000)).alias("update_time"))
        joined = orders.order_window_join(detail, main)
        assert joined.filter("main_oid = 7").count() == 40_001
        joined = orders.order_window_join(detail, main)
        assert len(joined.select("id", "note", "main_oid").collect()) == 120_000
        joined = joined.select("id", "note", "main_oid")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_without_time_come_first(spark):
    df = live(spark, ("+", None, "a", "u1"), ("+", 5, "a", "u2"))
    assert [tuple(r) for r in audience.audience_running(df).orderBy("id").select("id", "total").collect()] == [
        ("0000", 1), ("0001", 2)]


def test_cells_do_not_change_the_totals(spark):
    rng = random.Random(8)
    rows = [("+", 7_200_000 + rng.randrange(3_000), "hot", f"u{i}") for i in range(90)]
    rows += [("-", rng.randrange(9_000_000), f"r{i % 5}", f"u{i}") for i in range(60)]
    df = live(spark, *rows)
    want = {}
    for r in sorted(audience.live_events(df, S.ANCHOR).collect(), key=lambda r: (r["timestamp"], r["id"])):
        online, total = want.get(r[S.ANCHOR], (0, 0))
        enter = r["eventId"] == S.LIVE_ENTER
        want[r[S.ANCHOR]] = (online + (1 if enter else -1), total + enter)
        want[r["id"]] = want[r[S.ANCHOR]]
    for cells in ((), (3_600_000,), (3_600_000, 60_000, 1_000, 1)):
        got = audience.audience_running(df, *cells).collect()
        assert {r["id"]: (r["online"], r["total"]) for r in got} == {k: v for k, v in want.items() if k in {
            r["id"] for r in got}} and len(got) == 150
    assert audience.audience_running(df.filter("false")).count() == 0


def test_rows_are_shuffled_once(spark, sf_dir):
    """Besides the cell tables, the plan moves the rows of a room in one exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = audience.audience_running(tables.behavior(spark, sf_dir))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "_cell1" in x]
        assert len(moved) <= 4      # the rows, the finest cells for themselves and their hours, the totals before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
