"""Named queries over the benchmark tables; each takes a session and a table folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse import tables as D
from roompulse.functions.bloom import BloomShape
from roompulse.functions.columns import event_date, event_hour
from roompulse.functions.protobuf import decode_events, encode_events
from roompulse.operators.filters import lacking, only_event, only_events, only_prefix, with_props
from roompulse.operators.joins import latest_by
from roompulse.operators.parsing import parse_changes, parse_lines
from roompulse.operators.windows import window_bounds
from roompulse.plans import audience, etl, gifts, groupon, orders, products, users
from roompulse.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOUR = 3_600_000
DAY = 24 * HOUR
# Small enough to take some new devices for known ones.
SMALL_BLOOM = BloomShape(expected=6, false_positives=0.3, buckets=2)


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return run


# --- parsing -----------------------------------------------------------------------------------

@query
def parse_events_clean(spark, sf_dir):
    clean = etl.clean_events(D.raw_behavior(spark, sf_dir)).clean
    return with_props(clean, S.ANCHOR, S.PRODUCT).select(
        "id", "deviceId", "deviceType", "eventId", "osName", "releaseChannel", "province",
        "timestamp", S.ANCHOR, S.PRODUCT, "isNew")


@query
def parse_events_quarantine(spark, sf_dir):
    bad = etl.clean_events(D.raw_behavior(spark, sf_dir)).bad
    return bad.select(F.col("record_id").alias("id"), "raw", "reason")


@query
def cdc_order_main(spark, sf_dir):
    return parse_changes(D.raw_order_main(spark, sf_dir), S.ORDER_MAIN).clean.select(
        "oid", "status", "total_money", "province", "type",
        F.unix_millis("update_time").alias("update_ms"))


@query
def cdc_order_detail(spark, sf_dir):
    return parse_changes(D.raw_order_detail(spark, sf_dir), S.ORDER_DETAIL).clean.select(
        "id", "order_id", "sku", "money", "amount", "type",
        F.unix_millis("update_time").alias("update_ms"))


@query
def delimited_lines(spark, sf_dir):
    return parse_lines(D.order_lines(spark, sf_dir, damaged=True), S.ORDER_LINE).clean


@query
def lines_quarantine(spark, sf_dir):
    return parse_lines(D.order_lines(spark, sf_dir, damaged=True), S.ORDER_LINE).bad


@query
def cdc_quarantine(spark, sf_dir):
    return (parse_changes(D.raw_order_main(spark, sf_dir), S.ORDER_MAIN).bad
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query
def events_lacking_property(spark, sf_dir):
    return lacking(etl.clean_events(D.raw_behavior(spark, sf_dir)).clean, S.ANCHOR).select("id", "deviceId")


@query
def event_date_hour(spark, sf_dir):
    return D.behavior(spark, sf_dir).select(
        "id", event_date().alias("date"), event_hour().alias("hour"))


# --- filters and routing -----------------------------------------------------------------------

@query
def filter_equals(spark, sf_dir):
    return only_event(D.behavior(spark, sf_dir), S.APP_LAUNCH).select("id", "eventId", "deviceId")


@query
def filter_in(spark, sf_dir):
    return only_events(D.behavior(spark, sf_dir), S.LIVE_ENTER, S.LIVE_LEAVE).select(
        "id", "eventId", "deviceId")


@query
def filter_prefix(spark, sf_dir):
    return only_prefix(D.behavior(spark, sf_dir), S.PRODUCT_PREFIX).select(
        "id", "eventId", "deviceId")


@query
def etl_route(spark, sf_dir):
    return etl.etl_route(D.behavior(spark, sf_dir)).select("id", "eventId", "route")


@query
def proto_roundtrip(spark, sf_dir):
    sent = encode_events(etl.etl_route(D.behavior(spark, sf_dir)), keep=["route"])
    got = decode_events(sent, keep=["route"])
    return with_props(got, S.ANCHOR, S.GIFT).select(
        "id", "deviceId", "eventId", "timestamp", "releaseChannel", S.ANCHOR, S.GIFT, "route")


# --- gifts -------------------------------------------------------------------------------------

def _gift_dimension(spark, sf_dir):
    return gifts.gift_dimension(D.gift_lines(spark, sf_dir), version="version")


@query
def gift_dim_latest(spark, sf_dir):
    return _gift_dimension(spark, sf_dir)


@query
def gift_join(spark, sf_dir):
    return gifts.gift_facts(D.behavior(spark, sf_dir), _gift_dimension(spark, sf_dir))


@query
def gift_totals(spark, sf_dir):
    return gifts.gift_totals(D.behavior(spark, sf_dir), _gift_dimension(spark, sf_dir))


@query
def gift_join_as_of(spark, sf_dir):
    return gifts.gift_facts_as_of(D.behavior(spark, sf_dir), D.gift_versions(spark, sf_dir))


@query
def gift_totals_as_of(spark, sf_dir):
    return gifts.gift_totals_as_of(D.behavior(spark, sf_dir), D.gift_versions(spark, sf_dir))


# --- audience ----------------------------------------------------------------------------------

@query
def audience_running(spark, sf_dir):
    return audience.audience_running(D.behavior(spark, sf_dir))


@query
def audience_totals(spark, sf_dir):
    return audience.audience_totals(D.behavior(spark, sf_dir))


@query
def audience_window_delta(spark, sf_dir):
    return audience.audience_window_delta(D.behavior(spark, sf_dir), HOUR)


@query
def audience_windowed(spark, sf_dir):
    return audience.audience_windowed(D.behavior(spark, sf_dir), HOUR)


@query
def audience_valid(spark, sf_dir):
    return audience.audience_valid(D.behavior(spark, sf_dir), dwell_ms=DAY)


# --- new users ---------------------------------------------------------------------------------

@query
def new_user_flag(spark, sf_dir):
    return users.user_event_rows(users.flag_new_users(D.behavior(spark, sf_dir)))


@query
def new_user_flag_bloom(spark, sf_dir):
    return users.user_event_rows(users.flag_new_users_approx(D.behavior(spark, sf_dir)))


@query
def new_user_flag_bloom_small(spark, sf_dir):
    return users.user_event_rows(users.flag_new_users_approx(D.behavior(spark, sf_dir), SMALL_BLOOM))


def _flagged(spark, sf_dir):
    return users.flag_new_users(D.behavior(spark, sf_dir)).withColumn("isNew", F.col("isN"))


@query
def new_by_device_type(spark, sf_dir):
    return users.new_by(_flagged(spark, sf_dir), "deviceType")


@query
def new_by_channel(spark, sf_dir):
    return users.new_by(_flagged(spark, sf_dir), "releaseChannel")


@query
def new_by_both(spark, sf_dir):
    return users.new_by(_flagged(spark, sf_dir), "deviceType", "releaseChannel")


@query
def new_user_totals(spark, sf_dir):
    return users.new_user_totals(_flagged(spark, sf_dir))


# --- products ----------------------------------------------------------------------------------

@query
def sliding_counts(spark, sf_dir):
    return products.product_window_counts(D.behavior(spark, sf_dir), 10 * HOUR, HOUR)


@query
def hot_products(spark, sf_dir):
    return products.hot_products(D.behavior(spark, sf_dir), 10 * HOUR, HOUR)


# --- orders ------------------------------------------------------------------------------------

def _order_columns(rows):
    return rows.select("id", "order_id", "sku", F.col("update_time").alias("detail_ms"), "late",
                       "main_oid", "main_total_money", "main_status", "found_by")


@query
def order_window_left_join(spark, sf_dir):
    joined = orders.order_window_join(D.order_detail(spark, sf_dir), D.order_main(spark, sf_dir),
                                      90 * DAY)
    return joined.select("id", "order_id", "sku", "main_oid", "main_total_money", "main_status",
                         *window_bounds())


@query
def order_late_split(spark, sf_dir):
    return orders.order_late_split(D.order_detail(spark, sf_dir), 30 * DAY).select(
        "id", "order_id", "sku", F.col("update_time").alias("detail_ms"), "ingest_batch", "late")


@query
def order_detail_enriched(spark, sf_dir):
    main = D.order_main(spark, sf_dir)
    return _order_columns(orders.order_detail_enriched(
        D.order_detail(spark, sf_dir), main, latest_by(main, "oid", "create_time"), 90 * DAY))


# --- group purchases ---------------------------------------------------------------------------

@query
def groupon_join_main(spark, sf_dir):
    joined = groupon.groupon_join_main(D.groupon_detail_lines(spark, sf_dir),
                                       D.groupon_main_lines(spark, sf_dir), 30 * DAY)
    return joined.select("user", "groupon", "order_id", "main_status", "main_category",
                         *window_bounds())


@query
def groupon_enriched(spark, sf_dir):
    return groupon.groupon_enriched(
        D.groupon_detail_lines(spark, sf_dir), D.groupon_main_lines(spark, sf_dir),
        D.order_lines(spark, sf_dir), 30 * DAY,
    ).select("user", "groupon", "order_id", "groupon_status", "category", "order_status", "amount",
             *window_bounds())
