"""The benchmark tables seen as behaviour events, order change-logs and text lines.

Every view is a projection of a whole table: no rows are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.functions.columns import epoch_ms

# Which event of the tables stands for which event of the application.
EVENT_IDS = {"signup": S.APP_LAUNCH, "view": "productView", "click": S.LIVE_ENTER,
             "error": S.LIVE_LEAVE, "purchase": S.LIVE_REWARD}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as behaviour events; fields the table cannot fill are left out."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.lit(None).cast("string")
    for theirs, ours in EVENT_IDS.items():
        event = F.when(F.col("event_type") == theirs, ours).otherwise(event)
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("deviceId"),
        F.pmod("user_id", F.lit(10)).cast("string").alias("deviceType"),
        event.alias("eventId"),
        F.concat(F.lit("os"), F.pmod("user_id", F.lit(3)).cast("string")).alias("osName"),
        F.pmod(k, F.lit(5)).cast("string").alias("releaseChannel"),
        epoch_ms("ts").alias("timestamp"),
        F.concat(F.lit("p"), F.pmod(k, F.lit(7)).cast("string")).alias("province"),
        F.create_map(
            F.lit(S.ANCHOR), F.pmod(k, F.lit(20)).cast("string"),
            F.lit(S.SESSION), F.col("user_id").cast("string"),
            F.lit(S.CATEGORY), F.pmod(k, F.lit(2)).cast("string"),
            F.lit(S.PRODUCT), k.cast("string"),
            F.lit(S.GIFT), k.cast("string"),
        ).alias("properties"),
    )


def raw_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour events as Kafka records of JSON text, of which every 17th is damaged in each of six ways."""
    number = F.col("id").cast("bigint")
    whole = F.to_json(F.struct("deviceId", "deviceType", "eventId", "osName", "releaseChannel",
                               "timestamp", "province", "properties"))
    cut = F.concat(F.lit('{"deviceId":"'), "deviceId", F.lit('","eventId":'))
    start = F.concat(F.lit('{"deviceId":"'), "deviceId")
    kind = number % 17
    text = (F.when(kind == 0, cut).when(kind == 1, F.concat(start, F.lit('"}'), start, F.lit('"}')))
            .when(kind == 2, F.concat(start, F.lit('","timestamp":"soon"}'))).when(kind == 3, F.lit("null"))
            .when(kind == 4, F.lit(""))
            .when(kind == 5, F.concat(start, F.lit('","properties":{"product_id":"1"}}'))).otherwise(whole))
    return behavior(spark, sf_dir).select(
        text.cast("binary").alias("value"),
        F.lit("behavior").alias("topic"),
        F.pmod(number, F.lit(8)).cast("int").alias("partition"),
        number.alias("offset"),
    )


def _change_type(key: str):
    return F.element_at(
        F.array(*[F.lit(t) for t in ("INSERT", "UPDATE", "DELETE", "TRUNCATE", "INSERT")]),
        (F.pmod(key, F.lit(5)) + 1).cast("int"))


def _text_time(ts: str):
    return F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def order_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as order main rows."""
    status = (F.when(F.col("o_orderstatus") == "O", 101).when(F.col("o_orderstatus") == "F", 102)
              .when(F.col("o_orderstatus") == "P", 103).cast("int"))
    when = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("oid"), when.alias("create_time"),
        F.col("o_totalprice").alias("total_money"), status.alias("status"),
        when.alias("update_time"), F.col("o_orderpriority").alias("province"))


def order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as order detail rows, with the ingest batch they came in."""
    when = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"),
        F.col("l_extendedprice").alias("money"), F.col("l_quantity").cast("int").alias("amount"),
        when.alias("update_time"), F.expr(
            "unix_millis(cast(l_shipdate AS timestamp)) div 2592000000 + if(l_orderkey % 3 = 0, 6, 0)"
        ).alias("ingest_batch"))


def raw_order_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-log of ``orders``: every third record holds two rows, every 13th breaks off, every 11th has a
    status in its first row that is no number."""
    row = F.struct(
        F.col("o_orderkey").alias("oid"), _text_time("o_orderdate").alias("create_time"),
        F.col("o_totalprice").alias("total_money"), F.when(
            F.pmod("o_orderkey", F.lit(11)) == 5, "soon").otherwise("101").alias("status"),
        _text_time("o_orderdate").alias("update_time"), F.col("o_orderpriority").alias("province"))
    paid = row.withField("status", F.lit("102"))
    return _envelopes(table(spark, sf_dir, "orders"), "o_orderkey", row, paid)


def raw_order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-log of ``lineitem``: every third record holds two rows, every 13th breaks off."""
    row = F.struct(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"),
        F.col("l_extendedprice").alias("money"), F.col("l_quantity").cast("int").alias("amount"),
        _text_time("l_shipdate").alias("update_time"))
    more = row.withField("amount", F.col("l_quantity").cast("int") + 1)
    return _envelopes(table(spark, sf_dir, "lineitem"), "l_orderkey", row, more)


def _envelopes(df: DataFrame, key: str, row, second) -> DataFrame:
    data = F.when(F.pmod(key, F.lit(3)) == 0, F.array(row, second)).otherwise(F.array(row))
    whole = F.to_json(F.struct(_change_type(key).alias("type"), data.alias("data")))
    broken = F.concat(F.lit('{"type":"INSERT","data":[{"oid":'), F.col(key).cast("string"))
    return df.select(
        F.when(F.pmod(key, F.lit(13)) == 0, broken).otherwise(whole).alias("value"))


def gift_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as gift lines ``id,name,score`` in two versions, of which the second is valid."""
    name = F.when(F.col("version") == 0, F.concat(F.lit("OLD_"), "n_name")).otherwise(F.col("n_name"))
    score = F.when(F.col("version") == 0, F.col("n_regionkey") + 100).otherwise(F.col("n_regionkey"))
    return (table(spark, sf_dir, "nation")
            .withColumn("version", F.explode(F.array(F.lit(0), F.lit(1))))
            .select(F.concat_ws(",", F.col("n_nationkey").cast("string"), name,
                                score.cast("double").cast("string"),
                                F.col("version").cast("string")).alias("value")))


def gift_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as gifts whose score changes four times, about every eight days from the first of January 2024."""
    day = 86_400_000
    version = F.col("version")
    since = F.lit(1_704_067_200_000) + (version * 8 + F.pmod("n_nationkey", F.lit(5))).cast("bigint") * day
    return (table(spark, sf_dir, "nation").withColumn("version", F.explode(F.array(*[F.lit(i) for i in range(4)])))
            .select(F.col("n_nationkey").cast("string").alias("id"), F.concat_ws("_", "n_name", version).alias("name"),
                    (F.col("n_regionkey") + 10 * version).cast("double").alias("score"), since.cast("bigint").alias("since")))


def groupon_detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as lines ``ts,user,groupon,order``."""
    return table(spark, sf_dir, "lineitem").select(F.concat_ws(
        ",", epoch_ms("l_shipdate").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string")).alias("value"))


def groupon_main_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as lines ``ts,groupon,status,category``, one group purchase per customer."""
    return table(spark, sf_dir, "orders").select(F.concat_ws(
        ",", epoch_ms("o_orderdate").cast("string"), F.col("o_custkey").cast("string"),
        "o_orderstatus", "o_orderpriority").alias("value"))


def order_lines(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """``orders`` as lines ``ts,order,status,amount``; if ``damaged``, every 11th has no number or no field there."""
    kind = F.pmod("o_orderkey", F.lit(11)) if damaged else F.lit(-1)
    amount = F.when(kind == 0, "n/a").when(kind != 1, F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select(F.concat_ws(
        ",", epoch_ms("o_orderdate").cast("string"), F.col("o_orderkey").cast("string"),
        "o_orderstatus", amount).alias("value"))
