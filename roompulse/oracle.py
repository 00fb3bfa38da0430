"""The same queries in plain SQL, straight from the tables, to check the results with."""

from __future__ import annotations

import math

from roompulse.functions.bloom import BloomShape

SMALL_BLOOM = BloomShape(expected=6, false_positives=0.3, buckets=2)
HOUR = 3_600_000
DAY = 24 * HOUR

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

BEHAVIOR = f"""behavior AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, CAST(user_id AS VARCHAR) AS "deviceId",
         CAST(user_id % 10 AS VARCHAR) AS "deviceType",
         CASE event_type WHEN 'signup' THEN 'appLaunch' WHEN 'view' THEN 'productView'
              WHEN 'click' THEN 'liveEnter' WHEN 'error' THEN 'liveLeave'
              WHEN 'purchase' THEN 'liveReward' END AS "eventId",
         'os' || CAST(user_id % 3 AS VARCHAR) AS "osName",
         CAST({_K} % 5 AS VARCHAR) AS "releaseChannel",
         'p' || CAST({_K} % 7 AS VARCHAR) AS province,
         (epoch_us(ts) // 1000) AS "timestamp", ts,
         CAST({_K} % 20 AS VARCHAR) AS anchor_id, CAST(user_id AS VARCHAR) AS live_session,
         CAST({_K} % 2 AS VARCHAR) AS category_id, CAST({_K} AS VARCHAR) AS product_id,
         CAST({_K} AS VARCHAR) AS gift_id
  FROM events)"""

_LIVE = """live AS (
  SELECT *, CASE "eventId" WHEN 'liveEnter' THEN 1 ELSE -1 END AS d,
         CASE "eventId" WHEN 'liveEnter' THEN 1 ELSE 0 END AS e
  FROM behavior WHERE "eventId" IN ('liveEnter', 'liveLeave'))"""

_LAUNCH = """launch AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY "deviceId" ORDER BY "timestamp", id) = 1
                 THEN 1 ELSE 0 END AS flag
  FROM behavior WHERE "eventId" = 'appLaunch')"""

_GIFT_DIM = """dim AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS score
  FROM nation)"""


_GIFT_VERSIONS = """versions AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name || '_' || v AS name, CAST(n_regionkey + 10 * v AS DOUBLE) AS score,
         1704067200000 + (v * 8 + n_nationkey % 5) * 86400000 AS since
  FROM nation, range(4) AS r(v))"""


def _bucket(ms: str, size: int) -> str:
    return f"(({ms}) - ({ms}) % {size})"


_USER_COLUMNS = """id, "deviceId", "eventId", {flag} AS "isNew", "osName" AS os, province,
  "releaseChannel" AS channel, "deviceType", "timestamp" AS "eventTime",
  strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H') AS hour"""


def _cdc(table: str, key: str, first: str, second: str, columns: str, bad: str = "false") -> str:
    kind = f"""CASE {key} % 5 WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' ELSE 'INSERT' END"""
    kept = f"{key} % 13 <> 0 AND {key} % 5 <> 3"
    return f"""SELECT {first} {columns}, {kind} AS type FROM {table} WHERE {kept} AND NOT ({bad})
      UNION ALL
      SELECT {second} {columns}, {kind} AS type FROM {table} WHERE {kept} AND {key} % 3 = 0"""


def _bloom(shape: BloomShape | None, false_positives: float = 0.03) -> str:
    """A filter of a given shape, or one per group sized for its devices."""
    if shape is None:
        factor = -math.log(false_positives) / math.log(2) ** 2
        size = f"CAST(ceil(count(*) OVER (PARTITION BY \"deviceType\") * {factor!r}::DOUBLE) AS BIGINT)"
        bits = ", ".join(f"(h0 + {i} * h1) % size" for i in range(round(-math.log2(false_positives))))
    else:
        size = "0"
        bits = ", ".join(
            f"h2 % {shape.buckets} * {shape.bucket_bits} + (h0 + {i} * h1) % {shape.bucket_bits}"
            for i in range(shape.hashes))
    return f"""WITH {BEHAVIOR}, {_LAUNCH},
    first_rows AS (SELECT * FROM launch WHERE flag = 1),
    hashed AS (
      SELECT "deviceType", "timestamp", id, {size} AS size,
             CAST('0x' || substr(md5("deviceId"), 1, 8) AS BIGINT) AS h0,
             CAST('0x' || substr(md5("deviceId"), 9, 8) AS BIGINT) AS h1,
             CAST('0x' || substr(md5("deviceId"), 17, 8) AS BIGINT) AS h2
      FROM first_rows),
    bits AS (SELECT "deviceType", "timestamp", id, unnest([{bits}]) AS bit FROM hashed),
    owners AS (
      SELECT DISTINCT id FROM (
        SELECT id, row_number() OVER (PARTITION BY "deviceType", bit
                                      ORDER BY "timestamp", id) AS r FROM bits) WHERE r = 1)
    SELECT {_USER_COLUMNS.format(flag="CASE WHEN id IN (SELECT id FROM owners) THEN 1 ELSE 0 END")}
    FROM launch"""


_SLIDING = f"""WITH {BEHAVIOR}, pv AS (
    SELECT category_id, "eventId", product_id,
           unnest(range(0, 10)) * {HOUR} AS back, {_bucket('"timestamp"', HOUR)} AS pane
    FROM behavior WHERE starts_with("eventId", 'product')),
  counts AS (
    SELECT category_id, "eventId", product_id, pane - back AS window_start,
           CAST(count(*) AS BIGINT) AS count, pane - back + {10 * HOUR} AS window_end
    FROM pv GROUP BY ALL)"""

_DETAIL = f"""detail AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS sku,
         (epoch_us(l_shipdate) // 1000) AS detail_ms, epoch_us(l_shipdate) // 1000 // 2592000000 + CASE l_orderkey % 3 WHEN 0 THEN 6 ELSE 0 END AS ingest_batch
  FROM lineitem)"""

_MAIN = """main AS (
  SELECT o_orderkey AS oid, o_totalprice AS total_money, (epoch_us(o_orderdate) // 1000) AS main_ms,
         CASE o_orderstatus WHEN 'O' THEN 101 WHEN 'F' THEN 102 WHEN 'P' THEN 103 END AS status
  FROM orders)"""


def _late(size: int) -> str:
    return f"""{_DETAIL}, newest AS (
      SELECT ingest_batch, max(detail_ms) AS m FROM detail GROUP BY 1),
    marks AS (
      SELECT ingest_batch, max(m) OVER (ORDER BY ingest_batch ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING) - 2001 AS wm FROM newest),
    flagged AS (
      SELECT d.*, coalesce({_bucket('d.detail_ms', size)} + {size} - 1 <= wm, false) AS late
      FROM detail d JOIN marks USING (ingest_batch))"""


_GROUPON = f"""detail AS (
    SELECT CAST(l_partkey AS VARCHAR) AS "user", CAST(l_suppkey AS VARCHAR) AS groupon,
           CAST(l_orderkey AS VARCHAR) AS order_id,
           {_bucket('(epoch_us(l_shipdate) // 1000)', 30 * DAY)} AS w FROM lineitem),
  main AS (
    SELECT CAST(o_custkey AS VARCHAR) AS groupon, o_orderstatus AS status,
           o_orderpriority AS category, {_bucket('(epoch_us(o_orderdate) // 1000)', 30 * DAY)} AS w
    FROM orders),
  ord AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS status, o_totalprice AS amount,
           {_bucket('(epoch_us(o_orderdate) // 1000)', 30 * DAY)} AS w FROM orders)"""

ORACLE: dict[str, str] = {
    "parse_events_clean": f"""WITH {BEHAVIOR}
      SELECT 'behavior-' || event_id % 8 || '-' || event_id AS id, "deviceId", "deviceType",
             "eventId", "osName", "releaseChannel", province, "timestamp", anchor_id, product_id,
             CAST(0 AS INTEGER) AS "isNew"
      FROM behavior WHERE event_id % 17 > 5""",
    "parse_events_quarantine": f"""WITH {BEHAVIOR}
      SELECT 'behavior-' || event_id % 8 || '-' || event_id AS id,
             CASE event_id % 17 WHEN 0 THEN '{{"deviceId":"' || "deviceId" || '","eventId":'
               WHEN 1 THEN '{{"deviceId":"' || "deviceId" || '"}}{{"deviceId":"' || "deviceId" || '"}}'
               WHEN 2 THEN '{{"deviceId":"' || "deviceId" || '","timestamp":"soon"}}'
               WHEN 3 THEN 'null' ELSE '' END AS raw,
             CASE event_id % 17 WHEN 2 THEN 'unreadable: timestamp' ELSE 'not a JSON object' END AS reason
      FROM behavior WHERE event_id % 17 < 5""",
    "events_lacking_property": f"""WITH {BEHAVIOR}
      SELECT 'behavior-' || event_id % 8 || '-' || event_id AS id, "deviceId"
      FROM behavior WHERE event_id % 17 = 5""",
    "lines_quarantine": """SELECT (epoch_us(o_orderdate) // 1000) || ',' || o_orderkey || ',' || o_orderstatus ||
        CASE o_orderkey % 11 WHEN 0 THEN ',n/a' ELSE '' END AS raw, 'unreadable line' AS reason
      FROM orders WHERE o_orderkey % 11 < 2""",
    "cdc_quarantine": """SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'not a JSON object' ELSE 'unreadable element' END AS reason,
        CAST(count(*) AS BIGINT) AS n FROM orders
      WHERE o_orderkey % 13 = 0 OR (o_orderkey % 5 <> 3 AND o_orderkey % 11 = 5) GROUP BY 1""",
    "cdc_order_main": _cdc(
        "orders", "o_orderkey", "CAST(101 AS INTEGER) AS status,", "CAST(102 AS INTEGER) AS status,",
        "o_orderkey AS oid, o_totalprice AS total_money, o_orderpriority AS province, "
        "(epoch_us(o_orderdate) // 1000) AS update_ms", bad="o_orderkey % 11 = 5"),
    "cdc_order_detail": _cdc(
        "lineitem", "l_orderkey", "CAST(l_quantity AS INTEGER) AS amount,",
        "CAST(l_quantity AS INTEGER) + 1 AS amount,",
        "l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS sku, "
        "l_extendedprice AS money, (epoch_us(l_shipdate) // 1000) AS update_ms"),
    "delimited_lines": """SELECT (epoch_us(o_orderdate) // 1000) AS ts, CAST(o_orderkey AS VARCHAR) AS order_id,
      o_orderstatus AS status, o_totalprice AS amount FROM orders WHERE o_orderkey % 11 > 1""",
    "event_date_hour": """SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y%m%d') AS date,
      strftime(ts, '%H') AS hour FROM events""",
    "filter_equals": f"""WITH {BEHAVIOR}
      SELECT id, "eventId", "deviceId" FROM behavior WHERE "eventId" = 'appLaunch'""",
    "filter_in": f"""WITH {BEHAVIOR}
      SELECT id, "eventId", "deviceId" FROM behavior WHERE "eventId" IN ('liveEnter', 'liveLeave')""",
    "filter_prefix": f"""WITH {BEHAVIOR}
      SELECT id, "eventId", "deviceId" FROM behavior WHERE starts_with("eventId", 'product')""",
    "etl_route": f"""WITH {BEHAVIOR}
      SELECT id, "eventId", 'product' AS route FROM behavior WHERE starts_with("eventId", 'product')
      UNION ALL
      SELECT id, "eventId", 'gift' AS route FROM behavior WHERE "eventId" = 'liveReward'""",
    "proto_roundtrip": f"""WITH {BEHAVIOR}
      SELECT id, "deviceId", "eventId", "timestamp", "releaseChannel", anchor_id, gift_id,
             CASE "eventId" WHEN 'liveReward' THEN 'gift' ELSE 'product' END AS route
      FROM behavior WHERE "eventId" = 'liveReward' OR starts_with("eventId", 'product')""",
    "gift_dim_latest": f"WITH {_GIFT_DIM} SELECT id, name, score FROM dim",
    "gift_join": f"""WITH {BEHAVIOR}, {_GIFT_DIM}
      SELECT b.id, anchor_id, gift_id, CAST(1 AS INTEGER) AS gifts, name AS gift_name, score
      FROM behavior b LEFT JOIN dim ON b.gift_id = dim.id WHERE "eventId" = 'liveReward'""",
    "gift_totals": f"""WITH {BEHAVIOR}, {_GIFT_DIM}
      SELECT anchor_id, CAST(count(*) AS BIGINT) AS gifts, coalesce(sum(score), 0.0) AS points
      FROM behavior b LEFT JOIN dim ON b.gift_id = dim.id WHERE "eventId" = 'liveReward'
      GROUP BY anchor_id""",
    "gift_join_as_of": f"""WITH {BEHAVIOR}, {_GIFT_VERSIONS}
      SELECT b.id, anchor_id, gift_id, "timestamp", CAST(1 AS INTEGER) AS gifts, name AS gift_name, score
      FROM behavior b ASOF LEFT JOIN versions v ON b.gift_id = v.id AND b."timestamp" >= v.since
      WHERE "eventId" = 'liveReward'""",
    "gift_totals_as_of": f"""WITH {BEHAVIOR}, {_GIFT_VERSIONS}
      SELECT anchor_id, CAST(count(*) AS BIGINT) AS gifts, coalesce(sum(score), 0.0) AS points
      FROM behavior b ASOF LEFT JOIN versions v ON b.gift_id = v.id AND b."timestamp" >= v.since
      WHERE "eventId" = 'liveReward' GROUP BY anchor_id""",
    "audience_running": f"""WITH {BEHAVIOR}, {_LIVE}
      SELECT anchor_id, id, "timestamp",
             CAST(sum(d) OVER w AS BIGINT) AS online, CAST(sum(e) OVER w AS BIGINT) AS total
      FROM live WINDOW w AS (PARTITION BY anchor_id ORDER BY "timestamp", id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "audience_totals": f"""WITH {BEHAVIOR}, {_LIVE}
      SELECT anchor_id, CAST(sum(d) AS BIGINT) AS online, CAST(sum(e) AS BIGINT) AS total
      FROM live GROUP BY anchor_id""",
    "audience_window_delta": f"""WITH {BEHAVIOR}, {_LIVE}
      SELECT anchor_id, {_bucket('"timestamp"', HOUR)} AS window_start,
             {_bucket('"timestamp"', HOUR)} + {HOUR} AS window_end,
             CAST(sum(d) AS BIGINT) AS online, CAST(sum(e) AS BIGINT) AS total
      FROM live GROUP BY ALL""",
    "audience_windowed": f"""WITH {BEHAVIOR}, {_LIVE}, per_window AS (
        SELECT anchor_id, {_bucket('"timestamp"', HOUR)} AS window_start, sum(d) AS d, sum(e) AS e
        FROM live GROUP BY ALL)
      SELECT anchor_id, window_start, window_start + {HOUR} AS window_end,
             CAST(sum(d) OVER w AS BIGINT) AS online, CAST(sum(e) OVER w AS BIGINT) AS total
      FROM per_window WINDOW w AS (PARTITION BY anchor_id ORDER BY window_start
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "audience_valid": f"""WITH {BEHAVIOR}, {_LIVE}, stepped AS (
        SELECT anchor_id, e, "timestamp" AS t,
               lead("timestamp") OVER (PARTITION BY anchor_id, live_session
                                       ORDER BY "timestamp", id) AS n,
               max("timestamp") OVER () AS newest FROM live)
      SELECT anchor_id, CAST(sum(CASE WHEN coalesce(n, newest) - t > {DAY} THEN 1 ELSE 0 END) AS BIGINT)
             AS valid_total
      FROM stepped WHERE e = 1 GROUP BY anchor_id""",
    "new_user_flag": f"""WITH {BEHAVIOR}, {_LAUNCH}
      SELECT {_USER_COLUMNS.format(flag="CAST(flag AS INTEGER)")} FROM launch""",
    "new_user_flag_bloom": _bloom(None),
    "new_user_flag_bloom_small": _bloom(SMALL_BLOOM),
    "new_by_device_type": f"""WITH {BEHAVIOR}, {_LAUNCH}
      SELECT "deviceType", CAST(sum(flag) AS BIGINT) AS new_users FROM launch GROUP BY ALL""",
    "new_by_channel": f"""WITH {BEHAVIOR}, {_LAUNCH}
      SELECT "releaseChannel", CAST(sum(flag) AS BIGINT) AS new_users FROM launch GROUP BY ALL""",
    "new_by_both": f"""WITH {BEHAVIOR}, {_LAUNCH}
      SELECT "deviceType", "releaseChannel", CAST(sum(flag) AS BIGINT) AS new_users
      FROM launch GROUP BY ALL""",
    "new_user_totals": f"""WITH {BEHAVIOR}, {_LAUNCH}
      SELECT CASE WHEN grouping("releaseChannel") = 1 THEN 'deviceType'
                  WHEN grouping("deviceType") = 1 THEN 'releaseChannel' ELSE 'both' END AS dims,
             "deviceType", "releaseChannel", CAST(sum(flag) AS BIGINT) AS new_users
      FROM launch GROUP BY GROUPING SETS (("deviceType"), ("releaseChannel"),
                                          ("deviceType", "releaseChannel"))""",
    "sliding_counts": f"{_SLIDING} SELECT * FROM counts",
    "hot_products": f"""{_SLIDING}, ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY window_start, category_id, "eventId"
                                          ORDER BY count DESC, product_id) AS INTEGER) AS sort
        FROM counts)
      SELECT * FROM ranked WHERE sort <= 3""",
    "order_window_left_join": f"""WITH {_DETAIL}, {_MAIN}
      SELECT id, order_id, sku, oid AS main_oid, total_money AS main_total_money,
             status AS main_status, {_bucket('detail_ms', 90 * DAY)} AS window_start,
             {_bucket('detail_ms', 90 * DAY)} + {90 * DAY} AS window_end
      FROM detail LEFT JOIN main ON order_id = oid
           AND {_bucket('detail_ms', 90 * DAY)} = {_bucket('main_ms', 90 * DAY)}""",
    "order_late_split": f"""WITH {_late(30 * DAY)}
      SELECT id, order_id, sku, detail_ms, ingest_batch, late FROM flagged""",
    "order_detail_enriched": f"""WITH {_late(90 * DAY)}, {_MAIN}
      SELECT f.id, f.order_id, f.sku, f.detail_ms, f.late,
             coalesce(a.oid, b.oid) AS main_oid,
             coalesce(a.total_money, b.total_money) AS main_total_money,
             coalesce(a.status, b.status) AS main_status,
             CASE WHEN a.oid IS NOT NULL THEN 'window' WHEN b.oid IS NOT NULL THEN 'lookup' END
               AS found_by
      FROM flagged f
      LEFT JOIN main a ON NOT f.late AND f.order_id = a.oid
           AND {_bucket('f.detail_ms', 90 * DAY)} = {_bucket('a.main_ms', 90 * DAY)}
      LEFT JOIN main b ON f.order_id = b.oid""",
    "groupon_join_main": f"""WITH {_GROUPON}
      SELECT d."user", d.groupon, d.order_id, m.status AS main_status, m.category AS main_category,
             d.w AS window_start, d.w + {30 * DAY} AS window_end
      FROM detail d LEFT JOIN main m ON d.groupon = m.groupon AND d.w = m.w""",
    "groupon_enriched": f"""WITH {_GROUPON}
      SELECT d."user", d.groupon, d.order_id, m.status AS groupon_status, m.category,
             o.status AS order_status, o.amount, d.w AS window_start, d.w + {30 * DAY} AS window_end
      FROM detail d LEFT JOIN main m ON d.groupon = m.groupon AND d.w = m.w
      LEFT JOIN ord o ON d.order_id = o.order_id AND d.w = o.w""",
}
