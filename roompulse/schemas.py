"""Record layouts and the event vocabulary.

Layouts are plain ``{column: Spark type}`` dicts in column order, so that they can be read
without a session; ``ddl()`` turns one into a schema string.
"""

from __future__ import annotations

# Event ids.
APP_LAUNCH = "appLaunch"
LIVE_ENTER = "liveEnter"
LIVE_LEAVE = "liveLeave"
LIVE_REWARD = "liveReward"
PRODUCT_PREFIX = "product"

# Keys of the property bag.
ANCHOR = "anchor_id"
GIFT = "gift_id"
SESSION = "live_session"
CATEGORY = "category_id"
PRODUCT = "product_id"

# Change types that are kept.
CHANGE_TYPES = ("INSERT", "UPDATE", "DELETE")

# Fields of a behaviour event.
BEHAVIOR = {
    "id": "string", "deviceId": "string", "guid": "string", "account": "string",
    "appId": "string", "appVersion": "string", "carrier": "string", "deviceType": "string",
    "eventId": "string", "ip": "string", "latitude": "double", "longitude": "double",
    "netType": "string", "osName": "string", "osVersion": "string", "releaseChannel": "string",
    "resolution": "string", "sessionId": "string", "timestamp": "bigint",
    "newSessionId": "string", "country": "string", "province": "string", "city": "string",
    "region": "string", "date": "string", "hour": "string",
    "properties": "map<string,string>", "lastUpdate": "bigint", "isNew": "int", "isN": "int",
}

# Protobuf field numbers of a behaviour event (23 is unused, isN is not sent).
PROTO_TAGS = {
    "id": 1, "deviceId": 2, "guid": 3, "account": 4, "appId": 5, "appVersion": 6, "carrier": 7,
    "deviceType": 8, "eventId": 9, "ip": 10, "longitude": 11, "latitude": 12, "netType": 13,
    "osName": 14, "osVersion": 15, "releaseChannel": 16, "resolution": 17, "sessionId": 18,
    "timestamp": 19, "newSessionId": 20, "country": 21, "province": 22, "city": 24,
    "region": 25, "date": 26, "hour": 27, "isNew": 28, "lastUpdate": 29, "properties": 30,
}

# Rows inside a change record.
ORDER_MAIN = {
    "oid": "bigint", "create_time": "timestamp", "total_money": "double", "status": "int",
    "update_time": "timestamp", "province": "string", "city": "string",
}
ORDER_DETAIL = {
    "id": "bigint", "order_id": "bigint", "category_id": "int", "categoryName": "string",
    "sku": "bigint", "money": "double", "amount": "int", "create_time": "timestamp",
    "update_time": "timestamp",
}

# Comma-separated lines, in field order.
GIFT_LINE = {"id": "string", "name": "string", "score": "double"}
GROUPON_DETAIL_LINE = {"ts": "bigint", "user": "string", "groupon": "string", "order_id": "string"}
GROUPON_MAIN_LINE = {"ts": "bigint", "groupon": "string", "status": "string", "category": "string"}
ORDER_LINE = {"ts": "bigint", "order_id": "string", "status": "string", "amount": "double"}

# Columns of a Kafka record, used by the file-backed stand-ins in tests.
KAFKA_RECORD = {
    "key": "binary", "value": "binary", "topic": "string", "partition": "int",
    "offset": "bigint", "timestamp": "timestamp", "timestampType": "int",
}


def ddl(layout: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in layout.items())
