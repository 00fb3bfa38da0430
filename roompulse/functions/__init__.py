from roompulse.functions.columns import (  # noqa: F401
    epoch_ms, event_date, event_hour, floor_to, live_delta, prop, record_id, routes,
)
