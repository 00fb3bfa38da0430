"""Settings of a streaming job."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

# The property names users already have in their job files.
PROPERTY_NAMES = {
    "bootstrap_servers": "bootstrap.servers",
    "input_topics": "kafka.input.topics",
    "main_topic": "kafka.input.main",
    "detail_topic": "kafka.input.detail",
    "product_topic": "kafka.product.output",
    "gift_topic": "kafka.gift.output",
    "starting_offsets": "auto.offset.reset",
    "checkpoint_interval_ms": "checkpoint.interval",
    "checkpoint_path": "checkpoint.path",
    "max_offsets": "max.offsets.per.trigger",
    "database": "sink.database.connect",
    "table": "sink.database.table",
}


@dataclass(frozen=True)
class JobConfig:
    bootstrap_servers: str | None = None
    input_topics: str | None = None
    main_topic: str | None = None
    detail_topic: str | None = None
    product_topic: str | None = None
    gift_topic: str | None = None
    starting_offsets: str = "earliest"
    checkpoint_interval_ms: int = 60_000
    checkpoint_path: str | None = None
    max_offsets: int | None = None          # records per micro-batch, or a first run reads all there is at once
    database: str | None = None             # module:function that makes a DB-API connection, for results in a database
    table: str | None = None                # their table
    client: tuple[tuple[str, str], ...] = ()    # all other properties, for the Kafka client

    @classmethod
    def from_properties(cls, path: str | Path) -> "JobConfig":
        """Read a ``key=value`` (or ``key: value``) properties file; unknown keys go to the
        Kafka client."""
        found: dict[str, str] = {}
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            line = line.strip()
            if not line or line[0] in "#!":
                continue
            cut = min((at for at in (line.find("="), line.find(":")) if at >= 0), default=-1)
            if cut > 0:
                found[line[:cut].strip()] = line[cut + 1:].strip()
        values = {f.name: found[PROPERTY_NAMES[f.name]] for f in fields(cls)
                  if PROPERTY_NAMES.get(f.name) in found}
        for name in ("checkpoint_interval_ms", "max_offsets"):
            if name in values:
                values[name] = int(values[name])
        values["client"] = tuple(sorted((k, v) for k, v in found.items() if k not in PROPERTY_NAMES.values()))
        return cls(**values)

    def require(self, name: str) -> str:
        value = getattr(self, name)
        if value is None:
            raise ValueError(f"setting '{PROPERTY_NAMES[name]}' is missing")
        return value

    @property
    def trigger(self) -> dict[str, str]:
        return {"processingTime": f"{self.checkpoint_interval_ms} milliseconds"}
