"""Log lines as JSON objects: time, level, message, and whatever else is given."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"ts": datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds"), "level": record.levelname.lower(), "msg": record.getMessage()}
        return json.dumps(line | getattr(record, "meta", {}), default=str)


def logger(name: str = "frameloom") -> logging.Logger:
    """A driver-side logger; pass ``extra={"meta": {...}}`` for further fields."""
    made = logging.getLogger(name)
    if not made.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonFormatter())
        made.addHandler(handler)
        made.setLevel(logging.INFO)
    return made
