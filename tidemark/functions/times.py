"""Instants of the language: UTC, as milliseconds since 1970."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime

from .edn import DatalogError

#: The open end of valid time, and the start that stands for all windows in a retraction (fixed values of the log format).
FOREVER, ALL_TIME = (1 << 63) - 1, -(1 << 63) + 1
_FORMS = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d{1,9})?Z)?")


def millis(text: str) -> int:
    """Milliseconds of YYYY-MM-DD or YYYY-MM-DDTHH:MM:SS[.fff]Z."""
    if not _FORMS.fullmatch(text):
        raise DatalogError(f"{text!r} isn't a UTC date or time")
    try:
        found = datetime.fromisoformat(text.removesuffix("Z")[:26]).replace(tzinfo=UTC)
    except ValueError:
        raise DatalogError(f"{text!r} isn't a date or time") from None
    return round(found.timestamp() * 1000)


def text_of(ms: int) -> str:
    """The text form of an instant."""
    return datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def now() -> int:
    return time.time_ns() // 1_000_000
