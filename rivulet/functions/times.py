"""Durations and time windows; evaluated on the driver into plan literals."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_LONG = {"d": "days", "w": "weeks", "h": "hours"}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")
DEFAULT_AGE = timedelta(hours=24)
#: Lower bound of a window with only an end.
BEGINNING = datetime(1, 1, 1)


def parse_duration(text: str) -> timedelta:
    """'7d', '2w', '36h' (any case), or a sequence such as '1h30m' or '-1.5s'."""
    if m := re.fullmatch(r"(\d+)([dwh])", text, re.I):
        return timedelta(**{_LONG[m[2].lower()]: int(m[1])})
    body, sign = text, 1
    if body[:1] in "+-" and body:
        body, sign = body[1:], -1 if body[0] == "-" else 1
    if body == "0":
        return timedelta()
    parts = _PART.findall(body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"invalid duration {text!r}")
    return timedelta(seconds=sign * sum(float(a) * _UNITS[b] for a, b in parts))


def parse_rfc3339(text: str) -> datetime:
    """A time with zone, as UTC without zone."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    fraction = re.search(r"\.(\d+)", text)
    if fraction:
        text = text.replace(fraction[0], "." + (fraction[1] + "000000")[:6])
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)


def parse_window(now: datetime, max_age: str = "", start: str = "", end: str = "") -> tuple[datetime, datetime]:
    """Explicit bounds beat the age; without either, the last 24 hours."""
    if start or end:
        a = parse_rfc3339(start) if start else BEGINNING
        b = parse_rfc3339(end) if end else now
        if a > b:
            raise ValueError("start time must not be after end time")
        return a, b
    return now - (parse_duration(max_age) if max_age else DEFAULT_AGE), now


def window_label(max_age: str, start: datetime, end: datetime, explicit: bool = False) -> str:
    """'Last 24h' or 'From ... to ...'."""
    if max_age and not explicit:
        return f"Last {max_age}"
    fmt = "%Y-%m-%d %H:%M"
    return f"From {start.strftime(fmt)} to {end.strftime(fmt)}"
