"""Relative-date tokens and ISO 8601 literals, resolved once on the driver."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, tzinfo
from zoneinfo import ZoneInfo

TOKEN = re.compile(r"@(?:now|(?P<last>last_)?(?P<unit>day|week|month|quarter|year)_start|last_(?P<days>\d+)_days_start)")
PARTIAL_ISO = re.compile(r"(\d{4})(?:-(\d{2}))?")
LONG_FRACTION = re.compile(r"(\.\d{6})\d+")


def zone(tz: str) -> tzinfo:
    try:
        return ZoneInfo(tz)
    except Exception:
        raise ValueError(f"unknown timezone '{tz}'") from None


def is_token(value: object) -> bool:
    return isinstance(value, str) and TOKEN.fullmatch(value) is not None


def resolve_token(token: str, tz: str = "UTC", now: datetime | None = None) -> datetime:
    """The start of the period named by ``token``, as wall-clock time in ``tz``.

    Weeks start on Monday, quarters are calendar quarters, and steps back are
    taken on the calendar, not in hours.
    """
    found = TOKEN.fullmatch(token)
    if not found:
        raise ValueError(f"unknown date token '{token}'")
    local = (now or datetime.now(UTC)).astimezone(zone(tz))
    if token == "@now":
        return local
    today = local.replace(hour=0, minute=0, second=0, microsecond=0)
    if found["days"]:
        return today - timedelta(days=int(found["days"]) - 1)
    back = 1 if found["last"] else 0
    if found["unit"] == "day":
        return today - timedelta(days=back)
    if found["unit"] == "week":
        return today - timedelta(days=today.weekday() + 7 * back)
    span = {"month": 1, "quarter": 3, "year": 12}[found["unit"]]
    months = today.year * 12 + today.month - 1
    first = months - months % span - back * span
    return today.replace(year=first // 12, month=first % 12 + 1, day=1)


def parse_iso(text: str) -> datetime:
    """An ISO 8601 date or timestamp; the offset is kept when there is one."""
    partial = PARTIAL_ISO.fullmatch(text)
    if partial:
        return datetime(int(partial[1]), int(partial[2] or 1), 1)
    return datetime.fromisoformat(LONG_FRACTION.sub(r"\1", text))


def is_iso(value: object) -> bool:
    if not isinstance(value, str):
        return False
    try:
        parse_iso(value)
    except ValueError:
        return False
    return True


def moment(value: str, tz: str, now: datetime | None) -> datetime:
    return resolve_token(value, tz, now) if is_token(value) else parse_iso(value)


def wall_clock(value: str, tz: str, now: datetime | None) -> datetime:
    """For columns without a zone: the wall-clock time as written or resolved."""
    return moment(value, tz, now).replace(tzinfo=None)


def instant(value: str, tz: str, now: datetime | None) -> datetime:
    """For columns of instants: a literal without an offset is read in ``tz``."""
    at = moment(value, tz, now)
    return (at if at.tzinfo else at.replace(tzinfo=zone(tz))).astimezone(UTC)
