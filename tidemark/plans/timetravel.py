"""The instant that a table version specifier names."""

from __future__ import annotations

from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from tidemark.plans.tokens import SqlError


def version_instant(text: str) -> int:
    """Milliseconds since 1970 of RFC 3339, RFC 2822, '%Y-%m-%d %H:%M:%S %z' or '%Y-%m-%d %H:%M:%S' (UTC)."""
    text = text.strip()
    found = None
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        for read in (lambda s: datetime.strptime(s, "%Y-%m-%d %H:%M:%S %z"), parsedate_to_datetime):
            try:
                found = read(text)
                break
            except (ValueError, TypeError):
                continue
    if found is None:
        raise SqlError(f"Failed to parse version {text} as timestamp")
    if found.tzinfo is None:
        found = found.replace(tzinfo=timezone.utc)
    return int(found.timestamp() * 1000)
