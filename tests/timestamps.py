"""Rows of time for the tests."""

from datetime import datetime, timedelta


def hours(*offsets, start="2024-03-01"):
    """Timestamps by hour offset from a day."""
    origin = datetime.fromisoformat(start)
    return [origin + timedelta(hours=h) for h in offsets]
