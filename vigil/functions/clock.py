"""The synthetic clock: integer steps of one hour from a fixed instant."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The anchor (2026-01-01T00:00:00Z as epoch seconds) and the length of a step.
ANCHOR_EPOCH = 1_767_225_600
STEP_SECONDS = 3_600


def step_to_time(step: Column) -> Column:
    """Timestamp of a step; null steps stay null."""
    return F.timestamp_seconds(F.lit(ANCHOR_EPOCH) + step.cast("long") * STEP_SECONDS)


def step_to_datetime(step: int) -> datetime:
    return datetime.fromtimestamp(ANCHOR_EPOCH, timezone.utc) + timedelta(seconds=STEP_SECONDS * step)
