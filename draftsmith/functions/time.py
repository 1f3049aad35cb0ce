"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, with the sub-second part.

    A ``TIMESTAMP_NTZ`` wall time is read as UTC (``unix_timestamp`` does not
    apply the session zone to it); casting NTZ to ``TIMESTAMP`` would.
    """
    sec = F.date_part(F.lit("SECOND"), ts).cast("double")
    return F.unix_timestamp(ts).cast("double") + (sec - F.floor(sec))


def event_time(ts: Column) -> Column:
    """An instant (``TIMESTAMP``) for watermarks and windows, zone-independent."""
    return F.timestamp_micros(F.round(epoch_seconds(ts) * 1e6).cast("bigint"))
