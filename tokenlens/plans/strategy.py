"""Size-checked broadcast and the scan-versus-postings choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its row count is known to be under this bound.
DEFAULT_BROADCAST_ROWS = 2_000_000


def broadcast_rows_limit(spark) -> int:
    return int(spark.conf.get("tokenlens.broadcast.maxRows", str(DEFAULT_BROADCAST_ROWS)))


def checked_broadcast(df: DataFrame, max_rows: int | None = None, known_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(df), True)`` if ``df`` has at most ``max_rows`` rows, else ``(df, False)``.

    The count is a plain one: each task sends one number (a ``limit`` would gather rows of every
    partition in one task first). Callers must keep a shuffle-join path for the ``False`` case and
    pass ``known_rows`` or a written table where the side is costly to compute.
    """
    limit = max_rows if max_rows is not None else broadcast_rows_limit(df.sparkSession)
    n = known_rows if known_rows is not None else df.count()
    if n <= limit:
        return F.broadcast(df), True
    return df, False


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size has a fixed bound by construction (a vocabulary of at most
    65,536 ids, one row per partition, one row per shard). Callers state the bound at the call site."""
    return F.broadcast(df)
