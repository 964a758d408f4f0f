"""Content-addressed identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(*columns: Column, size: int = 16) -> Column:
    """First hex digits of the SHA-256 of the columns, joined by |; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns]), 256), 1, size)


def record_id(*columns: Column, size: int = 16) -> Column:
    """First hex digits of a SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns])), 1, size)
