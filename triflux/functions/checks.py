"""Values that must not be NULL, whatever the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(value: Column, message: str | Column, kind: str = "bigint") -> Column:
    """``value``, or an error with the message where it is NULL."""
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(value.isNull(), F.raise_error(said).cast(kind)).otherwise(value)
