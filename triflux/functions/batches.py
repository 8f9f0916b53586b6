"""How much of a partition a task hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: About how many bytes of rows make a batch.
BYTES = 1 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Lets rows go to Python in batches of about ``BYTES``, unless the session has a limit.

    Spark's own limit is 64 MB, so that a batch is a whole partition of texts. It is then
    held by the executor, by its worker and once more in what the worker makes of it,
    for each core, and neither process gives the memory back. Rows are the same.
    """
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BYTES))
