"""Extension: validate feeds as they arrive in a folder.

The reference behaviour has no streaming; this is a file stream of archives
whose batches go through the ordinary validation.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.validate import validate_feed


def validate_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, **budgets: Any) -> StreamingQuery:
    """Append the notices of each new archive in ``folder`` to the Parquet table ``output``."""

    def batch(files: DataFrame, number: int) -> None:
        for row in files.select("path").distinct().toLocalIterator():
            path = row.path.removeprefix("file://").removeprefix("file:")
            found = validate_feed(spark, path, **dict(budgets)).notices
            found.withColumns({"path": F.lit(path), "batch": F.lit(number)}).write.mode("append").parquet(output)

    arrivals = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.zip").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path")
    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
