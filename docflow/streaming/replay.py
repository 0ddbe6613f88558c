"""Stream operators over tables that are there already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import shared

#: where the clock stands once all rows are in
END = "2200-01-01"


def replayed(rows: DataFrame, key: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` tells of ``rows (key, event_time, ...)`` as a stream that has come to its end.

    The rows are written as the stream's files, with one row of a null key at the end of time that moves the watermark past them; the answer is
    written too, so that nothing of it passes the driver.
    """
    spark = rows.sparkSession
    path = shared(spark, "replay")
    last = spark.range(1).select(*(F.lit(END).cast("timestamp").alias(c) if c == "event_time" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    rows.unionByName(last).write.parquet(f"{path}/rows")
    told = operator(spark.readStream.schema(rows.schema).parquet(f"{path}/rows"))
    query = told.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/told")
    query.awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{path}/told").where(F.col(key).isNotNull())
