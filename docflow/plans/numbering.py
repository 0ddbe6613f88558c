"""Numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``, their number from 0 among rows of equal ``by`` in the order of ``order``; nulls are a group, and first in order.

    Rows are range-partitioned by both, so that a hot group covers several partitions; each partition numbers its own, from where the group's
    earlier partitions end.
    """
    part, size, before = f"__{name}_part", f"__{name}_size", f"__{name}_before"
    dealt = cut(rows.repartitionByRange(by, order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(by, part).agg(F.count("*").alias(size))
    ahead = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias(f"__{by}"), F.col(part).alias(f"_{part}"), F.coalesce(F.sum(size).over(ahead), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(by, part).orderBy(order)) - 1
    joined = dealt.withColumn(name, inside.cast("long")).join(sizes, F.col(by).eqNullSafe(F.col(f"__{by}")) & (F.col(part) == F.col(f"_{part}")))
    return joined.select(*rows.columns, (F.col(name) + F.col(before)).cast("long").alias(name))
