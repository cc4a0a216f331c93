"""As-of joins: for each row the last event of its key before it, however many rows and events a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.session import cut


def latest(rows: DataFrame, events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``rows`` with ``value``: that of the last of ``events`` (``key, at, value``) with the row's key and a smaller ``at``; null without one.

    Rows and events are dealt together by ranges of key and order, so a key of any size spreads over tasks. What a range
    cannot know, the last event before it, is one value for each key that runs into it, and is joined to it afterwards.
    """
    both = rows.withColumn("__event", F.lit(None).cast(events.schema[value].dataType)).withColumn("__row", F.lit(True))
    both = both.unionByName(events.select(key, at, F.col(value).alias("__event"), F.lit(False).alias("__row")), allowMissingColumns=True)
    dealt = cut(both.repartitionByRange(key, at).withColumn("__part", F.spark_partition_id()))
    # of a row and an event at one place the row comes first
    here = Window.partitionBy("__part", key).orderBy(at, F.desc("__row")).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("__last", F.last("__event", ignorenulls=True).over(here)).where("__row")
    tails = dealt.groupBy(key, "__part").agg(F.max(F.when(~F.col("__row"), F.struct(at, "__event"))).alias("__tail"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(key, "__part", F.last("__tail", ignorenulls=True).over(before)["__event"].alias("__carried")).where("__carried IS NOT NULL")
    out = found.join(carried, [key, "__part"], "left")
    return out.select(*rows.columns, F.coalesce("__last", "__carried").alias(value))
