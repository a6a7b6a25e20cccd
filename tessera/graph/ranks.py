"""Ranks over a whole frame without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def ranked(df: DataFrame, *order: str | Column, out: str = "rank") -> DataFrame:
    """``df`` with ``out``: each row's place, from 0, by the columns ``order``.

    Rows are dealt out by ranges of the order and sorted within them; a row's place is the
    number of rows in the ranges before plus its place in its own.  Only one row for each range
    meets in a window.  Rows equal in all of ``order`` stand in one range, in any sequence.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # The identifier's upper bits number the range, the lower 33 the row in it.
    rows = rows.withColumn("__range", F.shiftrightunsigned("__at", 33)).withColumn("__nth", F.col("__at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__range").withColumn(out, (F.col("__start") + F.col("__nth")).cast("long")).drop("__at", "__range", "__nth", "__start")
