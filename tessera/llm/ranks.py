"""Ranks and running sums within a group that may hold a third of all rows.

Rows of a group are ordered by a 32-digit hexadecimal hash.  Its first three digits name one
of 4096 cells; a window orders the rows of a cell, and the sums of the cells before it come
from the aggregated cells.  No task holds more than one cell of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def running(df: DataFrame, group: list[str], digest: str, weight: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows of the same group up to and with
    this one, and ``out``_total: the sum over the group.

    The columns of ``group`` must not be null.
    """
    cell = F.substring(digest, 1, 3)
    df = df.withColumn("__cell", cell)
    sums = df.groupBy(*group, "__cell").agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__sum").over(Window.partitionBy(*group)).alias(f"{out}_total")
    sums = sums.select(*group, "__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), total)
    inside = Window.partitionBy(*group, "__cell").orderBy(digest, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("__inside", F.sum(weight).over(inside))
    return ranked.join(sums, [*group, "__cell"]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__cell", "__before", "__inside")


def placed(df: DataFrame, *order: str, out: str) -> DataFrame:
    """``df`` with ``out``: each row's place, from 0, by the columns ``order``, which are unique together.

    Rows are dealt out by ranges of the order and sorted within them; a place is the number of
    rows in the ranges before, one number for each range, and the place in the range.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits of the identifier number the range, the lower 33 the row in it.
    rows = rows.withColumn("__range", F.shiftrightunsigned("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), "__range").withColumn(out, place).drop("__at", "__range", "__start")


def named(column: str):
    """A never-null name of a nullable string column: null and '' stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))
