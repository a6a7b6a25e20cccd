"""Proportional stratified interleaving, in DataFrame operations alone.

Rows of a source are shuffled by a seeded hash and ranked 1..n; row r gets the fraction
(2 r - 1) / (2 n).  Ordered by that fraction every stretch of the whole holds the sources in
their proportions, so the order is cut into shards of equal row counts.  Places in the order
come from ranges of it: sources of one row, which all have the fraction a half, spread like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .ranks import named, placed, running


def interleave(
    docs: DataFrame, shards: int = 16, seed: int = 1234, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """(id, source, size, text_crc32, carry..., shard, slot) for every row of ``docs``.

    size is the text's UTF-8 bytes plus 1.  Shard row counts differ by one at most; slots run
    from 0 without a gap.  Null sources form a source of their own, null texts count no bytes
    and have the CRC of the empty text, null ids stand for themselves, and repeated rows
    are placed one after the other.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        named(source_col).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
        *(carry or []),
    )
    # Rows without an id are told apart by their text, so that they spread over the cells.
    rows = rows.withColumn("digest", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))))
    rows, ties = cut(rows), ["text_crc32", "size"]
    ranked = running(rows, ["stratum"], "digest", "one", "rank", ties)
    at = (F.col("rank") * 2 - 1) / (F.col("rank_total") * 2)
    whole = placed(ranked.withColumn("at", at), "at", "stratum", "rank", out="position")
    total = rows.count()
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return whole.withColumn("shard", shard).select("id", "source", "size", "text_crc32", *(carry or []), F.col("shard").cast("int").alias("shard"), (F.col("position") - start).alias("slot")).withColumnRenamed("id", id_col)


def with_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``.

    Rows are written once with a number of their own, by which each finds its place, so that
    rows equal in all columns get a place each and no group of them meets in a task.
    """
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = interleave(numbered, shards, id_col=id_col, text_col=text_col, carry=["__row"], **how)
    mine = numbered.join(found.select("__row", F.struct("shard", "slot").alias("__place")), "__row")
    return mine.select(*[F.col(f"`{c}`") for c in docs.columns], "__place.shard", "__place.slot")
