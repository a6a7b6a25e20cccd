"""Line dedup by a tree of line templates, in DataFrame operations alone.

A line is cut at blanks, tokens with a digit become ``<*>``, and the line walks a tree of fixed
depth: first by its number of tokens, then by its ``depth`` leading tokens.  In the leaf lines
are generalised against each other: a token that fewer than ``min_docs`` lines of the leaf share
at its position is a variable field and becomes ``<*>`` too.  What a line then reads is its
template, if at least ``KEEP`` of its tokens are neither fields nor digits; else, and wherever the
line itself recurs, the line is its own template.  Templates that occur in ``min_docs`` different
texts or more are boilerplate, and all their lines are dropped.

Texts and lines are told apart by 128-bit hashes.  Lines are counted once for each text; only
the lines of leaves with enough texts and with lines that do not recur by themselves are read
again and generalised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

#: Runs of blanks but for a lone space, which is left as it is.
BLANKS = "[\\t\\x0B\\f\\r][ \\t\\x0B\\f\\r]*+| [ \\t\\x0B\\f\\r]++"
#: What a line that is not blank holds.
WORD = "[^ \\t\\x0B\\f\\r]"
#: A token with a digit, tried at the starts of tokens alone and without going back.
VARIABLE = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
#: The share of a template's tokens that must be constant words, as (numerator, denominator).
KEEP = (3, 5)
#: A text with more dropped lines than this is cut by a join instead of by a list.
LISTED = 1000
#: Rows of hashes that are sent to every task as they are; beyond, 2 ** BITS bits of them are.
SMALL = 200_000
BITS = 27


def flat(line: Column) -> Column:
    """The line's tokens joined by single blanks, those with a digit as ``<*>``; '' for a blank line."""
    uneven = reduce(lambda a, b: a | b, [line.contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")])
    spaced = F.trim(F.when(uneven, F.regexp_replace(line, BLANKS, " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, VARIABLE, "<*>")).otherwise(spaced)


def leaf(flattened: Column, depth: int) -> Column:
    """The path of a flattened line: its number of tokens and its leading ones."""
    gaps = F.octet_length(flattened) - F.octet_length(F.replace(flattened, F.lit(" "), F.lit("")))
    return F.concat_ws("\t", (gaps + 1).cast("string"), F.substring_index(flattened, " ", depth))


def _hash(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _flat_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, flat): the lines of each text that are not blank."""
    lines = rows.select(*keys, F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(WORD))
    return lines.select(*keys, flat(F.col("line")).alias("flat"))


def _near(df: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key may be one of ``some``: all that are, and a few that are not.

    A bit of a bitmap stands for each key, whose size (16 MB) does not grow with them.
    """
    at = lambda: F.xxhash64(key).bitwiseAND((1 << BITS) - 1)
    words = some.select(at().alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    blocks = words.groupBy(F.shiftright("word", 6).alias("__block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(63), "bits"))).alias("held"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long")))
    met = df.withColumn("__at", at()).join(F.broadcast(blocks.select("__block", dense.alias("__bits"))), F.shiftright("__at", 12) == F.col("__block"))
    return met.where("getbit(element_at(__bits, cast((__at >> 6) & 63 as int) + 1), cast(__at & 63 as int)) = 1").select(*df.columns)


def _met(df: DataFrame, some: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` joined with ``some`` of counted rows and unique keys; where they are many, only what is near them is shuffled.

    The join is never a semi join: Spark would send that ahead of the bitmap.
    """
    return (df if rows <= SMALL else _near(df, some, key)).join(broadcast_if_small(some, rows, SMALL), key)


def _open_leaves(seen: DataFrame, each: DataFrame, min_docs: int) -> DataFrame:
    """(leaf): leaves of ``min_docs`` texts or more with a line that does not recur by itself.

    The counts of the lines tell it for most: a recurring line has enough texts, and no leaf has more
    texts than its lines have together.  Only for the others texts are counted.
    """
    told = each.groupBy("leaf").agg(F.sum("n").alias("most"), F.min("n").alias("least"), F.max("n").alias("sure"))
    told = cut(told.where((F.col("least") < min_docs) & (F.col("most") >= min_docs)).select("leaf", (F.col("sure") >= min_docs).alias("sure")))
    doubtful = told.where("NOT sure").select("leaf")
    texts = _met(seen.select("leaf", "h"), doubtful, doubtful.count(), "leaf").distinct()
    return told.where("sure").select("leaf").unionByName(texts.groupBy("leaf").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_docs).select("leaf"))


def _generalised(rows: DataFrame, seen: DataFrame, each: DataFrame, min_docs: int, depth: int) -> DataFrame:
    """(t): lines that do not recur themselves, but whose template does."""
    leaves = cut(_open_leaves(seen, each, min_docs).withColumn("in", F.monotonically_increasing_id()))
    size = leaves.count()
    if not size:
        return each.select("t").limit(0)
    # Never null, so that no test for null is sent ahead of the join, where it would flatten each line again.
    path = F.coalesce(_hash(leaf(F.col("flat"), depth)), F.lit(b""))
    read = _met(_flat_lines(rows).withColumn("leaf", path), leaves, size, "leaf").select("flat")
    texts = read.withColumn("t", _hash(F.col("flat"))).groupBy("t").agg(F.min("flat").alias("flat"))
    # From here on lines and leaves have numbers, which take less room than hashes in a row for each token.
    lines = cut(_met(each, leaves, size, "leaf").join(texts, "t").select("t", "in", "n", "flat", F.monotonically_increasing_id().alias("line")))
    split = F.split("flat", " ")
    tokens = lines.select("line", "in", "n", F.size(split).alias("size"), F.posexplode(split).alias("pos", "token")).where(F.col("token") != "<*>")
    constant = tokens.groupBy("in", "pos", "token").agg(F.sum("n").alias("lines")).where(F.col("lines") >= min_docs).select("in", "pos", "token")
    # A template is its number of tokens and its constant words with their places: all others read <*>.
    words = tokens.where(F.col("n") < min_docs).select("line", "in", "size", "pos", "token").join(constant, ["in", "pos", "token"])
    made = words.groupBy("line", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("words"))
    made = made.where(F.size("words") * KEEP[1] >= F.col("size") * KEEP[0])
    # Templates are told apart by hash: a row has a bounded size, however long its line.
    template = F.concat_ws(" ", F.col("size").cast("string"), F.transform("words", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["token"])))
    made = cut(made.select("line", _hash(template).alias("template")).join(lines.select("line", "t"), "line").select("t", "template"))
    recurring = _met(seen.select("h", "t"), made, made.count(), "t").select("template", "h").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    return made.join(recurring, "template", "left_semi").select("t")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, depth: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_dropped): every row of ``docs`` without its recurring lines.

    Lines end at line feeds; lines without a token, carriage returns or not, stay.  Copies of
    one text count once and cannot turn each other into boilerplate.  A null text has no lines
    and stays null; an empty one has one blank line.  Equal rows, and rows that share a text,
    get equal results; null ids are kept; an empty table gives no rows; other columns are not
    read.  A text of any length is cut as a whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", _hash(F.col("text")))
    seen = cut(_flat_lines(rows, "h").select("h", _hash(F.col("flat")).alias("t"), _hash(leaf(F.col("flat"), depth)).alias("leaf")).distinct())
    each = cut(seen.groupBy("t", "leaf").agg(F.count(F.lit(1)).alias("n")))
    recurring = each.where(F.col("n") >= min_docs).select("t")
    dropped = cut(recurring.unionByName(_generalised(rows, seen, each, min_docs, depth)))
    marked = cut(_met(seen.select("h", "t"), dropped, dropped.count(), "t").select("h", "t"))
    long = marked.groupBy("h").count().where(F.col("count") > LISTED).select("h")
    long = cut(long)
    n_long = long.count()
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    listed = marked.groupBy("h").agg(F.collect_set("t").alias("dropped"))
    if n_long:
        listed = listed.join(broadcast_if_small(long, n_long), "h", "left_anti")
    lines = F.split("text", "\n")
    keep = F.filter(lines, lambda x: ~F.array_contains("dropped", _hash(flat(x))))  # a blank line is never dropped
    short = rows.join(broadcast_if_small(long, n_long), "h", "left_anti") if n_long else rows
    whole = short.join(listed, "h", "left").withColumn("kept", F.when(F.col("dropped").isNull(), lines).otherwise(keep))
    out = whole.select("id", F.array_join("kept", "\n").alias("text"), n.alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_dropped"))
    if n_long:
        # Line by line: the lines of a text are cut once, whatever the number of rows that hold it.
        longs = rows.join(broadcast_if_small(long, n_long), "h", "left_semi")
        placed = longs.groupBy("h").agg(F.first("text").alias("text")).select("h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        left = placed.withColumn("t", _hash(flat(F.col("line")))).join(marked, ["h", "t"], "left_anti")
        cut_ = left.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("kept")).select("h", F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("rest"), F.size("kept").alias("stay"))
        stay = F.coalesce("stay", F.lit(0))
        out = out.unionByName(longs.join(cut_, "h", "left").select("id", F.coalesce("rest", F.lit("")).alias("text"), n.alias("n_lines"), (n - stay).cast("long").alias("n_dropped")))
    return out.withColumnRenamed("id", id_col)
