"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

A token budget flows from the root of the domain - language - source tree to its leaves.  At
each node it is shared among the children in proportion to their weights; no child gets more
than its capacity (the tokens below it times ``max_epochs``), and what a child cannot take
goes to its siblings first.  Only what a whole subtree lacks reaches the siblings of an
ancestor.  A leaf then takes whole seeded epochs and a token prefix of the last one.

All amounts are whole numbers and a budget is never exceeded.  A prefix is made of whole rows:
the tokens before a row that does not fit any more stay unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .ranks import named, running


SALTS = 64


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (parent..., name, weight, cap, budget of the parent) with ``got``.

    Children are taken in the order of capacity per weight: those that fill up come first,
    and the rest divides what they leave.  Shares are rounded down, and the tokens that this
    leaves go one by one to the first of the rest, so that nothing of a budget is lost.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "name")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    n = (
        nodes.withColumn("__left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(rest))
        .withColumn("__full", F.col("cap") * F.col("__weights") <= F.col("__left") * F.col("weight"))
        .withColumn("__open", F.max(F.when(~F.col("__full"), F.col("__weights"))).over(whole))
        .withColumn("__spare", F.max(F.when(~F.col("__full"), F.col("__left"))).over(whole))
    )
    n = n.withColumn("__share", F.when(~F.col("__full"), F.expr("(__spare * weight) div __open")))
    n = n.withColumn("__over", F.col("__spare") - F.sum("__share").over(whole)).withColumn("__nth", F.count("__share").over(upto))
    got = F.when(F.col("__full"), F.col("cap")).otherwise(F.col("__share") + F.when(F.col("__nth") <= F.col("__over"), 1).otherwise(0))
    return n.withColumn("got", got).drop("__left", "__weights", "__full", "__open", "__spare", "__share", "__over", "__nth")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], total: Column, levels: list[str], max_epochs: int) -> DataFrame:
    """``leaves`` (levels..., tokens) with ``budget``.  A name without a weight weighs 1."""
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs).where("cap > 0")
    above = tree.agg(F.sum("cap").alias("cap"), total.cast("long").alias("budget"))
    above = above.select(F.lit(0).alias("root"), F.least("cap", "budget").alias("got"))
    for depth, level in enumerate(levels):
        parent = ["root", *levels[:depth]]
        nodes = tree.withColumn("root", F.lit(0)).groupBy(*parent, level).agg(F.sum("cap").alias("cap"))
        weight = F.lit(1).cast("long")
        for name, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == f"={name}", F.lit(w).cast("long")).otherwise(weight)
        nodes = nodes.join(above.withColumnRenamed("got", "budget"), parent).withColumn("weight", weight).withColumn("name", F.col(level))
        above = share(nodes, parent).select(*parent, level, "got")
    return leaves.join(above.drop("root").withColumnRenamed("got", "budget"), levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, int]],
    domain: Column,
    share_of_tokens: tuple[int, int] = (1, 1),
    max_epochs: int = 1,
    seed: int = 77,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(id, domain, lang, source, n_tokens, budget, epochs, text_crc32) for every row of ``docs``.

    epochs says how often the row is used, 0 for rows beyond the budget.  n_tokens counts
    runs of non-blank characters.  The budget is ``share_of_tokens`` of all tokens.  Null
    and empty texts have no tokens and are used as often as whole epochs run, plus once if
    they stand before the cut; null domains, languages and sources are names of their own;
    a row that repeats an id is a row like any other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), domain.cast("string").alias("domain"), count.alias("n_tokens"), F.crc32(text).alias("__crc"), F.md5(text).alias("__md5")
    )
    rows = cut(rows.select("*", named("domain").alias("__d"), named("lang").alias("__l"), named("source").alias("__s")))
    levels = ["__d", "__l", "__s"]
    leaves = cut(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    total = F.expr(f"(sum(tokens) * {share_of_tokens[0]}) div {share_of_tokens[1]}")
    of = {"__d": weights.get("domain", {}), "__l": weights.get("lang", {}), "__s": weights.get("source", {})}
    plan = cut(budgets(leaves, of, total, levels, max_epochs))
    plan = plan.withColumn("__whole", F.expr("if(tokens > 0, budget div tokens, 0)")).withColumn("__part", F.expr("if(tokens > 0, budget % tokens, 0)"))
    # Each epoch has an order of its own; only that of the last, cut one decides.
    # A leaf may hold a third of all rows: its plan is repeated for every salt.
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seeded = rows.withColumn("__salt", F.pmod(F.xxhash64("id", "__crc"), F.lit(SALTS)).cast("int")).join(salted, [*levels, "__salt"])
    seeded = seeded.withColumn("__digest", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("__md5"))))
    upto = running(cut(seeded.drop("__md5")), levels, "__digest", "n_tokens", "__upto", ["__crc", "n_tokens"])
    epochs = F.col("__whole") + F.when((F.col("__part") > 0) & (F.col("__upto") <= F.col("__part")), 1).otherwise(0)
    return upto.select(F.col("id").alias(id_col), "domain", "lang", "source", "n_tokens", "budget", epochs.cast("long").alias("epochs"), F.col("__crc").alias("text_crc32"))


def materialize(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as ``plan`` (see ``mix``) uses it.

    Rows are found by id and text, a null id being an id of its own; rows equal in both are
    all used as often as the most used of them.
    """
    used = plan.where("epochs > 0").groupBy(named(id_col).alias("__used"), F.col("text_crc32").alias("__crc")).agg(F.max("epochs").alias("__times"))
    crc = F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    repeated = docs.withColumn("__used", named(id_col)).withColumn("__crc", crc).join(used, ["__used", "__crc"]).withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
