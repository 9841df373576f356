"""Mixing sources to target weights: budgets down a tree of groups, then a token prefix of each leaf's seeded epochs.

Each level shares a node's budget among its children in proportion to their weights. A child never gets more than its
capacity (tokens below it times ``max_epochs``); what it can't take goes to its siblings, and only what all siblings
together can't take is missing in the parent, whose own siblings share it. A leaf repeats its documents in epochs, each
in an order of its own drawn by a keyed hash, and takes the first tokens of that stream up to its budget; the last
document may be taken in part.

Budgets are whole numbers (rounded down, so that at most one token per node is lost). Leaves are summed before the
shuffle; where a leaf's prefix ends is found from sums over ``BUCKETS`` hash ranges, and only rows of the range where it
ends are put in order, so a hot leaf is never sorted in one task. Null group values make a group of their own. Texts
without tokens, null or empty, are never taken. Repeated rows count as often as they come. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.storage import kept

BUCKETS = 4096
TOKENS = r"[^\x20\x09-\x0D]+"


def order_hash(doc_id: Column, epoch: Column, seed: int) -> Column:
    """32 bits that order a document within an epoch."""
    key = F.md5(F.concat_ws("|", doc_id.cast("string"), epoch.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def weight(column: str, weights: Mapping[str, int]) -> Column:
    """Weight of a group value; values not named weigh 1."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(1)).cast("long")


def share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Water-filling of ``budget`` among the children of a parent by ``weight`` and ``capacity``: adds ``own``."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighing = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("capacity") * weighing <= (F.col("budget") - before) * F.col("weight")
    nodes = nodes.withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    nodes = nodes.withColumn("taken", taken).withColumn("rest", rest)
    own = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(budget - taken) * weight div rest"))
    return nodes.withColumn("own", own).drop("full", "taken", "rest")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """``leaves`` (the level columns and ``n_tokens``) with the budget of each leaf."""
    capacity = (F.col("n_tokens") * max_epochs).alias("capacity")
    nodes = None
    for k, name in enumerate(levels):
        path = list(levels[: k + 1])
        level = leaves.select(*path, capacity).groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        if nodes is None:
            total = leaves.agg(F.expr(f"sum(n_tokens) * {percent} div 100").alias("budget"))
            level = level.join(F.broadcast(total))  # one row
        else:
            level = level.join(nodes, path[:-1])
        level = level.withColumn("weight", weight(name, weights.get(name, {})))
        nodes = share(level, path[:-1], name).select(*path, F.col("own").alias("budget"))
    return leaves.join(nodes, list(levels))


def mix(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int = 50, max_epochs: int = 2, seed: int = 42) -> DataFrame:
    """What is taken of ``doc_id, text`` and the level columns: doc_id, the levels, epoch, n_tokens, taken."""
    levels = list(levels)
    path = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in levels]
    count = F.coalesce(F.regexp_count("text", F.lit(TOKENS)), F.lit(0)).cast("long")
    counted = kept(docs.select(F.col("doc_id"), *path, count.alias("n_tokens")), "mix-counts").filter("n_tokens > 0")
    leaves = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("n_tokens"))
    leaves = budgets(leaves, levels, weights, percent, max_epochs).withColumnRenamed("n_tokens", "available")
    leaves = kept(leaves.selectExpr(*levels, "budget div available as epochs", "budget % available as rest"), "mix-budgets")

    part = counted.join(leaves, levels).withColumn("h", order_hash(F.col("doc_id"), F.col("epochs"), seed))
    part = part.withColumn("bucket", F.expr(f"h div {2**32 // BUCKETS}"))
    sums = part.filter("rest > 0").groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("n").over(run) - F.col("n"))
    ends = sums.filter("before < rest and before + n >= rest").selectExpr(*levels, "bucket as end_bucket", "before")
    part = part.join(ends, levels, "left")
    sorted_bucket = Window.partitionBy(*levels, "bucket").orderBy("h", "doc_id", "n_tokens")
    last = part.filter("bucket = end_bucket").withColumn("before", F.col("before") + F.sum("n_tokens").over(sorted_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    cut = last.withColumn("taken", F.least(F.col("n_tokens"), F.col("rest") - F.col("before"))).filter("taken > 0")
    columns = ["doc_id", *levels, "epochs as epoch", "n_tokens"]
    whole = part.filter("bucket < end_bucket").selectExpr(*columns, "n_tokens as taken")
    epochs = counted.join(leaves.filter("epochs > 0"), levels).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    epochs = epochs.selectExpr("doc_id", *levels, "epoch", "n_tokens", "n_tokens as taken")
    return epochs.unionByName(whole).unionByName(cut.selectExpr(*columns, "taken"))
