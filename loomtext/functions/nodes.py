"""Questions about node tables as joins and windows over ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(nodes: DataFrame) -> DataFrame:
    """``nodes`` with previous_id and next_id: the siblings of the same tag before and after."""
    w = Window.partitionBy("page_id", "parent_id", "tag").orderBy("node_id")
    return nodes.withColumns({"previous_id": F.lag("node_id").over(w), "next_id": F.lead("node_id").over(w)})


def is_top() -> Column:
    return F.col("tag").isin("html", "body", "#document")


def inside(outer: str, inner: str) -> Column:
    """Rows of alias ``inner`` that lie in those of alias ``outer``."""
    o, i = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return (o("page_id") == i("page_id")) & (i("node_id") > o("node_id")) & (i("node_id") <= o("end_id"))


def subtree_counts(nodes: DataFrame, **counted: Column) -> DataFrame:
    """``nodes`` with, for each condition, how many nodes of a subtree meet it.

    Running sums in document order: a subtree's count is the sum up to its last
    node less the sum up to the node itself. One sort by page, no interval join."""
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    run = {f"__{k}": F.sum(c.cast("long")).over(w) for k, c in counted.items()}
    x = nodes.withColumns(run)
    ends = x.select(F.col("page_id").alias("__page"), F.col("node_id").alias("__end"), *(F.col(f"__{k}").alias(f"__e_{k}") for k in counted))
    x = x.join(ends, (F.col("page_id") == F.col("__page")) & (F.col("end_id") == F.col("__end")))
    return x.select(*nodes.columns, *((F.col(f"__e_{k}") - F.col(f"__{k}")).alias(k) for k in counted))


def child_histograms(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, children: (tag, n) of a node's children, sorted, so that
    equal ones compare equal."""
    n = nodes.groupBy("page_id", F.col("parent_id").alias("node_id"), "tag").agg(F.count("*").alias("n"))
    return n.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("tag", "n"))).alias("children"))


def attribute_values(nodes: DataFrame) -> DataFrame:
    """page_id, tag, name, values: the distinct values of every attribute."""
    x = nodes.select("page_id", "tag", F.explode("attrs").alias("name", "value"))
    return x.groupBy("page_id", "tag", "name").agg(F.array_sort(F.collect_set("value")).alias("values"))


def majority_ancestor(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """page_id, node_id: the deepest node of each page that holds more than half
    of its ``chosen`` nodes (page_id, node_id)."""
    c = chosen.select("page_id", F.col("node_id").alias("c"))
    total = c.groupBy("page_id").agg(F.count("*").alias("total"))
    held = nodes.join(c, "page_id").where("c > node_id and c <= end_id").groupBy("page_id", "node_id", "depth").agg(F.count("*").alias("n"))
    most = held.join(total, "page_id").where("n * 2 > total")
    return most.groupBy("page_id").agg(F.max_by("node_id", F.struct("depth", -F.col("node_id"))).alias("node_id"))


def majority_paths(chosen: DataFrame) -> DataFrame:
    """page_id, xpath, chosen: the path of the node that ``majority_ancestor`` gives,
    and how many nodes are chosen. What holds a node has a beginning of its path
    for its own, so the chosen nodes (page_id, xpath) are all that is needed."""
    steps = F.split("xpath", "/")
    # the beginning without a step is the page, which holds all
    each = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("xpath")))
    held = chosen.select("page_id", F.explode(each).alias("of")).groupBy("page_id", "of").agg(F.count("*").alias("n"))
    x = held.groupBy("page_id").agg(F.max("n").alias("chosen"), F.collect_list(F.struct("of.depth", "of.xpath", "n")).alias("all"))
    most = F.array_max(F.filter("all", lambda s: (s["depth"] > 1) & (s["n"] * 2 > F.col("chosen"))))
    return x.select("page_id", most["xpath"].alias("xpath"), "chosen").where("xpath is not null")


def same_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """page_id, same: whether two selections (page_id, node_id) are one set."""
    each = [x.groupBy("page_id").agg(F.array_sort(F.collect_set("node_id")).alias(k)) for x, k in ((a, "a"), (b, "b"))]
    return each[0].join(each[1], "page_id", "full").select("page_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def sample_indices(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """At most k rows, the same ones on every run: those whose keys hash lowest."""
    return rows.orderBy(F.xxhash64(key), key).limit(k)


def nonce(length: int = 8) -> Column:
    return F.substring(F.md5(F.rand().cast("string")), 1, length)
