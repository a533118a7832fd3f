"""Precision, recall and ROC of scored rows.

Counts at each threshold are running sums over distinct scores. Scores are
first summed by value, so the one ordered pass is over distinct scores, and
that pass is split by range: each range's totals are summed before it starts,
so no task sees all rows. The sums by value are written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.runtime import written


def thresholds(df: DataFrame, score: str = "score", positive: str = "positive", ranges: int = 64) -> DataFrame:
    """score, tp, fp, positives, negatives: what scores of at least ``score`` hold."""
    d = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    d, _ = written(d, "scores")
    # edges at quantiles of the distinct scores: ranges are even, however skewed scores are
    edges = d.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    r = F.lit(0)
    if edges:
        r = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e > F.col("score")))
    d = d.select("score", "p", "n", r.alias("r"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # one row for each range: at most ``ranges`` rows in the unpartitioned windows
    base = d.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    base = base.select("r", F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"), F.sum("rp").over(every).alias("positives"), F.sum("rn").over(every).alias("rows"))
    w = Window.partitionBy("r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    x = d.withColumns({"cp": F.sum("p").over(w), "cn": F.sum("n").over(w)}).join(F.broadcast(base), "r")
    tp, n = F.col("bp") + F.col("cp"), F.col("bn") + F.col("cn")
    return x.select("score", "r", tp.alias("tp"), (n - tp).alias("fp"), "positives", (F.col("rows") - F.col("positives")).alias("negatives"))


def pr_curve(df: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """score, precision, recall at every threshold that brings a true positive."""
    x = thresholds(df, score, positive)
    return _grown(x).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("positives")).alias("recall"))


def _grown(x: DataFrame) -> DataFrame:
    """Rows whose own score has a positive: its count is more than the next higher one's."""
    w = Window.partitionBy("r").orderBy(F.desc("score"))
    first = x.groupBy("r").agg(F.max("tp").alias("top"))
    prior = first.select("r", F.coalesce(F.max("top").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior"))
    y = x.join(F.broadcast(prior), "r").withColumn("was", F.coalesce(F.lag("tp").over(w), F.col("prior")))
    return y.where("tp > was")


def average_precision(df: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row: the mean precision, weighted by the positives of each threshold."""
    y = _grown(thresholds(df, score, positive))
    return y.agg((F.sum((F.col("tp") - F.col("was")) * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("positives")).alias("average_precision"))


def roc_curve(df: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    x = thresholds(df, score, positive)
    return x.select("score", (F.col("tp") / F.col("positives")).alias("tpr"), (F.col("fp") / F.col("negatives")).alias("fpr"))


def auc(df: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row: the area under the ROC curve, ties counted half."""
    x = thresholds(df, score, positive)
    w = Window.partitionBy("r").orderBy(F.desc("score"))
    edge = x.groupBy("r").agg(F.max("tp").alias("t"), F.max("fp").alias("f"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("r", F.coalesce(F.max("t").over(before), F.lit(0)).alias("et"), F.coalesce(F.max("f").over(before), F.lit(0)).alias("ef"))
    y = x.join(F.broadcast(edge), "r").withColumns({"pt": F.coalesce(F.lag("tp").over(w), F.col("et")), "pf": F.coalesce(F.lag("fp").over(w), F.col("ef"))})
    area = (F.col("fp") - F.col("pf")) * (F.col("tp") + F.col("pt")) / 2
    return y.agg((F.sum(area) / (F.max("positives") * F.max("negatives"))).alias("auc"))


def parse_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """score, positive of text lines "label score": labels above 0 are positive.
    Lines that don't read so are left out."""
    t = F.split(F.trim(column), r"\s+")
    x = lines.select(F.get(t, 1).try_cast("double").alias("score"), (F.get(t, 0).try_cast("double") > 0).alias("positive"))
    return x.where("score is not null and positive is not null")


def write_curve(points: DataFrame, path: str) -> None:
    """The points of a curve as a folder of tab-separated files with a header."""
    points.write.option("sep", "\t").option("header", True).csv(path)


def squared_error(y: Column, predicted: Column) -> Column:
    return F.avg((y - predicted) * (y - predicted))


def within(y: Column, predicted: Column, tolerance: float) -> Column:
    """Share of rows within the tolerance."""
    return F.avg((F.abs(y - predicted) <= tolerance).cast("int"))
