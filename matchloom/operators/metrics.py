"""Scores of a matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.graph import component_sizes, inside_components
from matchloom.operators.pairs import PAIR, distinct_pairs


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``(lid, rid, outcome)``: tp, fp or fn of every canonical pair on either side."""
    t = distinct_pairs(truth).withColumn("_t", F.lit(True))
    p = distinct_pairs(predicted).withColumn("_p", F.lit(True))
    outcome = F.when(F.col("_t") & F.col("_p"), "tp").when(F.col("_p"), "fp").otherwise("fn")
    return t.join(p, PAIR, "full_outer").select(*PAIR, outcome.alias("outcome"))


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), 2)


def pair_scores(outcomes: DataFrame, extra_fp: int = 0) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and f1 in percent; f1 comes from the rounded two.  Null where the divisor is 0."""
    n = lambda k: F.count(F.when(F.col("outcome") == k, 1))
    c = outcomes.agg(n("tp").alias("tp"), (n("fp") + F.lit(extra_fp)).alias("fp"), n("fn").alias("fn"))
    c = c.withColumns({"precision": _percent(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _percent(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", F.round(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 2))


def column_scores(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: unrounded precision, recall, f1 and accuracy of two 0/1 columns."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"), F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"), F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
    )
    return c.select(
        "tp", "fp", "fn", "tn",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
    )


def outer_scores(truth: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """``(stage, tp, fp, fn, precision, recall, f1)`` of several predictions, by a full outer join with the truth each."""
    out = None
    for name, p in predictions.items():
        s = pair_scores(confusion(truth, p)).withColumn("stage", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def candidate_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the share of true pairs with both ends among the candidates' ends (loose) and as a pair (exact)."""
    t = distinct_pairs(truth)
    c = distinct_pairs(candidates)
    loose = t.join(c.select("lid").distinct(), "lid", "left_semi").join(c.select("rid").distinct(), "rid", "left_semi")
    n = t.agg(F.count(F.lit(1)).alias("n_true"))
    a = loose.agg(F.count(F.lit(1)).alias("loose"))
    b = t.join(c, PAIR, "left_semi").agg(F.count(F.lit(1)).alias("exact"))
    x = n.crossJoin(a).crossJoin(b)  # one row each
    return x.select("n_true", F.round(F.try_divide("loose", "n_true"), 6).alias("recall_loose"), F.round(F.try_divide("exact", "n_true"), 6).alias("recall_exact"))


def purity(truth: DataFrame, members: DataFrame) -> DataFrame:
    """One row: size-weighted mean share of true pairs within components of two or more; null if there is none."""
    sizes = component_sizes(members).where("size > 1")
    hits = inside_components(distinct_pairs(truth), members).groupBy("component_id").agg(F.count(F.lit(1)).alias("hits"))
    x = sizes.join(hits, "component_id", "left").withColumn("p", F.coalesce("hits", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2))
    return x.agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("size")), F.sum("size")), 6).alias("purity"), F.count(F.lit(1)).alias("n_components"))


def component_count(members: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: components with an edge, isolated ids, and both together."""
    c = members.agg(F.countDistinct("component_id").alias("linked"))
    i = ids.select("id").distinct().join(members.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    return c.crossJoin(i).withColumn("components", F.col("linked") + F.col("isolated"))  # one row each


def removed_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: percentages of true and false positives that a clean-up removed."""
    a, b = before.select(F.col("tp").alias("tp0"), F.col("fp").alias("fp0")), after.select(F.col("tp").alias("tp1"), F.col("fp").alias("fp1"))
    return a.crossJoin(b).select(_percent(F.col("tp0") - F.col("tp1"), F.col("tp0")).alias("removed_tp"), _percent(F.col("fp0") - F.col("fp1"), F.col("fp0")).alias("removed_fp"))


def runs_summary(runs: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation of each value over runs."""
    return runs.groupBy(*group).agg(*[f for v in values for f in (F.round(F.avg(v), 6).alias(f"{v}_mean"), F.round(F.stddev_pop(v), 6).alias(f"{v}_std"))])


def adjusted_recall(truth: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: the share of true pairs that were scored, and recall times it."""
    t = distinct_pairs(truth).withColumn("_t", F.lit(1))
    s = scored.groupBy(*PAIR).agg(F.max("pred").alias("pred"))
    x = t.join(s, PAIR, "left").agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("seen"), F.count(F.when(F.col("pred") == 1, 1)).alias("hit"))
    return x.select(F.round(F.try_divide("seen", "n"), 6).alias("blocking_recall"), F.round(F.try_divide("hit", "n"), 6).alias("adjusted_recall"))


def stage_curve(stages: DataFrame, order: str, values: list[str]) -> DataFrame:
    """``(stage, metric, value, change)``: stage metrics unpivoted, with the change from the stage before."""
    long = stages.select(order, F.expr(f"stack({len(values)}, " + ", ".join(f"'{v}', cast({v} as double)" for v in values) + ") as (metric, value)"))
    w = Window.partitionBy("metric").orderBy(order)
    return long.withColumn("change", F.col("value") - F.lag("value").over(w)).select(F.col(order).alias("stage"), "metric", "value", "change")


def probability_histogram(preds: DataFrame, low: float = 0.0, bins: int = 20) -> DataFrame:
    """``(bin, n)``: counts of prob in equal bins on [low, 1]; 1 falls into the last bin, null and lower values are left out."""
    x = preds.where(F.col("prob").between(low, 1.0))
    at = F.least(F.floor((F.col("prob") - low) / ((1 - low) / bins)), F.lit(bins - 1))
    return x.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
