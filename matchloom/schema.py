"""Row shapes that operators expect, and checks that return counts instead of failing half-way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = "lid long, rid long"
TRUTH = "lid long, rid long, label int"
CANDIDATES = "lid long, rid long, label int, match_type string"
PREDICTIONS = "lid long, rid long, prob double, match_type string, label int, manual_check_label int"
PREDICTION_LOG = "lids long, rids long, labels int, predictions int, prediction_proba double"
#: Edge iff prob > threshold; counted as a match iff prob >= threshold.
MATCH_THRESHOLD = 0.999
COMPONENT_CAP = 50
UNCHECKED = -1


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """The frame itself, or a ValueError naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def violations(df: DataFrame, **rules) -> DataFrame:
    """``(rule, n)``: how many rows break each named condition (a Column); nulls break it."""
    counts = df.agg(*[F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("n")) for k in rules])).alias("r")).select("r.rule", "r.n")
