"""Operators from pair table to pair table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["lid", "rid"]


def canonical(pairs: DataFrame, drop_loops: bool = False) -> DataFrame:
    """lid <= rid; the other columns stay.  Rows with a null end are dropped, self pairs on demand."""
    out = pairs.where("lid is not null and rid is not null").withColumns({"lid": F.least("lid", "rid"), "rid": F.greatest("lid", "rid")})
    return out.where("lid <> rid") if drop_loops else out


def first_per_pair(pairs: DataFrame, order: list[Column], key: list[str] = PAIR) -> DataFrame:
    """One row per pair, the first by a total order; never a row picked by chance."""
    w = Window.partitionBy(*key).orderBy(*order)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_confidence(pairs: DataFrame) -> list[Column]:
    """Highest prob first, then every other column in order of the alphabet, nulls last."""
    rest = sorted(c for c in pairs.columns if c not in ("lid", "rid", "prob"))
    return [F.desc_nulls_last("prob"), *[F.asc_nulls_last(c) for c in rest]]


def dedupe_predictions(preds: DataFrame, threshold: float | None = None) -> DataFrame:
    """Canonical predictions, one per pair; with a threshold only those with prob >= threshold."""
    p = canonical(preds, drop_loops=True)
    if threshold is not None:
        p = p.where(F.col("prob") >= threshold)
    return first_per_pair(p, by_confidence(p))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct canonical pairs without self pairs: the strict upper triangle of the pair matrix."""
    return canonical(pairs.select(*PAIR), drop_loops=True).distinct()


def attach_label(preds: DataFrame, truth: DataFrame, default: int | None = 0) -> DataFrame:
    """The truth's label on the canonical pair (the largest, if the truth has several); ``default`` where it has none."""
    t = canonical(truth).groupBy(*PAIR).agg(F.max("label").cast("int").alias("label"))
    out = preds.drop("label").join(t, PAIR, "left")
    return out if default is None else out.withColumn("label", F.coalesce("label", F.lit(default)))


def without(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that ``known`` does not hold in either orientation."""
    k = distinct_pairs(known).withColumnsRenamed({"lid": "_a", "rid": "_b"})
    return pairs.join(k, (F.least("lid", "rid") == F.col("_a")) & (F.greatest("lid", "rid") == F.col("_b")), "left_anti")


def lookup_score(pairs: DataFrame, scores: DataFrame, score: str = "prob") -> DataFrame:
    """The score of given pairs, null where there is none."""
    return pairs.join(scores.select(*PAIR, score), PAIR, "left")


def global_rank(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """The rows with their position from 0 in a stated order, which must be total.

    Positions need one global order: the rows are range-partitioned and numbered inside their
    range, the range starts come from the counts per range.
    """
    from matchloom.session import Scratch

    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n_parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "positions").put("ranged", ranged)
    w = Window.partitionBy("_part").orderBy(*order)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.withColumn("_at", F.row_number().over(w))
    # one row per range: as many as shuffle partitions
    out = numbered.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn(name, (F.col("_start") + F.col("_at") - 1).cast("long"))
    return out.drop("_part", "_start", "_at")


def positional_ids(records: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """``(id, position)`` from 0 in a stated order."""
    return global_rank(records.select(id_col, *[c for c in order if c != id_col]), order).select(id_col, "position")


def translate(pairs: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Pairs with both ids replaced; pairs with an id that the mapping lacks are dropped."""
    l = mapping.select(F.col(old).alias("lid"), F.col(new).alias("_l"))
    r = mapping.select(F.col(old).alias("rid"), F.col(new).alias("_r"))
    out = pairs.join(l, "lid").join(r, "rid")
    return out.select(F.col("_l").alias("lid"), F.col("_r").alias("rid"), *[c for c in pairs.columns if c not in PAIR])


def accumulate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables, one row per pair; a pair already known keeps its old row."""
    u = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rest = sorted(c for c in u.columns if c not in ("lid", "rid", "_p"))
    return first_per_pair(u, [F.col("_p"), *[F.asc_nulls_last(c) for c in rest]]).drop("_p")


def from_log(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Predictions of a scorer's log, with the match type of the candidates (inner join)."""
    p = log.select(F.col("lids").alias("lid"), F.col("rids").alias("rid"), F.col("prediction_proba").alias("prob"))
    return p.join(candidates.select(*PAIR, "match_type"), PAIR)


def apply_checks(preds: DataFrame, rescored: DataFrame | None = None) -> DataFrame:
    """prob := manual_check_label where checked; else the new score, where there is one."""
    p = preds if rescored is None else preds.join(rescored.select(*PAIR, F.col("prob").alias("_new")), PAIR, "left")
    prob = F.when(F.col("manual_check_label") >= 0, F.col("manual_check_label").cast("double"))
    prob = prob.otherwise(F.coalesce(F.col("_new"), F.col("prob")) if rescored is not None else F.col("prob"))
    return p.withColumn("prob", prob).drop("_new")
