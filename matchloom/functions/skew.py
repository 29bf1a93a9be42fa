"""Joins and ranks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import Scratch

#: No more than this many keys are ever treated as hot: a key is hot when it holds
#: at least 1/HOT_KEYS of all rows, so there cannot be more of them.
HOT_KEYS = 500
#: Below this many rows a key is never worth special treatment.
HOT_ROWS = 100_000


def hot_keys(counts: DataFrame, key: str, n: str, least: int = HOT_ROWS) -> list:
    """Keys of ``counts`` (one row per key) holding 1/HOT_KEYS of all rows or more; at most HOT_KEYS."""
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    bound = max(least, total // HOT_KEYS)
    if total < bound:
        return []
    return [r[0] for r in counts.where(F.col(n) > bound).select(key).collect()]


def lookup_join(rows: DataFrame, table: DataFrame, key: str, n: str, least: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key, ``n`` = rows of that key).

    Rows of hot keys meet a broadcast of at most HOT_KEYS table rows and are not
    shuffled at all; the others take an ordinary shuffle join.  ``table`` is read
    twice, so it should be a written table.
    """
    hot = hot_keys(table, key, n, least)
    if not hot:
        return rows.join(table.drop(n), key)
    is_hot = F.col(key).isin(hot)
    cold = rows.where(~is_hot).join(table.where(~is_hot).drop(n), key)
    warm = rows.where(is_hot).join(F.broadcast(table.where(is_hot).drop(n)), key)
    return cold.unionByName(warm)


#: Rows of a key on the sliced side of a join that one slice takes.
SLICE_ROWS = 2_000


def sliced_join(left: DataFrame, right: DataFrame, keys: list[str], slice_on: str, slice_rows: int = SLICE_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Inner join for keys that meet many rows on both sides.

    The right rows of a key are cut by a hash of ``slice_on`` into slices of about ``slice_rows``; its left rows
    go to every slice.  A task has a slice of a key, not the whole product.  Both sides are read
    twice, so they should be written tables.  The sliced keys, at most (right rows) / ``slice_rows``, are written, so
    that Spark knows their size and broadcasts them only where that is small.
    """
    many = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("_slices")).where("_slices > 1")
    many = (scratch or Scratch(right.sparkSession, "slices")).put("many", many)
    if many.isEmpty():
        return left.join(right, keys)
    n = F.coalesce("_slices", F.lit(1))
    spread = right.join(many, keys, "left").withColumn("_slice", F.pmod(F.xxhash64(slice_on), n).cast("int")).drop("_slices")
    copied = left.join(many, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), n - 1))).drop("_slices")
    return copied.join(spread, [*keys, "_slice"]).drop("_slice")


def spread_rank(
    df: DataFrame, group: list[str], order: list[Column], name: str, salt_on: Column, salts: int
) -> DataFrame:
    """Number the rows of each group 1..n without one task ever holding a whole group.

    Each group is cut into ``salts`` slices by a hash of ``salt_on``; rows are numbered
    inside their slice and the slice starts come from a running sum over slice counts
    (one row per group and slice).  The numbering is fixed by the data alone, so lost
    tasks can be run again.
    """
    df = df.withColumn("_slice", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    counts = df.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    ranked = df.withColumn("_at", F.row_number().over(inside))
    joined = ranked.join(starts, [*group, "_slice"])
    return joined.withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_slice", "_start", "_at")
