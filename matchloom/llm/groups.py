"""Problem 1: consolidating pairwise matches into groups by Hash-to-Min.

Every vertex v keeps a cluster set C(v), at first its neighbours.  In a round v sends
C(v) to the smallest member m of C(v) + {v}, and m to every other member.  The sets are
kept as rows (v, u), never as arrays, so the set of one giant group is spread over all
tasks.  The rounds end when every group is a star around its smallest member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.skew import hot_keys, sliced_join
from matchloom.session import Scratch


def match_edges(matches: DataFrame, threshold: float, lid: str = "lid", rid: str = "rid", prob: str = "prob") -> DataFrame:
    """Distinct undirected edges (a < b) of the rows with ``prob`` above the threshold.

    Rows with a null end, a null ``prob`` or equal ends give no edge; order of the ends
    and repetition of a pair do not matter; a NaN ``prob`` gives no edge.
    """
    x = matches.select(F.col(lid).cast("long").alias("l"), F.col(rid).cast("long").alias("r"), F.col(prob).alias("p"))
    return (
        x.where((F.col("p") > threshold) & ~F.isnan("p") & (F.col("l") != F.col("r")))
        .select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
        .distinct()
    )


def hash_to_min(edges: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """``(id, group_id)`` for every end of ``edges`` (a, b); ``group_id`` is the group's smallest id.

    Empty input gives an empty result; null ends and loops are ignored; repeated edges
    count once.  Vertices with very many members (hot) meet their minimum by a broadcast of
    at most 500 rows instead of a shuffle, so no task receives a whole giant group.
    The rounds go on until every group is a star; every one brings minima nearer, and their count grows
    with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "hash-to-min")
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where(F.col("a") != F.col("b"))
    sets = scratch.put("sets", e.select("a", "b").union(e.select("b", "a")).toDF("v", "u").distinct())
    while True:
        # partial aggregation runs before the shuffle, so a hot v costs one row per task
        mins = scratch.put(
            "mins",
            sets.groupBy("v").agg(F.min("u").alias("u"), F.count(F.lit(1)).alias("n")).select("v", F.least("v", "u").alias("m"), "n"),
        )
        if mins.where((F.col("m") < F.col("v")) & (F.col("n") > 1)).isEmpty():
            return mins.select(F.col("v").alias("id"), F.col("m").alias("group_id"))
        sets = scratch.put("sets", _round(sets, mins, hot_rows))


def _round(sets: DataFrame, mins: DataFrame, hot_rows: int) -> DataFrame:
    hot = hot_keys(mins, "v", "n", hot_rows)
    told = mins.select("v", "m")
    if hot:
        is_hot = F.col("v").isin(hot)
        seen = sets.where(~is_hot).join(told.where(~is_hot), "v").unionByName(
            sets.where(is_hot).join(F.broadcast(told.where(is_hot)), "v")
        )
    else:
        seen = sets.join(told, "v")
    # v itself belongs to its set: v <-> m as well as u <-> m for every member u
    own = told.where(F.col("v") != F.col("m"))
    pairs = seen.where(F.col("u") != F.col("m")).select("u", "m").union(own.select("v", "m")).toDF("v", "u")
    both = pairs.union(pairs.select("u", "v"))
    return both.distinct()


def consolidate(matches: DataFrame, threshold: float = 0.999, hot_rows: int = 100_000) -> DataFrame:
    """``(id, group_id)``: one group identifier for all records linked directly or through others.

    Extra columns of ``matches`` are ignored whatever their names; see :func:`match_edges`
    for nulls, loops and repeated pairs.
    """
    return hash_to_min(match_edges(matches, threshold), hot_rows=hot_rows)


def group_pairs(groups: DataFrame, lid: str = "lid", rid: str = "rid") -> DataFrame:
    """``(lid, rid)``, lid < rid: all pairs of different ids of one group of ``(id, group_id)``, for results that are stated in pairs.

    The rows of ``groups`` (``hash_to_min``, ``key_groups``) hold the same in one row an id.  Members of a
    large group are cut into slices, so that no task has more than a slice times the group.
    """
    g = Scratch(groups.sparkSession, "pairs").put("groups", groups.select("group_id", "id"))
    a, b = g.select("group_id", F.col("id").alias(lid)), g.select("group_id", F.col("id").alias(rid))
    return sliced_join(a, b, ["group_id"], rid).where(F.col(lid) < F.col(rid)).select(lid, rid)
