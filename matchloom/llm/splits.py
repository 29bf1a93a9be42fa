"""Problem 4: train/validation/test splits that keep related records together.

Keys (an author, source or entity) are related when they share a record, directly or
through further keys.  Groups of related keys come from a distributed union-find: every
task runs union-find over its own edges and hands on only the forest it found; forests are
merged in ever fewer tasks, and what is too large for one task is finished by star rounds.
Whole groups are then given, largest first, to the split furthest below its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.skew import lookup_join, spread_rank
from matchloom.operators.graph import components
from matchloom.llm.groups import group_pairs
from matchloom.session import Scratch


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(root, node)`` of every node of the edges that is not a root; roots are the smallest nodes.

    Union-find on arrays: every edge hooks the larger root of its ends under the smaller one,
    all at once, and the trees are halved until they are flat.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        rx, ry = up[x], up[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = low < high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(up, high[open_], low[open_])
        while not np.array_equal(flat := up[up], up):
            up = flat
    under = up < np.arange(len(nodes))
    return nodes[up[under]], nodes[under]


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest ``(a, b)``, root and node, of the edges (a, b) of one task; fewer rows than the task has nodes."""
    parts = [(b["a"].to_numpy(np.int64), b["b"].to_numpy(np.int64)) for b in batches if len(b)]
    if not parts:
        return
    roots, nodes = forest_of(*[np.concatenate(x) for x in zip(*parts)])
    for at in range(0, len(nodes), 50_000):
        yield pd.DataFrame({"a": roots[at : at + 50_000], "b": nodes[at : at + 50_000]})


def union_find(edges: DataFrame, rows_per_task: int = 2_000_000, fan_in: int = 4) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b: long); root is the component's smallest node.

    The edges are spread evenly over tasks of at most about ``rows_per_task`` rows (``fan_in`` of
    them at least); every level merges the forests in ``fan_in`` times fewer tasks.  The rows of a node,
    at most one from each forest, meet in one task; the rows of a root need not, so a giant
    group is spread over all tasks.  A last forest of more than ``rows_per_task`` rows is not sent to
    one task: star rounds over its rows, flat trees already, join what is left.  Null ends and loops are ignored.
    """
    scratch = Scratch(edges.sparkSession, "union-find")
    e = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    forest = scratch.put("forest", e.where(F.col("a") < F.col("b")).distinct())
    tasks, spread = max(fan_in, -(-forest.count() // rows_per_task)), ["a", "b"]
    while True:
        forest = scratch.put("forest", forest.repartition(tasks, *spread).mapInPandas(local_forest, "a long, b long").distinct())
        if tasks == 1:
            break
        least = -(-forest.count() // rows_per_task)
        fewer = max(least, tasks // fan_in, 1)
        if fewer >= tasks or (least > 1 and spread == ["b"]):
            members = components(forest.select(F.col("a").alias("lid"), F.col("b").alias("rid")))
            return members.select(F.col("id").alias("node"), F.col("component_id").alias("root"))
        tasks, spread = fewer, ["b"]
    roots = forest.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    return forest.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def key_groups(rows: DataFrame, key: str, record: list[str]) -> DataFrame:
    """``(key, group)`` for every non-null key of ``rows``; keys sharing a record share the group.

    ``group`` is the smallest key (as a string) of the group.  A record is the tuple of its
    columns; a record with a null part links nothing.  Keys are numbered by a 64-bit hash
    for the union-find; the chance of two of a billion keys meeting is below 3 percent, and
    keys of one record meet through their smallest key, so a record with very many keys
    costs one edge a key.
    """
    whole = F.lit(True)
    for c in record:
        whole = whole & F.col(c).isNotNull()
    pairs = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.xxhash64(F.col(key).cast("string")).alias("node"), F.when(whole, F.md5(F.to_json(F.struct(*record)))).alias("rec")
    )
    scratch = Scratch(rows.sparkSession, "keys")
    pairs = scratch.put("pairs", pairs.distinct())
    keys = pairs.select("key", "node").distinct()
    links = pairs.where("rec is not null").select("rec", "node")
    least = scratch.put("least", links.groupBy("rec").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    edges = lookup_join(links, least, "rec", "n").select("a", F.col("node").alias("b")).where("a < b")
    roots = union_find(edges)
    named = scratch.put("named", keys.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")))
    name = scratch.put("names", named.groupBy("root").agg(F.min("key").alias("group"), F.count(F.lit(1)).alias("n")))
    return lookup_join(named, name, "root", "n").select("key", "group")


def greedy_shares(sizes: list[tuple[int, int]], parts: dict[str, float]) -> dict[int, list[int]]:
    """Largest-first greedy over (size, how many groups): of each size, how many groups every split gets.

    Each step of the greedy gives the next group to the split furthest below its target; ties go
    to the split named first.  Groups of one size are interchangeable, so only their number per split
    counts: they lower the largest gaps to one common level, which is found by one division.
    The few groups left by rounding down follow one by one.
    """
    total = sum(s * n for s, n in sizes)
    names = list(parts)
    gap = [parts[k] * total for k in names]
    out: dict[int, list[int]] = {}
    for size, n in sorted(sizes, reverse=True):
        top = sorted(range(len(names)), key=lambda k: -gap[k])
        level = -np.inf
        for j in range(1, len(top) + 1):
            level = (sum(gap[k] for k in top[:j]) - n * size) / j
            if j == len(top) or level >= gap[top[j]]:
                break
        take = [max(0, int((gap[k] - level) // size) - 1) for k in range(len(names))]
        for k in range(len(names)):
            gap[k] -= take[k] * size
        for _ in range(n - sum(take)):
            best = max(range(len(names)), key=lambda k: gap[k])
            gap[best] -= size
            take[best] += 1
        out[size] = take
    return out


def assign_splits(
    rows: DataFrame, key: str, record: list[str], parts: dict[str, float] | None = None, salts: int = 64
) -> DataFrame:
    """``(key, group, n_rows, split)``: every key with its rows' split, related keys together.

    ``parts`` gives the proportions of the rows (60/20/20 by default).  Only the histogram of
    group sizes (distinct sizes, fewer than the square root of twice the rows) comes to the
    driver, and the plan has one entry a size.  Null keys get no row; empty input gives an empty result; repeated rows count as
    rows, since the proportions are those of the rows.
    """
    parts = parts or {"train": 0.6, "validation": 0.2, "test": 0.2}
    spark = rows.sparkSession
    scratch = Scratch(spark, "splits")
    groups = scratch.put("groups", key_groups(rows, key, record))
    n = rows.select(F.col(key).cast("string").alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = scratch.put("keyed", groups.join(n, "key"))
    scratch.drop("groups")
    sizes = scratch.put("sizes", keyed.groupBy("group").agg(F.sum("n_rows").alias("size"), F.count(F.lit(1)).alias("n")))
    hist = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = greedy_shares(list(hist.items()), parts)
    cuts = [(size, hist[size], *np.cumsum(take).tolist()) for size, take in shares.items()]
    ends = [f"end_{i}" for i in range(len(parts))]
    table = scratch.put("shares", spark.createDataFrame(cuts, "size long, n long, " + ", ".join(f"{c} long" for c in ends)))
    salts = max(salts, sum(hist.values()) // 500_000)
    ranked = spread_rank(sizes.select("group", "size"), ["size"], [F.col("group")], "rank", F.col("group"), int(salts))
    split: Column = F.lit(list(parts)[-1])
    for name, end in reversed(list(zip(parts, ends))):
        split = F.when(F.col("rank") <= F.col(end), name).otherwise(split)
    placed = lookup_join(ranked, table, "size", "n").select("group", split.alias("split"))
    table = scratch.put("placed", sizes.select("group", "n").join(placed, "group"))
    return lookup_join(keyed, table, "group", "n").select("key", "group", "n_rows", "split")


def related_keys(groups: DataFrame) -> DataFrame:
    """``(key_a, key_b)``, key_a < key_b: all pairs of different keys of one group of ``(key, group)``."""
    return group_pairs(groups.select(F.col("group").alias("group_id"), F.col("key").alias("id")), "key_a", "key_b")
