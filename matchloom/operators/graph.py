"""The match graph: edges, components, transitive pairs, cuts and paths."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.skew import hot_keys
from matchloom.operators.pairs import PAIR, dedupe_predictions, distinct_pairs
from matchloom.schema import COMPONENT_CAP, MATCH_THRESHOLD
from matchloom.session import Scratch


def match_graph(preds: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Undirected edges with prob > threshold, one per pair, attributes kept."""
    return dedupe_predictions(preds.where(F.col("prob") > threshold))


#: Graphs of at most this many distinct edges are solved in one task (two arrays of 8 bytes an edge); the result is the same.
ONE_TASK_EDGES = 5_000_000


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(id, component_id)`` of the edges of one task: roots are hooked to smaller roots and paths halved until every edge is inside one tree."""
    parts = [b[PAIR].to_numpy(np.int64) for b in batches]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    up = np.arange(len(ids))
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (above := up[up])).any():
            up = above
    yield pd.DataFrame({"id": ids, "component_id": ids[up]})


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(id, component_id)`` of every end of an edge; component_id is the smallest id.

    Small graphs are solved in one task.  Else large-star and small-star rounds in turn over edge rows, so no node's neighbourhood is ever
    collected; each round's edges are written to the shared folder.  Ends when the edges are a flat
    forest, after rounds that grow with the square of the logarithm of the nodes at most.  Nodes with very many neighbours find their minimum by a broadcast of at most 500 rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    e = scratch.put("edges", distinct_pairs(edges))
    if e.count() <= one_task_edges:
        return e.coalesce(1).mapInPandas(_union_find, "id long, component_id long")
    while True:
        # large star: every neighbour above v meets the smallest of v and its neighbours
        both = e.select(F.col("lid").alias("v"), F.col("rid").alias("u")).unionByName(e.select(F.col("rid").alias("v"), F.col("lid").alias("u")))
        large = scratch.put("large", _star(both, scratch).where("u > v").select(F.col("m").alias("lid"), F.col("u").alias("rid")).where("lid <> rid").distinct())
        # small star: every neighbour below v, and v, meet the smallest neighbour below v
        down = large.select(F.col("rid").alias("v"), F.col("lid").alias("u"))
        starred = _star(down, scratch)
        small = starred.select(F.col("m").alias("lid"), F.col("u").alias("rid")).unionByName(starred.select(F.col("m").alias("lid"), F.col("v").alias("rid")))
        new = scratch.put("edges", small.where("lid <> rid").distinct())
        # a stable forest: every node has one parent and no parent has a parent
        loose = new.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = new.select(F.col("lid").alias("x")).join(new.select(F.col("rid").alias("x")), "x", "left_semi")
        e = new
        if loose.isEmpty() and chained.isEmpty():
            roots = new.select(F.col("lid").alias("id")).distinct()
            return new.select(F.col("rid").alias("id"), F.col("lid").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id")))


def _star(both: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds m, the smallest of v and its neighbours, to every (v, u)."""
    mins = scratch.put("mins", both.groupBy("v").agg(F.min("u").alias("least"), F.count(F.lit(1)).alias("n")).select("v", F.least("v", "least").alias("m"), "n"))
    hot = hot_keys(mins, "v", "n")
    if not hot:
        return both.join(mins.select("v", "m"), "v")
    is_hot = F.col("v").isin(hot)
    return both.where(~is_hot).join(mins.where(~is_hot).select("v", "m"), "v").unionByName(both.where(is_hot).join(F.broadcast(mins.where(is_hot).select("v", "m")), "v"))


def per_component(rows: DataFrame):
    """Rows grouped by component for Python, over all cores: by their few bytes Spark would put them into one task."""
    spark = rows.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "component_id").groupBy("component_id")


def component_sizes(members: DataFrame) -> DataFrame:
    """``(component_id, size)``."""
    return members.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))


def components_by_size(members: DataFrame) -> DataFrame:
    """Components, largest first, then by id."""
    return component_sizes(members).orderBy(F.desc("size"), "component_id")


def transitive_pairs(edges: DataFrame, members: DataFrame, most: int | None = COMPONENT_CAP, exclusive: bool = False) -> DataFrame:
    """``(lid, rid, match_type)``: pairs of one component without an edge of their own.

    Components larger than ``most`` (with ``exclusive`` those of size ``most`` too) are skipped;
    None means no cap.  The join grows with the square of component sizes, so a cap is the rule.
    """
    m = members
    if most is not None:
        fits = F.col("size") < most if exclusive else F.col("size") <= most
        m = m.join(component_sizes(members).where(fits & (F.col("size") > 2)).select("component_id"), "component_id", "left_semi")
    a = m.select("component_id", F.col("id").alias("lid"))
    b = m.select("component_id", F.col("id").alias("rid"))
    pairs = a.join(b, "component_id").where("lid < rid").select(*PAIR)
    return pairs.join(distinct_pairs(edges), PAIR, "left_anti").withColumn("match_type", F.lit("transitive_match"))


def big_components(members: DataFrame, most: int = COMPONENT_CAP) -> DataFrame:
    """Sizes of the components that the closure skips."""
    return component_sizes(members).where(F.col("size") > most)


def sampled_members(members: DataFrame, most: int = COMPONENT_CAP, seed: int = 42) -> DataFrame:
    """At most ``most`` nodes of every component, by a hash of node and seed (the sampling operator)."""
    w = Window.partitionBy("component_id").orderBy(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), "id")
    return members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def augmented_graph(edges: DataFrame, members: DataFrame, most: int | None = COMPONENT_CAP) -> DataFrame:
    """Edges and, with prob 0, the transitive pairs of components up to the cap."""
    t = transitive_pairs(edges, members, most).withColumn("prob", F.lit(0.0))
    return edges.select(*PAIR, "prob", "match_type").unionByName(t.select(*PAIR, "prob", "match_type"))


def edges_of(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with the component they belong to."""
    return edges.join(members.select(F.col("id").alias("lid"), "component_id"), "lid")


def inside_components(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with both ends in one component, with that component."""
    l = members.select(F.col("id").alias("lid"), "component_id")
    r = members.select(F.col("id").alias("rid"), F.col("component_id").alias("_c"))
    return pairs.join(l, "lid").join(r, "rid").where(F.col("component_id") == F.col("_c")).drop("_c")


def transitive_votes(scored: DataFrame, members: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """``(component_id, negative, positive)`` of scored transitive pairs; components without any are absent."""
    return (
        inside_components(scored, members)
        .groupBy("component_id")
        .agg(F.count(F.when(F.col("prob") < threshold, 1)).alias("negative"), F.count(F.when(F.col("prob") >= threshold, 1)).alias("positive"))
    )


def truncate_large(preds: DataFrame, members: DataFrame, threshold: float = MATCH_THRESHOLD, most: int = COMPONENT_CAP) -> DataFrame:
    """prob := 0 for all graph edges of components larger than ``most``; rows at the threshold stay."""
    big = members.join(big_components(members, most).select("component_id"), "component_id", "left_semi").select(F.col("id").alias("lid"), F.lit(True).alias("_big"))
    hit = F.coalesce("_big", F.lit(False)) & (F.col("prob") > threshold)
    return preds.join(big, "lid", "left").withColumn("prob", F.when(hit, 0.0).otherwise(F.col("prob"))).drop("_big").select(*preds.columns)


def _max_flow(adj: dict, s, t, most: int | None = None) -> tuple[int, set]:
    """Unit-capacity flow from s to t and the nodes that s still reaches; the search ends at a flow of ``most``."""
    flow: dict = {}
    value = 0
    while value != most:
        before = {s: None}
        queue = deque([s])
        while queue and t not in before:
            u = queue.popleft()
            for v in adj[u]:
                if v not in before and flow.get((u, v), 0) < 1:
                    before[v] = u
                    queue.append(v)
        if t not in before:
            return value, set(before)
        v = t
        while before[v] is not None:
            u = before[v]
            flow[(u, v)] = flow.get((u, v), 0) + 1
            flow[(v, u)] = flow.get((v, u), 0) - 1
            v = u
        value += 1
    return value, set()


def _bridge_cut(adj: dict, s) -> tuple | None:
    """The first bridge on the way from s to the smallest node behind one; None if there is no bridge."""
    at, low, first, order = {s: 0}, {s: 0}, {s: None}, [s]
    stack = [(s, None, iter(adj[s]))]
    above: dict = {s: None}
    while stack:
        u, p, rest = stack[-1]
        for v in rest:
            if v not in at:
                at[v] = low[v] = len(order)
                above[v] = u
                order.append(v)
                stack.append((v, u, iter(adj[v])))
                break
            if v != p:
                low[u] = min(low[u], at[v])
        else:
            stack.pop()
            if p is not None:
                low[p] = min(low[p], low[u])
    for v in order[1:]:
        u = above[v]
        first[v] = first[u] or ((u, v) if low[v] > at[u] else None)
    behind = [v for v in order if first[v]]
    return first[min(behind)] if behind else None


def minimum_cut(edges: list[tuple]) -> list[tuple]:
    """The canonical minimum edge cut of a connected graph.

    s is the smallest node, the value is the least max-flow to any other node, t the smallest node
    that attains it; the cut is what leaves the side that s still reaches.  A cut of one edge is a bridge and found in
    one walk; else a flow that reaches the best value so far is not followed further, and a node with as many edges to
    nodes that no smaller cut parts from s can't be parted by one either and needs no flow.
    """
    adj: dict = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    if len({(min(a, b), max(a, b)) for a, b in edges}) == len(edges) and (cut := _bridge_cut(adj, min(adj))):
        return [(min(cut), max(cut))]
    nodes = sorted(adj)
    best, side = None, set()
    near, ties = set(), dict.fromkeys(nodes, 0)

    def hold(fresh: list) -> None:
        while fresh:
            if (u := fresh.pop()) not in near:
                near.add(u)
                for v in adj[u]:
                    ties[v] += 1
                    if ties[v] >= best and v not in near:
                        fresh.append(v)

    for t in nodes[1:]:
        if t in near:
            continue
        value, reach = _max_flow(adj, nodes[0], t, best)
        if best is None or value < best:
            best, side = value, reach
            hold([nodes[0], t])
            hold([v for v in nodes if ties[v] >= best])
        else:
            hold([t])
    return sorted((min(a, b), max(a, b)) for a, b in edges if (a in side) != (b in side))


def minimum_cuts(edges: DataFrame, members: DataFrame, most: int | None = COMPONENT_CAP) -> DataFrame:
    """``(component_id, lid, rid)``: the canonical minimum cut of every component of at most ``most`` nodes; None means no cap.

    The cap bounds each group (at most most x (most - 1) / 2 edges), so a group fits one task; without it a task holds the edges of a component.
    """
    own = edges_of(edges.select(*PAIR), members)
    if most is not None:
        own = own.join(component_sizes(members).where(F.col("size") <= most).select("component_id"), "component_id", "left_semi")

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        found = minimum_cut(list(zip(g["lid"].tolist(), g["rid"].tolist())))
        return pd.DataFrame({"component_id": [g["component_id"].iloc[0]] * len(found), "lid": [a for a, _ in found], "rid": [b for _, b in found]})

    return per_component(own).applyInPandas(cut, "component_id long, lid long, rid long")


def least_path(edges: list[tuple], a, b) -> list[tuple]:
    """Edges of the shortest path from a to b that is smallest as a sequence of nodes; empty if there is none."""
    adj: dict = {}
    for x, y in edges:
        adj.setdefault(x, []).append(y)
        adj.setdefault(y, []).append(x)
    if a not in adj or b not in adj:
        return []
    dist = {b: 0}
    queue = deque([b])
    while queue:
        u = queue.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    if a not in dist:
        return []
    out, at = [], a
    while at != b:
        nxt = min(v for v in adj[at] if dist.get(v, -1) == dist[at] - 1)
        out.append((min(at, nxt), max(at, nxt)))
        at = nxt
    return out


def shortest_paths(edges: DataFrame, members: DataFrame, wanted: DataFrame, most: int = COMPONENT_CAP) -> DataFrame:
    """``(component_id, src, dst, step, lid, rid)``: the least shortest path of every wanted pair in a capped component."""
    fits = component_sizes(members).where(F.col("size") <= most).select("component_id")
    own = edges_of(edges.select(*PAIR), members).join(fits, "component_id", "left_semi").withColumn("want", F.lit(False))
    ask = inside_components(distinct_pairs(wanted), members).join(fits, "component_id", "left_semi").withColumn("want", F.lit(True))
    both = own.select("component_id", *PAIR, "want").unionByName(ask.select("component_id", *PAIR, "want"))

    def paths(g: pd.DataFrame) -> pd.DataFrame:
        es = list(zip(*[g.loc[~g["want"], c].tolist() for c in PAIR]))
        rows = []
        for a, b in sorted(zip(*[g.loc[g["want"], c].tolist() for c in PAIR])):
            rows += [(g["component_id"].iloc[0], a, b, i, x, y) for i, (x, y) in enumerate(least_path(es, a, b))]
        return pd.DataFrame(rows, columns=["component_id", "src", "dst", "step", "lid", "rid"])

    return per_component(both).applyInPandas(paths, "component_id long, src long, dst long, step int, lid long, rid long")
