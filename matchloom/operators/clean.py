"""Removing false matches where the scorer contradicts the closure of its own matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.graph import (
    big_components, component_sizes, components, edges_of, inside_components, match_graph, minimum_cut, minimum_cuts, per_component, shortest_paths, transitive_pairs, transitive_votes,
)
from matchloom.operators.labeling import oracle_label
from matchloom.operators.pairs import PAIR, apply_checks, distinct_pairs, first_per_pair
from matchloom.operators.scoring import TokenScorer, token_sets
from matchloom.schema import COMPONENT_CAP, MATCH_THRESHOLD
from matchloom.session import Scratch


def zero_pairs(preds: DataFrame, pairs: DataFrame) -> DataFrame:
    """prob := 0 on the given pairs that nobody checked."""
    hit = distinct_pairs(pairs).withColumn("_z", F.lit(True))
    prob = F.when(F.coalesce("_z", F.lit(False)) & (F.coalesce("manual_check_label", F.lit(-1)) < 0), 0.0).otherwise(F.col("prob"))
    return preds.join(hit, PAIR, "left").withColumn("prob", prob).drop("_z").select(*preds.columns)


def label_edges_of(preds: DataFrame, members: DataFrame, chosen: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Every unchecked edge of the chosen components gets its label, and prob := label."""
    edges = preds.where(F.col("prob") > threshold)
    own = edges_of(edges.select(*PAIR), members).join(chosen.select("component_id").distinct(), "component_id", "left_semi").select(*PAIR, F.lit(True).alias("_c"))
    hit = F.coalesce("_c", F.lit(False)) & (F.coalesce("manual_check_label", F.lit(-1)) < 0) & F.col("label").isNotNull()
    out = preds.join(own.distinct(), PAIR, "left")
    return out.withColumns({"manual_check_label": F.when(hit, F.col("label")).otherwise(F.col("manual_check_label")).cast("int"), "prob": F.when(hit, F.col("label").cast("double")).otherwise(F.col("prob"))}).drop("_c").select(*preds.columns)


def select_edges(preds: DataFrame, scored: DataFrame, members: DataFrame, budget: int, threshold: float = MATCH_THRESHOLD, sampled: int = 10, seed: int = 42, most: int = COMPONENT_CAP) -> DataFrame:
    """``(component_id, lid, rid, place)``: the edges to label first, at most ``budget`` (a budgeted report).

    Components with a negative transitive prediction, most negatives first; of each the minimum cut
    and the shortest paths between up to ``sampled`` negative pairs taken by hash; an edge counts once.
    """
    edges = match_graph(preds, threshold)
    votes = transitive_votes(scored, members, threshold).where("negative > 0")
    own = members.join(votes.select("component_id"), "component_id", "left_semi")
    cut = minimum_cuts(edges, own, most).select("component_id", *PAIR, F.lit(0).alias("kind"), F.lit("").alias("h"), F.lit(0).alias("step"))
    h = F.md5(F.concat_ws("-", F.col("lid").cast("string"), F.col("rid").cast("string"), F.lit(str(seed))))
    negatives = inside_components(scored.where(F.col("prob") < threshold), own).withColumn("h", h)
    w = Window.partitionBy("component_id").orderBy("h", *PAIR)
    taken = negatives.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sampled)
    paths = shortest_paths(edges, own, taken, most)
    on = [F.col("src") == F.col("_s"), F.col("dst") == F.col("_d")]
    paths = paths.join(taken.select(F.col("lid").alias("_s"), F.col("rid").alias("_d"), "h"), on).select("component_id", *PAIR, F.lit(1).alias("kind"), "h", "step")
    every = first_per_pair(cut.unionByName(paths), [F.col("kind"), F.col("h"), F.col("step")], ["component_id", *PAIR])
    order = Window.orderBy(F.desc("negative"), "component_id", "kind", "h", "step", *PAIR)
    ordered = [F.desc("negative"), F.col("component_id"), F.col("kind"), F.col("h"), F.col("step"), F.col("lid"), F.col("rid")]
    # the limit is the labelling budget itself; only so many rows are ever numbered in one task
    top = every.join(votes, "component_id").orderBy(*ordered).limit(budget)
    return top.withColumn("place", F.row_number().over(order)).select("component_id", *PAIR, "place")


def update_predictions(preds: DataFrame, scored: DataFrame, members: DataFrame, threshold: float = MATCH_THRESHOLD, most: int = COMPONENT_CAP) -> DataFrame:
    """Components with any negative transitive prediction lose their unchecked cut edges; checked rows take their label."""
    bad = members.join(transitive_votes(scored, members, threshold).where("negative > 0").select("component_id"), "component_id", "left_semi")
    return apply_checks(zero_pairs(preds, minimum_cuts(match_graph(preds, threshold), bad, most)))


def _pieces(nodes: list, edges: list[tuple]) -> list[list]:
    """Node lists of the components of a graph."""
    adj: dict = {n: [] for n in nodes}
    for a, b in edges:
        adj[a].append(b)
        adj[b].append(a)
    seen, out = set(), []
    for n in nodes:
        if n not in seen:
            seen.add(n)
            part = [n]
            for u in part:
                for v in adj[u]:
                    if v not in seen:
                        seen.add(v)
                        part.append(v)
            out.append(part)
    return out


def settle(edges: list[tuple], checked: set, votes) -> list[tuple]:
    """The edges that the fixpoint of :func:`post_cleanup` deletes from one component.

    ``votes`` gives the counter of a list of nodes: it has ``negative``, ``positive`` and ``split(pieces)``, which
    gives the counters of the pieces that the nodes fell into.
    """
    gone, work = [], []
    nodes = sorted({n for e in edges for n in e})
    work.append((edges, votes(nodes)))
    while work:
        edges, count = work.pop()
        if not edges or count.negative <= count.positive:
            continue
        cut = {e for e in minimum_cut(edges) if e not in checked}
        if not cut:
            continue
        gone += cut
        edges = [e for e in edges if e not in cut]
        parts = _pieces(count.nodes, edges)
        if len(parts) == 1:
            work.append((edges, count))
            continue
        of = {n: i for i, p in enumerate(parts) for n in p}
        own: list[list] = [[] for _ in parts]
        for e in edges:
            own[of[e[0]]].append(e)
        work += zip(own, count.split(parts))
    return gone


class GivenVotes:
    """Counts scored transitive pairs inside a list of nodes."""

    def __init__(self, nodes: list, l: np.ndarray, r: np.ndarray, low: np.ndarray):
        self.nodes = nodes
        inside = np.isin(l, nodes) & np.isin(r, nodes)
        self.l, self.r, self.low = l[inside], r[inside], low[inside]
        self.negative = int(self.low.sum())
        self.positive = len(self.low) - self.negative

    def split(self, parts: list[list]) -> list[GivenVotes]:
        return [GivenVotes(p, self.l, self.r, self.low) for p in parts]


class WordPairs:
    """Which pairs of one component share so many words that their similarity reaches ``cut``; nodes without a record have no score."""

    #: Different word sets of which all pairs are kept (one byte each); else a block is computed when it is asked for.
    KEPT = 12_000

    def __init__(self, words: dict, edges: list[tuple], cut: float, measure: str):
        self.cut, self.measure, self.edges = cut, measure, edges
        kinds: dict = {}
        self.kind = {n: kinds.setdefault(tuple(sorted(w)), len(kinds)) for n, w in words.items()}
        self.size = np.array([len(k) for k in kinds], dtype=np.float32)
        ids: dict = {}
        self.held = [np.array([ids.setdefault(w, len(ids)) for w in k], dtype=np.int64) for k in kinds]
        self.by_word = [[] for _ in ids]
        for k, ws in enumerate(self.held):
            for w in ws:
                self.by_word[w].append(k)
        self.by_word = [np.array(x) for x in self.by_word]
        every = np.arange(len(kinds))
        self.all = np.array([self._row(k) for k in every], dtype=bool).reshape(len(kinds), len(kinds)) if len(kinds) <= self.KEPT else None
        self.agrees = {e: bool(self.row(self.kind[e[0]])[self.kind[e[1]]]) for e in edges if e[0] in self.kind and e[1] in self.kind}

    def _row(self, k: int) -> np.ndarray:
        shared = np.zeros(len(self.held), dtype=np.float64)
        for w in self.held[k]:
            shared[self.by_word[w]] += 1
        whole = self.size[k] + self.size - shared if self.measure == "jaccard" else np.minimum(self.size[k], self.size)
        return np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0) >= self.cut

    def row(self, k: int) -> np.ndarray:
        return self._row(k) if self.all is None else self.all[k]

    def between(self, a: np.ndarray, b: np.ndarray) -> int:
        """Ordered pairs (x of a, y of b) that agree; a and b hold how many nodes have each word set."""
        return sum(int(a[k]) * int(b[self.row(k)].sum()) for k in np.nonzero(a)[0])


class WordVotes:
    """Counts all pairs without an edge of their own inside a list of nodes, from the words of the nodes and without listing the pairs."""

    def __init__(self, pairs: WordPairs, nodes: list, agreeing: int | None = None):
        self.pairs, self.nodes = pairs, nodes
        self.hist = np.bincount([pairs.kind[n] for n in nodes if n in pairs.kind], minlength=len(pairs.size)).astype(np.int64)
        n = int(self.hist.sum())
        if agreeing is None:
            alone = int(sum(self.hist[k] for k in np.nonzero(self.hist)[0] if pairs.row(k)[k]))
            agreeing = (pairs.between(self.hist, self.hist) - alone) // 2
        self.agreeing = agreeing
        here = set(nodes)
        own = [y for (a, b), y in pairs.agrees.items() if a in here and b in here]
        self.positive = agreeing - sum(own)
        self.negative = n * (n - 1) // 2 - len(own) - self.positive

    def split(self, parts: list[list]) -> list[WordVotes]:
        """Only the smaller parts are counted anew; the rest of the pairs are the largest part's."""
        largest = max(range(len(parts)), key=lambda i: len(parts[i]))
        out = [None if i == largest else WordVotes(self.pairs, p) for i, p in enumerate(parts)]
        rest, left = self.agreeing, self.hist.copy()
        for x in out:
            if x is not None:
                left -= x.hist
                rest -= x.agreeing + self.pairs.between(x.hist, left)
        out[largest] = WordVotes(self.pairs, parts[largest], rest)
        return out


def _delete_settled(preds: DataFrame, rows: DataFrame, votes) -> DataFrame:
    """prob := 0 on what :func:`settle` deletes from each component of ``rows`` (component_id, kind 0 an edge, 1 a checked edge, else what ``votes`` reads)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        edge = g[g["kind"] <= 1]
        es = list(zip(edge["lid"].tolist(), edge["rid"].tolist()))
        gone = settle(sorted(es), {e for e, k in zip(es, edge["kind"].tolist()) if k == 1}, votes(g, es)) if es else []
        return pd.DataFrame(gone, columns=PAIR).astype("int64")

    return zero_pairs(preds, per_component(rows).applyInPandas(run, "lid long, rid long"))


def _edge_rows(preds: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, members, and the edges as rows of their component, kind 1 if checked."""
    edges = scratch.put("edges", match_graph(preds, threshold))
    members = scratch.put("members", components(edges))
    checked = (F.coalesce("manual_check_label", F.lit(-1)) >= 0).cast("int")
    return edges, members, edges_of(edges.select(*PAIR, checked.alias("kind")), members).select("component_id", "kind", *PAIR)


def post_cleanup(preds: DataFrame, scored: DataFrame, threshold: float = MATCH_THRESHOLD, most: int | None = COMPONENT_CAP) -> DataFrame:
    """Cuts components with more negative than positive transitive predictions until nothing is left to cut.

    Scores stay those given; only membership is computed anew.  A component of which all cut edges are
    checked is left alone, and each round deletes an edge, so the rounds end.  Components don't touch each other, so each of
    at most ``most`` nodes goes through its rounds in one task; larger ones are left alone (:func:`post_cleanup_whole` has no cap).
    """
    scratch = Scratch(preds.sparkSession, "post-cleanup", lean=True)
    preds = scratch.put("preds", preds)
    _, members, own = _edge_rows(preds, threshold, scratch)
    bad = transitive_votes(scored, members, threshold).where("negative > positive").select("component_id")
    if most is not None:
        bad = bad.join(component_sizes(members).where(F.col("size") <= most), "component_id", "left_semi")
    bad = scratch.put("bad", bad)
    low = F.when(F.col("prob") < threshold, 2).when(F.col("prob") >= threshold, 3)
    given = inside_components(scored, members).select("component_id", low.alias("kind"), *PAIR).where("kind is not null")

    def votes(g: pd.DataFrame, es: list):
        s = g[g["kind"] >= 2]
        l, r, bad_ = s["lid"].to_numpy(), s["rid"].to_numpy(), (s["kind"] == 2).to_numpy()
        return lambda nodes: GivenVotes(nodes, l, r, bad_)

    return scratch.put("preds", _delete_settled(preds, own.unionByName(given).join(bad, "component_id", "left_semi"), votes))


def _word_rows(members: DataFrame, records: DataFrame, scorer: TokenScorer) -> DataFrame:
    """``(component_id, kind, lid, rid, words)``: the words of every member with a record, kind 2."""
    t = token_sets(records, scorer.text_col, scorer.id_col)
    return members.join(t, "id").select("component_id", F.lit(2).alias("kind"), F.col("id").alias("lid"), F.col("id").alias("rid"), F.col("tokens").alias("words"))


def _word_pairs(g: pd.DataFrame, es: list, cut: float, measure: str) -> WordPairs:
    w = g[g["kind"] == 2]
    return WordPairs(dict(zip(w["lid"].tolist(), w["words"].tolist())), es, cut, measure)


def closure_votes(edges: DataFrame, members: DataFrame, records: DataFrame, scorer: TokenScorer) -> DataFrame:
    """:func:`transitive_votes` of the scores that ``scorer`` (with a cut) gives all pairs of a component without an edge of their own; no component is too large, no pair is written."""
    cut, measure = scorer.cut, scorer.measure
    own = inside_components(distinct_pairs(edges), members).select("component_id", F.lit(0).alias("kind"), *PAIR, F.lit(None).cast("array<string>").alias("words"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e = g[g["kind"] == 0]
        x = WordVotes(_word_pairs(g, list(zip(e["lid"].tolist(), e["rid"].tolist())), cut, measure), g.loc[g["kind"] == 2, "lid"].tolist())
        return pd.DataFrame({"component_id": [g["component_id"].iloc[0]], "negative": [x.negative], "positive": [x.positive]})

    rows = own.unionByName(_word_rows(members, records, scorer))
    return per_component(rows).applyInPandas(run, "component_id long, negative long, positive long").where("negative + positive > 0")


def post_cleanup_whole(preds: DataFrame, records: DataFrame, scorer: TokenScorer, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """:func:`post_cleanup` with the scores of all transitive pairs and without a cap: the votes come from the words of the members."""
    scratch = Scratch(preds.sparkSession, "post-cleanup", lean=True)
    preds = scratch.put("preds", preds)
    _, members, own = _edge_rows(preds, threshold, scratch)
    cut, measure = scorer.cut, scorer.measure

    def votes(g: pd.DataFrame, es: list):
        pairs = _word_pairs(g, es, cut, measure)
        return lambda nodes: WordVotes(pairs, nodes)

    several = component_sizes(members).where("size > 2").select("component_id")
    rows = own.withColumn("words", F.lit(None).cast("array<string>")).unionByName(_word_rows(members, records, scorer)).join(several, "component_id", "left_semi")
    return scratch.put("preds", _delete_settled(preds, rows, votes))


def check_large(preds: DataFrame, members: DataFrame, threshold: float = MATCH_THRESHOLD, most: int = COMPONENT_CAP) -> DataFrame:
    """Labels every unchecked edge of components larger than the cap."""
    return label_edges_of(preds, members, big_components(members, most), threshold)


def check_checked_false(preds: DataFrame, transitive: DataFrame, members: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Labels the edges of components in which a transitive pair was already checked and found false."""
    false = preds.where("manual_check_label = 0").select(*PAIR)
    return label_edges_of(preds, members, inside_components(transitive.join(distinct_pairs(false), PAIR, "left_semi"), members), threshold)


def check_transitive(preds: DataFrame, scored: DataFrame, members: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Labels the edges of components with any transitive prediction below the threshold."""
    return label_edges_of(preds, members, inside_components(scored.where(F.col("prob") < threshold), members), threshold)


def effort(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows labelled between two states and how many of them were false."""
    b = before.select(*PAIR, F.coalesce("manual_check_label", F.lit(-1)).alias("_b"))
    new = after.join(b, PAIR).where((F.col("_b") < 0) & (F.col("manual_check_label") >= 0))
    return new.agg(F.count(F.lit(1)).alias("labelled"), F.count(F.when(F.col("label") == 0, 1)).alias("removed_false"))


def recover(edges: list[tuple], deleted: list[tuple], scores: dict, threshold: float, most: int, budget: int = 0, labels: dict | None = None, checked: set | None = None) -> tuple[list[tuple], list[tuple], int]:
    """Re-adds deleted edges of one group in order; returns (re-added, labelled, budget left).

    ``scores`` are transitive scores per pair, ``labels`` what a labeller would answer (None: no labeller).
    A deleted edge whose merged component stays within the cap comes back if all known transitive
    scores of the merged component reach the threshold; else it is labelled while the budget lasts.
    Larger merged components are labelled as a whole if the unchecked edges are fewer than the budget.
    """
    parent: dict = {}
    group: dict = {}
    own: dict = {}
    checked = set(checked or ())

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        group.setdefault(x, {x})
        own.setdefault(x, set())
        return x

    def join(a, b):
        x, y = find(a), find(b)
        if x != y:
            parent[y] = x
            group[x] |= group.pop(y)
            own[x] |= own.pop(y)
        own[x].add((a, b))

    def rebuild(nodes, kept):
        for n in nodes:
            parent[n] = n
            group[n], own[n] = {n}, set()
        for a, b in sorted(kept):
            join(a, b)

    for a, b in edges:
        join(a, b)
    back, asked = [], []

    def ask(e) -> int:
        nonlocal budget
        budget -= 1
        asked.append((*e, labels.get(e, 0)))
        checked.add(e)
        return labels.get(e, 0)

    for e in sorted(deleted):
        x, y = find(e[0]), find(e[1])
        if x == y:
            continue
        if len(group[x]) == 1 and len(group[y]) == 1:
            if labels is not None and budget > 0 and ask(e):
                back.append(e)
                join(*e)
            continue
        nodes, kept = group[x] | group[y], own[x] | own[y]
        if len(nodes) > most:
            open_ = sorted((kept | {e}) - checked)
            if labels is not None and len(open_) < budget:
                good = {f for f in open_ if ask(f)}
                if e in good:
                    back.append(e)
                rebuild(nodes, (kept & checked & {f for f in kept if labels.get(f, 0)}) | good)
            continue
        have = kept | {e}
        order = sorted(nodes)
        probs = [scores[p] for i, u in enumerate(order) for v in order[i + 1 :] if (p := (u, v)) not in have and p in scores]
        if probs and min(probs) >= threshold:
            back.append(e)
            join(*e)
        elif labels is not None and budget > 0 and ask(e):
            back.append(e)
            join(*e)
    return back, asked, budget


def edge_recovery(preds: DataFrame, rescored: DataFrame, transitive: DataFrame, threshold: float = MATCH_THRESHOLD, most: int = COMPONENT_CAP) -> DataFrame:
    """``(lid, rid)`` of deleted edges that come back without a labeller.

    Deleted are unchecked rows with prob 0 whose new score reaches the threshold.  Without a budget an edge comes back only
    if every transitive score of the merged component is high, and components only grow; so edges between
    pieces of the graph with a low score between them are out from the start, as are edges whose pieces together exceed
    the cap.  What is left falls into independent groups of pieces, which are taken in order one by one.
    """
    scratch = Scratch(preds.sparkSession, "recovery")
    gone = preds.where((F.col("prob") == 0) & (F.coalesce("manual_check_label", F.lit(-1)) < 0)).select(*PAIR)
    gone = scratch.put("gone", gone.join(rescored.where(F.col("prob") >= threshold).select(*PAIR), PAIR, "left_semi"))
    edges = scratch.put("edges", match_graph(preds, threshold).select(*PAIR))
    small = scratch.put("small", components(edges))
    sized = scratch.put("sized", small.join(component_sizes(small), "component_id").select("id", F.col("component_id").alias("piece"), "size"))

    def pieces(pairs: DataFrame) -> DataFrame:
        out = pairs
        for end in PAIR:
            own = sized.select(F.col("id").alias(end), F.col("piece").alias(f"{end}_piece"), F.col("size").alias(f"{end}_size"))
            out = out.join(own, end, "left").withColumns({f"{end}_piece": F.coalesce(f"{end}_piece", end), f"{end}_size": F.coalesce(f"{end}_size", F.lit(1))})
        return out.withColumns({"x": F.least("lid_piece", "rid_piece"), "y": F.greatest("lid_piece", "rid_piece")})

    low = pieces(transitive.where(F.col("prob") < threshold).select(*PAIR)).where("x <> y").select("x", "y").distinct()
    fits = (F.col("x") != F.col("y")) & (F.col("lid_size") + F.col("rid_size") <= most)
    free = scratch.put("free", pieces(gone).where(fits).join(low, ["x", "y"], "left_anti").select(*PAIR))
    whole = scratch.put("whole", components(edges.unionByName(free)))
    touched = scratch.put("touched", edges_of(free, whole).select("component_id").distinct())
    e = edges_of(edges, whole).select("component_id", *PAIR, F.lit(0).alias("kind"), F.lit(None).cast("double").alias("prob"))
    d = edges_of(free, whole).select("component_id", *PAIR, F.lit(1).alias("kind"), F.lit(None).cast("double").alias("prob"))
    t = inside_components(transitive.where("prob is not null"), whole).select("component_id", *PAIR, F.lit(2).alias("kind"), "prob")
    # without a labeller nothing comes back where no transitive pair has a score
    told = scratch.put("told", touched.join(t.select("component_id"), "component_id", "left_semi"))
    rows = e.unionByName(d).unionByName(t).join(told, "component_id", "left_semi")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        pick = lambda k: list(zip(g.loc[g["kind"] == k, "lid"].tolist(), g.loc[g["kind"] == k, "rid"].tolist()))
        scores = dict(zip(pick(2), g.loc[g["kind"] == 2, "prob"].tolist()))
        back, _, _ = recover(pick(0), pick(1), scores, threshold, most)
        return pd.DataFrame(back, columns=PAIR)

    return per_component(rows).applyInPandas(run, "lid long, rid long")


def recovery_pairs(preds: DataFrame, deleted: DataFrame, threshold: float = MATCH_THRESHOLD, most: int = COMPONENT_CAP) -> DataFrame:
    """Transitive pairs of the graph with the deleted edges added back, components smaller than the cap only."""
    union = distinct_pairs(match_graph(preds, threshold).select(*PAIR).unionByName(deleted.select(*PAIR)))
    return transitive_pairs(union, components(union), most, exclusive=True)


def stage_counts(preds: DataFrame, scored: DataFrame | None = None, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """One row: true and false positives, labelled pairs, and the transitive predictions of both signs."""
    p = preds.agg(
        F.count(F.when((F.col("prob") >= threshold) & (F.col("label") == 1), 1)).alias("true_positives"),
        F.count(F.when((F.col("prob") >= threshold) & (F.col("label") == 0), 1)).alias("false_positives"),
        F.count(F.when((F.col("prob") < threshold) & (F.col("label") == 0), 1)).alias("true_negatives"),
        F.count(F.when((F.col("prob") < threshold) & (F.col("label") == 1), 1)).alias("false_negatives"),
        F.count(F.when(F.col("manual_check_label") >= 0, 1)).alias("labeled_pairs"),
    )
    if scored is None:
        return p
    t = scored.agg(F.count(F.when(F.col("prob") < threshold, 1)).alias("negative_transitive_preds"), F.count(F.when(F.col("prob") >= threshold, 1)).alias("positive_transitive_preds"))
    return p.crossJoin(t)  # one row each


__all__ = [n for n in dir() if not n.startswith("_")]
