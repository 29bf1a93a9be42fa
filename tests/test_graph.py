import itertools
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import clean, graph, pairs
from matchloom.operators.labeling import label_summary, oracle_label, parse_answer

PREDS = "lid long, rid long, prob double, match_type string, label int, manual_check_label int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def preds(frame, edges, label=1):
    return frame([(a, b, p, "text_match", label, -1) for a, b, p in edges], PREDS)


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("one_task", [10**9, 0])
def test_components_match_brute_force(frame, one_task):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)] + [(5, 5)]
    want = brute_components([e for e in edges if e[0] != e[1]])
    got = graph.components(frame(edges, "lid long, rid long"), one_task_edges=one_task)
    assert rows(got) == want


def test_threshold_is_strict_for_edges(frame):
    p = preds(frame, [(1, 2, 0.5), (2, 3, 0.6)])
    assert rows(graph.match_graph(p, 0.5).select("lid", "rid")) == [(2, 3)]
    assert rows(pairs.dedupe_predictions(p, 0.5).select("lid", "rid")) == [(1, 2), (2, 3)]


def test_dirty_pairs(frame):
    p = preds(frame, [(2, 1, 1.0), (1, 2, 1.0), (3, 3, 1.0), (None, 4, 1.0)])
    assert rows(graph.match_graph(p).select("lid", "rid")) == [(1, 2)]
    assert rows(graph.components(graph.match_graph(p))) == [(1, 1), (2, 1)]


def test_empty_graph(frame):
    e = graph.match_graph(preds(frame, []))
    m = graph.components(e)
    assert rows(m) == [] and rows(graph.transitive_pairs(e, m)) == [] and rows(graph.minimum_cuts(e, m)) == []


@pytest.mark.parametrize(
    "edges,transitive,cut",
    [
        ([(1, 2), (2, 3), (3, 4)], 3, [(1, 2)]),
        ([(1, 2), (2, 3), (1, 3)], 0, [(1, 2), (1, 3)]),
        ([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], 8, [(3, 4)]),
        ([(1, k) for k in range(2, 6)], 6, [(1, 2)]),
    ],
)
def test_small_graphs(frame, edges, transitive, cut):
    e = frame([(a, b, 1.0, "x") for a, b in edges], "lid long, rid long, prob double, match_type string")
    m = graph.components(e)
    assert graph.transitive_pairs(e, m).count() == transitive
    assert rows(graph.minimum_cuts(e, m).select("lid", "rid")) == cut


def test_cap_boundaries(frame):
    paths = [(base + i, base + i + 1) for base, n in ((1000, 49), (2000, 50), (3000, 51)) for i in range(n - 1)]
    e = frame(paths, "lid long, rid long")
    m = graph.components(e)
    sizes = lambda df: {r[0] // 1000 for r in df.select("lid").collect()}
    assert sizes(graph.transitive_pairs(e, m, 50)) == {1, 2}
    assert sizes(graph.transitive_pairs(e, m, 50, exclusive=True)) == {1}
    assert rows(graph.big_components(m, 50).select("size")) == [(51,)]


def test_registered_caps(spark, frame, monkeypatch):
    from matchloom.plans import catalog

    paths = [(base + i, base + i + 1) for base, n in ((1000, 49), (2000, 50), (3000, 60)) for i in range(n - 1)]
    e = frame(paths, "lid long, rid long")
    monkeypatch.setattr(catalog, "_graph", lambda *_: (e, graph.components(e)))
    got = {b: n for b, n in catalog.QUERIES["transitive_pairs_recovery_50"](spark, "").groupBy(F.floor(F.col("lid") / 1000)).count().collect()}
    assert got == {1: 49 * 48 // 2 - 48}
    drawn = catalog.QUERIES["transitive_pairs_sampled_50"](spark, "").where("lid >= 3000")
    assert drawn.select(F.explode(F.array("lid", "rid"))).distinct().count() == 50
    ran = []

    class Recorded(catalog.CleanUp):
        def run(self, predictions):
            ran.append((self.budget, self.iterations, self.cap))
            counts = ("true_positives", "false_positives", "true_negatives", "false_negatives", "labeled_pairs", "negative_transitive_preds", "positive_transitive_preds")
            return type("Cleaned", (), {"stages": frame([], "step int, stage string, " + ", ".join(f"{c} long" for c in counts))})

    class NoTables:
        companies = None
        pairwise_matches_preds = frame([], ", ".join(f"{c} string" for c in catalog.PREDS))

        def __init__(self, *_):
            pass

    monkeypatch.setattr(catalog, "CleanUp", Recorded)
    monkeypatch.setattr(catalog, "Tables", NoTables)
    catalog.QUERIES["clean_match_graph"](spark, "")
    assert ran == [(1000, 5, 50)]


def test_minimum_cut_is_minimum():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(2, 8)
        edges = {(rng.randrange(i), i) for i in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(0, 6))}
        cut = graph.minimum_cut(sorted(edges))
        left = edges - set(cut)
        assert len(set(c for _, c in brute_components(list(left) + [(x, x) for x in range(n)]))) > 1
        best = min(sum((a in s) != (b in s) for a, b in edges) for k in range(1, n) for s in map(set, itertools.combinations(range(n), k)))
        assert len(cut) == best


def test_least_path():
    edges = [(1, 3), (3, 4), (1, 2), (2, 4)]
    assert graph.least_path(edges, 1, 4) == [(1, 2), (2, 4)]
    assert graph.least_path(edges, 1, 9) == []


def test_truncation_spares_the_threshold(frame):
    p = preds(frame, [(i, i + 1, 1.0) for i in range(1, 6)] + [(1, 6, 0.999)])
    out = graph.truncate_large(p, graph.components(graph.match_graph(p)), most=4)
    assert {r["prob"] for r in out.where("not (lid = 1 and rid = 6)").collect()} == {0.0}
    assert out.where("lid = 1 and rid = 6").first()["prob"] == 0.999


def votes(frame, scores):
    return frame(scores, "lid long, rid long, prob double")


def test_two_votes_cut_in_update_only(frame):
    p = preds(frame, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)])
    m = graph.components(graph.match_graph(p))
    s = votes(frame, [(1, 3, 1.0), (1, 4, 1.0), (2, 4, 0.0)])
    assert clean.update_predictions(p, s, m).where("prob = 0").select("lid", "rid").collect() == [(1, 2)]
    assert clean.post_cleanup(p, s).where("prob = 0").count() == 0


def test_fixpoint_stops_on_checked_cut_and_is_idempotent(frame):
    p = frame([(1, 2, 1.0, "x", 1, 1), (2, 3, 1.0, "x", 0, -1), (3, 4, 1.0, "x", 1, -1)], PREDS)
    s = votes(frame, [(1, 3, 0.0), (1, 4, 0.0), (2, 4, 0.0)])
    once = clean.post_cleanup(p, s)
    assert once.where("lid = 1 and rid = 2").first()["prob"] == 1.0
    assert rows(clean.post_cleanup(once, s)) == rows(once)


def test_checks_set_prob_to_label(frame):
    p = frame([(i, i + 1, 1.0, "x", i % 2, -1) for i in range(1, 6)], PREDS)
    m = graph.components(graph.match_graph(p))
    out = clean.check_large(p, m, most=3)
    assert all(r["prob"] == r["label"] == r["manual_check_label"] for r in out.collect())
    assert clean.effort(p, out).first().asDict() == {"labelled": 5, "removed_false": 2}


def test_selection_respects_budget(frame):
    p = preds(frame, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (10, 11, 1.0), (11, 12, 1.0)])
    m = graph.components(graph.match_graph(p))
    s = votes(frame, [(1, 3, 0.0), (1, 4, 0.0), (2, 4, 0.0), (10, 12, 0.0)])
    all_ = clean.select_edges(p, s, m, 10)
    assert rows(all_.select("lid", "rid")) == [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12)]
    top = clean.select_edges(p, s, m, 2)
    assert top.count() == 2 and {r["component_id"] for r in top.collect()} == {1}


def test_recovery_branches():
    good = {(1, 3): 1.0, (1, 4): 1.0, (2, 4): 1.0}
    assert clean.recover([(1, 2), (3, 4)], [(2, 3)], good, 0.5, 50)[0] == [(2, 3)]
    assert clean.recover([(1, 2), (3, 4)], [(2, 3)], good | {(1, 4): 0.0}, 0.5, 50)[0] == []
    assert clean.recover([(1, 2)], [(1, 2)], {}, 0.5, 50)[0] == []
    assert clean.recover([], [(7, 8)], {}, 0.5, 50)[0] == []
    back, asked, left = clean.recover([], [(7, 8)], {}, 0.5, 50, budget=1, labels={(7, 8): 1})
    assert (back, asked, left) == ([(7, 8)], [(7, 8, 1)], 0)
    assert clean.recover([(1, 2), (3, 4)], [(2, 3)], good, 0.5, 3, budget=3, labels={(1, 2): 1, (2, 3): 1, (3, 4): 1})[0] == []
    assert clean.recover([(1, 2), (3, 4)], [(2, 3)], good, 0.5, 3, budget=4, labels={(1, 2): 1, (2, 3): 1, (3, 4): 1})[0] == [(2, 3)]


def test_recovery_frames_match_the_rule(frame):
    import random

    rng = random.Random(17)
    for _ in range(6):
        nodes = range(14)
        every = {(a, b) for a in nodes for b in nodes if a < b}
        kept = set(rng.sample(sorted(every), 7))
        gone = set(rng.sample(sorted(every - kept), 8))
        scores = {e: float(rng.random() < 0.8) for e in every - kept - gone}
        preds = frame([(*e, 1.0, "m", 1, -1) for e in kept] + [(*e, 0.0, "m", 1, -1) for e in gone], PREDS)
        again = frame([(*e, 1.0) for e in gone], "lid long, rid long, prob double")
        closing = frame([(*e, s) for e, s in scores.items()], "lid long, rid long, prob double")
        got = {tuple(r) for r in clean.edge_recovery(preds, again, closing, 0.999, 6).collect()}
        want, _, _ = clean.recover(sorted(kept), sorted(gone), scores, 0.999, 6)
        assert got == set(want)


def test_recovery_on_frames(frame):
    p = frame([(1, 2, 1.0, "x", 1, -1), (3, 4, 1.0, "x", 1, -1), (2, 3, 0.0, "x", 1, -1), (5, 6, 0.0, "x", 0, 0)], PREDS)
    rescored = votes(frame, [(2, 3, 1.0), (5, 6, 1.0)])
    closing = votes(frame, [(1, 3, 1.0), (1, 4, 1.0), (2, 4, 1.0)])
    assert rows(clean.edge_recovery(p, rescored, closing)) == [(2, 3)]


def test_labels(frame):
    p = frame([(1, 2, 1.0, "x", 1, -1), (2, 3, 1.0, "x", 0, None), (3, 4, 1.0, "x", None, -1)], PREDS)
    out = oracle_label(p, p.where("lid < 4"))
    assert [r[5] for r in rows(out)] == [1, 0, -1]
    s = label_summary(out).first()
    assert (s["checked_positive"], s["checked_negative"], s["unchecked"], s["pairs"]) == (1, 1, 1, 3)
    said = frame([("Yes, surely",), ("no",), (None,)], "a string").select(parse_answer(F.col("a")).alias("y"))
    assert [r[0] for r in said.collect()] == [1, 0, 0]


def test_order_and_partitions_do_not_matter(frame):
    rng = random.Random(5)
    edges = [(a, b, 1.0) for a, b in {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}]
    base = preds(frame, edges)
    rng.shuffle(edges)
    other = preds(frame, edges).repartition(7)
    for f in (lambda p: graph.minimum_cuts(graph.match_graph(p), graph.components(graph.match_graph(p))), lambda p: graph.transitive_pairs(graph.match_graph(p), graph.components(graph.match_graph(p)))):
        assert rows(f(base)) == rows(f(other))


def test_post_cleanup_of_large_components_equals_its_rounds(frame):
    from matchloom.operators.scoring import TokenScorer

    rng = random.Random(23)
    at, edges, names = 0, [], []
    for n, extra in ((70, 12), (30, 25), (9, 3), (2, 0)):
        names += [(at + i, rng.choice((None, "a b", "a b", "b c", "a b c", "d e"))) for i in range(n) if rng.random() < 0.95]
        edges += {(at + rng.randrange(i), at + i) for i in range(1, n)} | {tuple(sorted(at + x for x in rng.sample(range(n), 2))) for _ in range(extra)}
        at += 100
    p = frame([(a, b, 1.0, "x", 1, 1 if rng.random() < 0.1 else -1) for a, b in sorted(set(edges))], PREDS)
    records, scorer = frame(names, "id long, name string"), TokenScorer("name", cut=0.5)
    e = graph.match_graph(p)
    s = scorer.score(graph.transitive_pairs(e, graph.components(e), None), records).localCheckpoint()
    # the rounds, one cut of every component at a time
    want = p.localCheckpoint()
    while True:
        e = graph.match_graph(want)
        m = graph.components(e).localCheckpoint()
        bad = graph.transitive_votes(s, m).where("negative > positive").select("component_id")
        cut = graph.minimum_cuts(e, m.join(bad, "component_id", "left_semi"), None).select("lid", "rid")
        cut = cut.join(want.where("manual_check_label < 0").select("lid", "rid"), ["lid", "rid"], "left_semi").localCheckpoint()
        if cut.isEmpty():
            break
        want = clean.zero_pairs(want, cut).localCheckpoint()
    assert want.where("prob = 0 and lid < 100").count() > 0
    assert rows(clean.post_cleanup_whole(p, records, scorer)) == rows(want) == rows(clean.post_cleanup(p, s, most=None))
    e = graph.match_graph(p)
    m = graph.components(e)
    assert rows(clean.closure_votes(e, m, records, scorer)) == rows(graph.transitive_votes(s, m))


def test_clean_up_prepares_records_once(frame):
    from matchloom.operators.scoring import TokenScorer
    from matchloom.plans.pipeline import CleanUp

    class Counted(TokenScorer):
        prepared = 0

        def prepare(self, records):
            self.prepared += 1
            return super().prepare(records)

    scorer = Counted("name", cut=0.5)
    p = frame([(1, 2, 1.0, "x", 1, -1), (2, 3, 1.0, "x", 0, -1)], PREDS)
    out = CleanUp(scorer, frame([(1, "a b"), (2, "a b"), (3, "z")], "id long, name string"), budget=2, iterations=1).run(p)
    assert scorer.prepared == 1
    assert out.stages.where("step = 0").first()["negative_transitive_preds"] == 1


def test_components_are_spread_over_the_cores(frame, spark):
    e = frame([(i * 10, i * 10 + 1) for i in range(200)], "lid long, rid long")
    rows_ = graph.edges_of(e, graph.components(e))
    assert graph.per_component(rows_).applyInPandas(lambda g: g[["component_id"]], "component_id long").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
