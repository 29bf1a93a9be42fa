import os

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions.skew import lookup_join, spread_rank
from matchloom.operators import active, blocking, metrics, pairs, prep, splits
from matchloom.operators.scoring import BatchScorer, LearnedScorer, TokenScorer
from matchloom.sources import tables as src

P = "lid long, rid long, prob double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedupe_keeps_the_best_and_counts_boundaries(frame):
    p = frame([(2, 1, 0.4), (1, 2, 0.9), (1, 1, 1.0), (None, 3, 1.0), (4, 5, None)], P)
    assert rows(pairs.dedupe_predictions(p, 0.9)) == [(1, 2, 0.9)]
    assert rows(pairs.distinct_pairs(p)) == [(1, 2), (4, 5)]


def test_accumulate_keeps_the_old_row(frame):
    assert rows(pairs.accumulate(frame([(1, 2, 0.1)], P), frame([(1, 2, 0.9), (3, 4, 0.5)], P))) == [(1, 2, 0.1), (3, 4, 0.5)]


def test_positions_are_dense_over_partitions(frame):
    ids = frame([(i * 7 % 101,) for i in range(101)], "id long").repartition(5)
    assert rows(pairs.positional_ids(ids, ["id"])) == [(i, i) for i in range(101)]


def test_lookup_join_with_hot_key(frame):
    left = frame([("hot", i) for i in range(50)] + [("cold", 1), ("none", 2)], "k string, v long")
    table = frame([("hot", 10, 50), ("cold", 20, 1)], "k string, w long, n long")
    got = lookup_join(left, table, "k", "n", least=5)
    assert got.count() == 51 and got.where("k = 'hot'").select("w").distinct().first()[0] == 10


def test_spread_rank_numbers_each_group_once(frame):
    df = frame([(i % 2, i) for i in range(40)], "g int, id long")
    got = spread_rank(df, ["g"], [F.col("id")], "r", F.col("id"), 4)
    assert sorted(r["r"] for r in got.where("g = 0").collect()) == list(range(1, 21))


def test_truncation_matches_popping():
    def pop(a, b, most):
        a, b = list(a), list(b)
        while len(a) + len(b) > most:
            (a if len(a) > len(b) else b).pop()
        return a, b

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cases = [(na, nb) for na in range(0, 9) for nb in range(0, 9)]
    df = spark.createDataFrame([(["a"] * x, ["b"] * y) for x, y in cases], "a array<string>, b array<string>")
    for most in (3, 4, 7):
        x, y = T.truncate_pair(F.col("a"), F.col("b"), most)
        for r in df.select("a", "b", x.alias("x"), y.alias("y")).collect():
            assert (len(r["x"]), len(r["y"])) == tuple(map(len, pop(r["a"], r["b"], most)))


def test_sequences_have_fixed_length(frame):
    df = frame([(["x"] * 30, ["y"] * 2), ([], [])], "a array<string>, b array<string>")
    for left in (False, True):
        s = df.select(T.build_sequence(F.col("a"), F.col("b"), 12, pad_left=left).alias("s")).select("s.*").collect()
        assert all(len(r["tokens"]) == len(r["segment_ids"]) == len(r["mask"]) == 12 for r in s)


def test_text_functions_on_nulls_and_blanks(frame):
    df = frame([(1, None, "x"), (2, "", "y"), (3, "A. & B, (c)", None)], "id long, name string, city string")
    assert [r[0] for r in df.orderBy("id").select(T.strip_punctuation(F.col("name"))).collect()] == [None, "", "A  B  c "]
    assert [r[0] for r in df.orderBy("id").select(T.concat_row(["name", "city"])).collect()] == ["x", "y", "A. & B, (c)"]
    assert df.where("id = 1").select(T.normalize(F.col("name"))).first()[0] is None
    assert T.tf_idf_prune(df, "id", "name").count() == 3


def test_negatives_are_new_distinct_and_both_ways(frame):
    ids = frame([(i,) for i in range(30)], "id long")
    taken = frame([(0, 1, 1), (2, 3, 1)], "lid long, rid long, label int")
    got = rows(splits.random_negatives(ids, taken, 20))
    one = {(a, b) for a, b, _ in got if a < b}
    assert len(got) == 20 and len(one) == 10 and not one & {(0, 1), (2, 3)} and all((b, a, 0) in got for a, b in one)
    out = splits.negatives_per_split(ids, {"train": taken, "test": frame([(4, 5, 1)], "lid long, rid long, label int")}, ratio=3)
    # two wanted for the one positive of test, four for the two of train
    assert out["test"].count() == 2 and out["train"].count() == 4


def test_entity_split_shares(frame):
    got = rows(splits.entity_split(frame([(i,) for i in range(10)] + [(3,), (None,)], "entity long")))
    assert [s for _, s in got] == ["train"] * 6 + ["val"] * 2 + ["test"] * 2


def test_id_overlap_ignores_nulls(frame):
    r = frame([(1, "a", "X", None), (2, "b", "X", None), (3, "b", None, None), (4, "a", "X", None)], "id long, source string, k string, m string")
    assert rows(blocking.id_overlap(r, {"k": F.col("k"), "m": F.col("m")})) == [(1, 2), (2, 4)]


def test_cosine_blocks_agree(frame):
    v = frame([(i, [float((i * 7) % 5 - 2), float(i % 3), 1.0]) for i in range(25)] + [(99, None), (98, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert rows(blocking.cosine_top_k(v, v, 3)) == rows(blocking.cosine_top_k(v, v, 3, block=7))


@pytest.mark.parametrize("source", [None, "src"])
def test_top_overlap_matches_brute_force(frame, monkeypatch, source):
    import itertools
    import random

    monkeypatch.setattr(blocking, "COMMON_ROWS", 8)
    monkeypatch.setattr(blocking, "COMMON_SHARE", 0.05)
    monkeypatch.setattr(blocking, "MOST_COMMON", 3)
    rng = random.Random(31)
    # common words a to f that nearly everyone has some of, rare ones, an empty text and a null
    data = [(i, rng.choice("xyz"), " ".join(rng.sample("abcdef", rng.randrange(0, 6)) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 3))])) for i in range(120)]
    data += [(500, "x", None), (501, "y", "")]
    got = {}
    for r in blocking.top_token_overlap(frame(data, "id long, src string, t string"), "t", 4, source).collect():
        got.setdefault(r["lid"], []).append((r["rank"], r["rid"], r["overlap"]))
    bags = {i: (s, set((t or "").split())) for i, s, t in data}
    for i, (s, bag) in bags.items():
        near = sorted((-len(bag & b), j) for j, (o, b) in bags.items() if j != i and (source is None or o != s) and bag & b)[:4]
        assert sorted(got.get(i, [])) == [(k + 1, j, -n) for k, (n, j) in enumerate(near)]


def test_sliced_join_equals_join(frame):
    from matchloom.functions.skew import sliced_join

    a = frame([("hot", i) for i in range(30)] + [("cold", 1), ("none", 2)], "k string, a long")
    b = frame([("hot", i) for i in range(40)] + [("cold", 7)], "k string, b long")
    assert rows(sliced_join(a, b, ["k"], "b", 6)) == rows(a.join(b, "k")) and sliced_join(a, b.limit(0), ["k"], "b").count() == 0


def test_cosine_both_sides_with_ties(frame):
    import numpy as np

    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0], None]
    df = frame(list(enumerate(v)), "vec_id long, embedding array<double>")
    assert rows(blocking.cosine_top_k(df, df, 1).select("lid", "rid")) == [(0, 1), (1, 0), (2, 3), (3, 0)]
    both = rows(blocking.cosine_top_k_both(df.where("vec_id < 2"), df.where("vec_id >= 2"), 1).select("side", "lid", "rid"))
    assert both == [("left", 0, 3), ("left", 1, 3), ("right", 0, 2), ("right", 0, 3)]
    ids, sim = np.array([7, 3, 5, 1]), np.array([[0.5, 0.5, 0.9, 0.5], [0.1, 0.2, 0.2, 0.2]])
    assert ids[blocking._block_best(ids, sim, 2)].tolist() == [[5, 1], [1, 3]]


def test_splits_have_exact_shares(frame):
    df = frame([(i, i + 1, i % 3 if i % 7 else None) for i in range(103)], "lid long, rid long, label int")
    n = {r["split"]: r["count"] for r in splits.random_split(df, ["lid", "rid"]).groupBy("split").count().collect()}
    assert n == {"train": 82, "val": 10, "test": 11}
    strata = {(r["label"], r["split"]): r["count"] for r in splits.stratified_split(df, ["lid", "rid"]).groupBy("label", "split").count().collect()}
    whole = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    assert all(strata[k, "valid"] == n // 4 and strata[k, "train"] == n - n // 4 for k, n in whole.items())
    hard = {r["split"]: r["count"] for r in splits.hard_negatives(df, {"train": 6, "test": 2, "val": 0}).groupBy("split").count().collect()}
    assert hard == {"train": 77, "test": 26}


def test_dataset_keeps_entities_apart(frame):
    records = frame([(i, f"r{i}") for i in range(40)], "id long, name string")
    parts = splits.build_dataset(records, frame([(i // 4, i) for i in range(36)] + [(None, 38)], "entity long, id long"))
    assert parts["records"].count() == 36 and sum(parts[k].count() for k in ("train", "val", "test")) == 9 * 6
    seen = [{i for r in parts[k].collect() for i in (r["lid"], r["rid"])} for k in ("train", "val", "test")]
    assert not (seen[0] & seen[1] or seen[0] & seen[2] or seen[1] & seen[2])
    more = splits.with_negatives(records, {k: parts[k] for k in ("train", "val")}, ratio=3)
    assert more["train"].where("label = 0").count() == 2 * parts["train"].count()


def test_consistency_matches_brute_force(frame):
    import random

    rng = random.Random(5)
    pairs_ = {(rng.randrange(12), 100 + rng.randrange(9)) for _ in range(34)}
    got = set(rows(active.consistent(frame([(a, b, 1) for a, b in pairs_] + [(1, 2, 0)], "lid long, rid long, label int")))) - {(1, 2, 0)}
    own = {a: {b for x, b in pairs_ if x == a} for a, _ in pairs_}
    want = set()
    for a, rids in own.items():
        near = [own[c] for c in own if own[c] & rids]
        want |= {(a, b, 1) for b in (rids if len(rids) == 1 else set.intersection(*near) & rids)}
    assert got == want


def test_labeller_asks_in_batches_and_again(frame):
    from matchloom.operators.labeling import FunctionLabeller

    def load():
        return {"calls": 0}

    def ask(model, prompts):
        assert len(prompts) <= 2
        model["calls"] += 1
        if model["calls"] == 1:
            raise OSError("busy")
        return ["Yes." if "same" in p else "no" for p in prompts]

    recs = frame([(1, "same"), (2, "other"), (3, None), (4, "x"), (5, "same")], "id long, text string")
    p = frame([(1, 2, -1), (3, 4, None), (2, 4, -1), (4, 5, -1), (1, 5, 0), (1, 9, -1)], "lid long, rid long, manual_check_label int")
    got = FunctionLabeller(ask, "text", batch=2, prompt="{a} or {b}", load=load).label(p.coalesce(1), recs)
    assert rows(got) == [(1, 2, 1), (2, 4, 0), (3, 4, 0), (4, 5, 1)]

    def broken(prompts):
        raise OSError("down")

    with pytest.raises(Exception, match="down"):
        FunctionLabeller(broken, "text").label(p, recs).collect()


def test_encoders_and_padding(frame):
    from matchloom.operators.scoring import HashEncoder, LearnedEncoder, padded

    recs = frame([(i, f"common word{i % 5} noise{i}") for i in range(20)] + [(30, None), (31, "")], "id long, name string")
    v = {r["id"]: r["v"] for r in HashEncoder(["name"], 64).encode(recs).collect()}
    assert len(v) == 20 and all(abs(sum(x * x for x in u) - 1) < 1e-9 for u in v.values())
    e = LearnedEncoder(["name"], 64).fit(frame([(i, i + 5, 1) for i in range(10)] + [(i, i + 6, 0) for i in range(10)], "lid long, rid long, label int"), recs)
    w = {r["id"]: r["v"] for r in e.encode(recs).collect()}
    dot = lambda u, a, b: sum(x * y for x, y in zip(u[a], u[b]))
    assert dot(w, 0, 15) - dot(w, 0, 16) > dot(v, 0, 15) - dot(v, 0, 16)
    assert padded([[1, 2, 3], [4]]).tolist() == [[1, 2, 3], [4, 0, 0]] and padded([]).shape == (0, 0)


def test_active_loop_with_blocker(frame):
    from matchloom.operators.scoring import LearnedEncoder

    texts = [f"alpha{i} beta{i} {'gamma' if i % 2 else 'delta'}" for i in range(12)]
    recs = frame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " extra") for i, t in enumerate(texts)], "id long, text string")
    sides = (recs.where("id < 100"), recs.where("id >= 100"))
    truth = frame([(i, 100 + i, 1) for i in range(12)], "lid long, rid long, label int")
    pairs_ = frame([(i, 100 + j) for i in range(12) for j in range(12) if (i - j) % 4 == 0], "lid long, rid long")
    first = TokenScorer("text").score(pairs_, recs).withColumnRenamed("prob", "score")
    loop = active.ActiveLoop(LearnedScorer("text"), recs, truth, 24, 2, pseudo=True, encoder=LearnedEncoder(["text"], 256), sides=sides, top_k=3)
    scores, labelled = loop.run(pairs_, first)
    got = {(r["lid"], r["rid"]): r["score"] for r in scores.collect()}
    assert labelled.count() <= 24 and min(got[i, 100 + i] for i in range(12)) > max(s for (a, b), s in got.items() if b - a != 100)


def test_rules_skip_nulls(frame):
    r = frame([(1, "a b", 2000), (2, "b c", 2000), (3, "d", 2001), (4, None, None)], "id long, t string, y int")
    p = frame([(1, 2), (1, 3), (1, 4)], "lid long, rid long")
    assert rows(blocking.rule_filter(p, r, ["t"], ["y"], [])) == [(1, 2), (1, 4)]


def test_search_depth_stops(frame):
    ranked = frame([(1, r + 10, r, 1 - r / 100) for r in range(1, 13)], "lid long, rid long, rank int, sim double")
    recs = frame([(1, "a b")] + [(r + 10, "a b" if r == 1 else "z") for r in range(1, 13)], "id long, t string")
    got = blocking.search_depth(ranked, TokenScorer("t"), recs, step=3, most=12)
    assert got.agg(F.max("rank")).first()[0] == 6


def test_scorers(frame):
    r = frame([(1, "a b"), (2, "a b c"), (3, None), (1, "a b")], "id long, t string")
    p = frame([(2, 1), (1, 3)], "lid long, rid long")
    assert rows(TokenScorer("t").score(p, r)) == [(1, 2, 2 / 3), (1, 3, 0.0)]
    assert rows(TokenScorer("t", "containment").score(p, r)) == [(1, 2, 1.0), (1, 3, 0.0)]
    assert rows(BatchScorer(lambda b: (b["left"] == b["right"]), "t").score(p, r)) == [(1, 2, 0.0), (1, 3, 0.0)]
    with pytest.raises(ValueError):
        TokenScorer("t", "other")


def test_learned_scorer_orders_pairs(frame):
    r = frame([(i, f"w{i // 2} x y") for i in range(20)], "id long, t string")
    labelled = frame([(2 * i, 2 * i + 1, 1) for i in range(10)] + [(i, i + 10, 0) for i in range(10)], "lid long, rid long, label int")
    s = LearnedScorer("t").fit(labelled, r).score(labelled, r)
    got = {(a, b): p for a, b, p in rows(s)}
    assert got[(0, 1)] > got[(0, 10)]
    scores, done = active.ActiveLoop(LearnedScorer("t"), r, labelled, 8, 2).run(labelled, TokenScorer("t").score(labelled, r).withColumnRenamed("prob", "score"))
    assert 0 < done.count() <= 8 and scores.count() == labelled.count()


def test_active_selection(frame):
    s = frame([(1, 2, 0.9), (3, 4, 0.55), (5, 6, 0.5), (7, 8, 0.45), (9, 10, 0.1)], "lid long, rid long, score double")
    assert rows(active.uncertain(s, 3).select("lid", "rid")) == [(5, 6), (7, 8), (9, 10)]
    assert rows(active.best_per_side(frame([(1, 2, 0.9), (1, 3, 0.9), (4, 2, 0.6)], "lid long, rid long, score double"))) == [(1, 2, 1), (1, 3, 1), (4, 2, 1)]


def test_consistency(frame):
    lab = frame([(1, 5, 1), (1, 6, 1), (2, 5, 1), (3, 7, 1), (1, 9, 0)], "lid long, rid long, label int")
    assert rows(active.consistent(lab)) == [(1, 5, 1), (1, 9, 0), (2, 5, 1), (3, 7, 1)]


def test_metrics_without_positives_are_null(frame):
    e = frame([], "lid long, rid long")
    s = metrics.pair_scores(metrics.confusion(e, e)).first()
    assert (s["tp"], s["precision"], s["recall"], s["f1"]) == (0, None, None, None)
    c = metrics.column_scores(frame([(1, 1), (0, 1), (1, 0)], "label int, pred int")).first()
    assert (c["precision"], c["recall"]) == (0.5, 0.5)


def test_histogram_ends(frame):
    got = rows(metrics.probability_histogram(frame([(0.0,), (1.0,), (0.99,), (None,)], "prob double")))
    assert got == [(0, 1), (19, 2)]


def test_materialize_reads_what_it_wrote(spark, frame, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return frame([(1,)], "id long")

    at = f"file://{tmp_path}/t"
    assert src.materialize(spark, at, make).count() == src.materialize(spark, at, make).count() == 1 and len(calls) == 1
    stages = src.Stages(spark, f"file://{tmp_path}/run", ("preds",))
    assert stages.next_iteration(2) == 0
    src.write_table(frame([(1,)], "id long"), stages.path("preds", 0))
    assert stages.next_iteration(2) == 1


def test_json_records(spark, tmp_path):
    os.makedirs(tmp_path / "www.a.example")
    (tmp_path / "www.a.example" / "7.json").write_text('{"<page title>": "Cam", "zoom": "3x",\n "brand": "B"}')
    assert rows(src.records_from_json(spark, f"file://{tmp_path}/*/*.json")) == [("www.a.example//7", "Cam", "brand: B zoom: 3x")]


def test_csv_round_trip(spark, frame, tmp_path):
    src.write_table(frame([(1, "a")], "id long, t string"), f"file://{tmp_path}/c", "csv")
    assert rows(src.read_table(spark, f"file://{tmp_path}/c", "csv", "id long, t string")) == [(1, "a")]


def test_augmentations_keep_what_they_should(frame):
    t = prep.tokenise(frame([(1, "a b c d"), (2, "x"), (3, None)], "id long, n string"))
    drop = {r["id"]: r["tokenized"] for r in prep.augment(t, "del_token").collect()}
    assert len(drop[1]) in (2, 3) and drop[2] == ["x"]
    swapped = {r["id"]: r["tokenized"] for r in prep.augment(t, "swap_token").collect()}
    assert sorted(swapped[1]) == list("abcd") and swapped[2] == ["x"]
    assert sorted(prep.augment(t, "shuffle_token").where("id = 1").first()["tokenized"]) == list("abcd")
    cols = frame([(1, "p", "q", None)], "id long, a string, b string, c string")
    for kind, n in (("del_col", 2), ("swap_col", 3), ("shuffle_col", 3)):
        assert len(prep.augment_columns(cols, ["a", "b", "c"], kind).first()["cols"]) == n


def test_core_does_not_need_the_subpackage():
    import pathlib

    import matchloom

    root = pathlib.Path(matchloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "matchloom.llm" not in f.read_text()


def test_top_overlap_joins_no_frequent_word_and_goes_in_rounds(frame, monkeypatch):
    met = []
    join = blocking.sliced_join
    monkeypatch.setattr(blocking, "sliced_join", lambda *a, **k: (out := join(*a, **k), met.append(out.count()))[0])
    # w1 is held by 90 of 400 records, fewer than the 200 that were joined record by record
    data = frame([(i, "xyz"[i % 3], f"w{1 if i < 90 else i // 3} {'ab'[i % 2]}") for i in range(400)], "id long, src string, t string")
    whole = blocking.top_token_overlap(data, "t", 3, "src")
    assert met[0] < 3 * 400
    assert rows(blocking.top_token_overlap(data, "t", 3, "src", round_sets=50)) == rows(whole)


def test_search_depth_in_slices(frame):
    recs = frame([(i, f"a w{i % 7} v{i % 3}") for i in range(40)], "id long, t string")
    ranked = frame([(l, (l + r) % 40, r, float(20 - r)) for l in range(40) for r in range(1, 13)], "lid long, rid long, rank int, sim double")
    whole = blocking.search_depth(ranked, TokenScorer("t"), recs, step=3, most=12)
    assert rows(blocking.search_depth(ranked, TokenScorer("t"), recs, step=3, most=12, slice_rows=100)) == rows(whole)
