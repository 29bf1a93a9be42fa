import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("matchloom.llm.catalog")

from matchloom.llm import groups, leakage, linking, listings, listing_forms, name_forms, names, packing, residue, split_overlap, splits
from matchloom.llm.distinct_terms import log_odds, shared_rare_terms
from matchloom.llm.tables import company_entities, unlabelled, unmapped


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_groups(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


# 1 groups


@pytest.mark.parametrize("hot", [100_000, 3])
def test_hash_to_min_matches_brute_force(frame, hot):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 125)] + [(200, i) for i in range(201, 215)]
    want = brute_groups([e for e in edges if e[0] != e[1]])
    assert rows(groups.hash_to_min(frame(edges, "a long, b long"), hot_rows=hot)) == want


def test_consolidate_edge_cases(frame):
    schema = "lid long, rid long, prob double, group_id string, m long"
    data = [(2, 1, 1.0, "x", 0), (1, 2, 1.0, "y", 0), (3, 3, 1.0, "x", 0), (None, 4, 1.0, "x", 0), (5, 6, 0.999, "x", 0), (7, 8, None, "x", 0), (9, 10, float("nan"), "x", 0), (2, 11, 0.9999, None, None)]
    assert rows(groups.consolidate(frame(data, schema))) == [(1, 1), (2, 1), (11, 1)]
    assert rows(groups.consolidate(frame([], schema))) == []


# 2 listings


def test_units_agree_across_notations():
    a = listing_forms.read_listing("Acmecam AB-1234 Top Seller", listing_forms.fields("brand: Acmecam weight: 24.8 oz screen: 7.6 cm resolution: 50800000 zoom: 10x"), {"acmecam": 9})
    b = listing_forms.read_listing("ACMECAM ab1234 50.8 MP | Shop", listing_forms.fields("Hersteller: Acmecam Gewicht: 703g Bildschirm: 3 in Zoomfaktor: 10x"), {"acmecam": 9})
    assert a[0] == b[0] and a[1] == b[1] == ["ab1234"] and a[2]["mp"] == b[2]["mp"] and a[2]["screen"] == b[2]["screen"]
    assert set(a[2]["weight"]) & set(b[2]["weight"])


def test_sisters_and_accessories():
    near = name_forms.within
    assert listing_forms.models_agree(["ab1234"], ["ab1234+lite"], near) == "sister"
    assert listing_forms.models_agree(["ab1234+pro"], listing_forms.model_names("AB 1234 professional", set()), near) == "same"
    assert listing_forms.models_agree(["ab1234"], ["ab1243"], near) == "near"
    assert listing_forms.read_listing("Neck Strap for Acmecam AB-1234", listing_forms.fields("type: neck strap compatible with: Acmecam AB1234"), {"acmecam": 9})[3]
    assert listing_forms.brand_of(["acmecm"], ["new", "acmecam"], {"acmecam": 90, "acmecm": 4}) == "acmecam"
    assert listing_forms.brand_of(["rarecam"], ["like", "acmecam"], {"acmecam": 90, "rarecam": 4}) == "rarecam"


def test_listing_pairs(frame):
    base = [("Acmecam AB-1234 Black", "brand: Acmecam resolution: 20 MP zoom: 5x weight: 500 g"), ("NEW acmecam ab1234 | Shop", "make: Acmecam megapixels: 20000000 weight: 0.5 kg"), ("Acmecam AB 1234 lite", "brand: Acmecam resolution: 20 MP"), ("Battery for Acmecam AB-1234", "compatible with: Acmecam AB1234"), ("Camera", None), ("", " "), ("Acmecam AB-1234", "brand: Acmecam resolution: 33 MP")]
    data = [(i + 1, t, x, "clash") for i, (t, x) in enumerate(base)]
    fill = [(100 + i, f"Othera CD-{2000 + i}", f"brand: Othera resolution: {10 + i} MP zoom: {i}x " + "long " * 3000) for i in range(12)]
    df = frame([*data, data[0], *[(*f, None) for f in fill], *[(200 + i, "x", "brand: Acmecam", None) for i in range(3)]], "id long, page_title string, text string, brand string")
    assert rows(listings.same_item_pairs(df)) == [(1, 2)]
    assert rows(listings.same_item_pairs(df.limit(0))) == []


def test_listing_links_are_complete(spark, frame):
    from matchloom.session import Scratch

    rng = random.Random(23)
    measures = listings.MEASURES
    base = [{a: f"{a}:{rng.randrange(8)}" for a in measures} for _ in range(30)]
    # one and two share zoom, iso and frame rate alone
    data = [(1, "x", [], {"zoom": "zoom:z", "iso": "iso:z", "fps": "fps:z", "mp": "mp:1"}), (2, "x", [], {"zoom": "zoom:z", "iso": "iso:z", "fps": "fps:z", "screen": "screen:1"})]
    for i in range(3, 160):
        data.append((i, rng.choice("xy"), [f"ab{rng.randrange(1000, 1040)}"] if rng.random() < 0.3 else [], {a: v for a, v in base[i % 30].items() if rng.random() < 0.5}))
    df = frame([(i, b, m, *[s.get(a) for a in measures]) for i, b, m, s in data], "id long, brand string, models array<string>, " + ", ".join(f"{a} string" for a in measures))
    n = len(data)
    rated = listings.weighted(df, n, Scratch(spark, "links"))
    w = {r["id"]: r["w"] for r in rated.collect()}
    want = set()
    for (i, b, m, s), (j, c, o, t) in itertools.combinations(data, 2):
        both = set(s) & set(t)
        off = [a for a in both if s[a] != t[a]]
        if b != c or set(off) & set(listings.ATTRIBUTES) or {"g0", "g1"} <= set(off) or i not in w or j not in w:
            continue
        evidence = sum(w[i][s[a]] for a in both if s[a] == t[a])
        if set(m) & set(o) or (evidence >= np.log(n) + listings.MARGIN and listing_forms.models_agree(m, o, name_forms.within) in ("open", "near")):
            want.add((i, j))
    assert set(rows(listings.listing_links(rated, n))) == want and (1, 2) in want


# 3 names


def test_names_are_read():
    read = name_forms.read_name
    assert read("Fds, Glelox Indsutries") == read("The GLELOX industries foods G.m.b.H.")
    assert read("Flirk, Kate & Sons Maine GmbH")[:2] == read("Katherine Flirk and Sons Mar.")[:2]
    assert read("Freilt & Deinb Fds AG")[2] == read("Deinb and Freilt Foods")[2]
    assert read(None) == read("  ") == ("", "", [])


def test_within_matches_brute_force():
    def dist(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(2)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(2))
        assert name_forms.within(a, b, 2) == (dist(a, b) <= 2)


def test_segment_join_is_complete(frame):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(7, 11))) for _ in range(60)}
    words |= {w[:i] + rng.choice("abcd") + w[i + 1 :] for w in list(words) for i in (rng.randrange(len(w)),)} | {w[1:] for w in list(words)[:10]}
    n = [(i, "x", "", w, None, "t", None, None) for i, w in enumerate(sorted(words))]
    df = frame(n, "id long, context string, given string, p1 string, p2 string, place string, country string, year int")
    for k in (1, 2, 3):
        got = {(r["l"], r["r"]) for r in names.segment_join(df, df, ["context"], k).select(F.least("a.id", "b.id").alias("l"), F.greatest("a.id", "b.id").alias("r")).collect()}
        lev = df.alias("a").crossJoin(df.alias("b")).where("a.id < b.id").select("a.id", F.col("b.id").alias("o"), F.levenshtein("a.p1", "b.p1").alias("d"), F.least(F.length("a.p1"), F.length("b.p1")).alias("n"))
        want = {(r["id"], r["o"]) for r in lev.collect() if r["d"] <= min(k, 2 if r["n"] <= 6 else k)}
        assert got == want


def test_spellings(frame):
    schema = "id long, name string, city string, country_code string, founded_year int, context string"
    data = [(1, "Querkmurk Services Logistics", "A", "GB", 1970, "c"), (2, "Querkmrk Serv ices Lgstcs Ltd", "a", "GB", 1970, None), (3, "Querkmurk Services Foods", "A", "GB", 1970, "c"), (4, None, "A", None, None, "c"), (5, "", None, None, None, "c"), (6, "P. Veilpeara & Sons Energy", "B", None, 1984, "c"), (7, "Veilpeara, Phil & Sons enrg.", "B", "NL", None, "c"), (8, "Robert Veilpeara & Sons Energy", "B", "NL", 1984, "c"), (9, "x " * 20_000, None, None, None, "c")]
    df = frame([*data, data[0]], schema)
    assert rows(groups.group_pairs(names.spelling_groups(df))) == [(1, 2), (6, 7)]
    assert rows(names.spelling_groups(df.limit(0))) == []


def test_spellings_meet_under_any_nulls(frame):
    # every combination of nulls on both sides, each pair with a name of its own; nothing stated contradicts
    rng = random.Random(24)
    data, want = [], set()
    for i, (x, y) in enumerate(itertools.product(itertools.product((True, False), repeat=3), repeat=2)):
        core = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
        for j, (place, country, year) in enumerate((x, y)):
            data.append((2 * i + j, core if j == 0 else core[:4] + "x" + core[5:], f"Town{i}" if place else None, "GB" if country else None, 1970 if year else None))
        want.add((2 * i, 2 * i + 1))
    df = frame([(i, "c", "", p, None, t and t.lower(), c, y) for i, p, t, c, y in data], "id long, context string, given string, p1 string, p2 string, place string, country string, year int")
    assert set(rows(names.spelling_links(df))) == want


# 4 splits


@pytest.mark.parametrize("per_task", [500_000, 7])
def test_union_find_matches_brute_force(frame, per_task):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(300, 330)]
    want = brute_groups([e for e in edges if e[0] != e[1]])
    assert rows(splits.union_find(frame(edges, "a long, b long"), rows_per_task=per_task)) == want


def test_splits_keep_groups_and_shares(frame):
    rng = random.Random(9)
    data = [(f"k{rng.randrange(60)}", f"r{rng.randrange(900)}", "x") for _ in range(600)] + [(None, "r1", "x"), ("solo", None, "x")]
    df = frame(data, "key string, rec string, split string")
    out = splits.assign_splits(df, "key", ["rec"])
    got = {r["key"]: (r["group"], r["split"], r["n_rows"]) for r in out.collect()}
    assert set(got) == {k for k, _, _ in data if k}
    by_group = {}
    for g, s, n in got.values():
        assert by_group.setdefault(g, s) == s
    owner = {}
    for k, r, _ in data:
        if k and r:
            assert got[owner.setdefault(r, k)][0] == got[k][0]
    assert rows(splits.assign_splits(df.limit(0), "key", ["rec"])) == []


def test_greedy_equals_one_by_one():
    rng = random.Random(10)
    parts = {"a": 0.6, "b": 0.2, "c": 0.2}
    for _ in range(60):
        sizes = sorted(((s, rng.randrange(1, 40)) for s in rng.sample(range(1, 30), 6)), reverse=True)
        total = sum(s * n for s, n in sizes)
        gap = {k: v * total for k, v in parts.items()}
        want = {s: dict.fromkeys(parts, 0) for s, _ in sizes}
        for s, n in sizes:
            for _ in range(n):
                k = max(gap, key=gap.get)
                gap[k] -= s
                want[s][k] += 1
        assert splits.greedy_shares(sizes, parts) == {s: list(x.values()) for s, x in want.items()}


def test_greedy_plan_has_one_entry_a_size():
    plan = splits.greedy_shares([(1, 10**6)], {"train": 0.6, "validation": 0.2, "test": 0.2})
    assert plan == {1: [600_000, 200_000, 200_000]}
    many = splits.greedy_shares([(s, 10**9 // s) for s in range(1, 2_000)], {"train": 0.6, "rest": 0.4})
    assert len(many) == 1_999 and all(sum(x) == 10**9 // s for s, x in many.items())


def test_union_find_spreads_a_giant_star(spark):
    star = spark.range(1, 30_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chains = spark.range(0, 3_000).select((F.col("id") + 100_000).alias("a"), (F.col("id") + 100_001).alias("b")).where("id % 10 <> 9")
    for most in (2_000_000, 4_000):
        got = splits.union_find(star.union(chains), rows_per_task=most).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        assert rows(got.where("root = 0")) == [(0, 30_001)] and got.where("root >= 100000 and n = 10 and root % 10 = 0").count() == 300


def test_group_pairs_cut_large_groups(frame):
    g = frame([(i, 0) for i in range(90)] + [(100, 1), (101, 1), (200, 2)], "id long, group_id long")
    want = [(i, j) for i in range(90) for j in range(i + 1, 90)] + [(100, 101)]
    assert rows(groups.group_pairs(g)) == sorted(want)
    from matchloom.functions.skew import sliced_join

    a, b = g.select("group_id", F.col("id").alias("lid")), g.select("group_id", F.col("id").alias("rid"))
    assert rows(sliced_join(a, b, ["group_id"], "rid", 7).where("lid < rid").select("lid", "rid")) == sorted(want)


# 5 terms


def test_terms(frame):
    data = [(1, "Vekso vekso pump, the pump of the mill", "a"), (2, "vekso makes the mill", "b"), (3, None, "c"), (4, "", "d"), (1, "Vekso vekso pump, the pump of the mill", "z"), (5, "mill mill of the mill " * 2000, "e"), (None, "vekso vekso", "f")]
    df = frame(data, "id long, description string, term string")
    z = log_odds(df)
    assert rows(shared_rare_terms(z)) == [(1, "vekso"), (5, "mill")]
    t = {(r["id"], r["term"]): r for r in z.collect()}
    assert t[1, "vekso"]["z"] > t[2, "mill"]["z"] and t[1, "vekso"]["df"] == 2
    assert rows(log_odds(df.limit(0))) == []


def test_shared_rare_terms_make_no_score(spark, frame, tmp_path):
    """Nothing is joined that p5_found doesn't read: its counts meet the records' numbers once, the lengths for the score never."""
    from matchloom.llm.catalog import p5_found, p5_scores

    data = [(1, "Vekso vekso pump, the pump of the mill"), (2, "vekso makes the mill"), (3, None), (5, "mill mill of the mill " * 20), (None, "vekso vekso")]
    frame(data, "id long, description string").write.parquet(f"{tmp_path}/companies.parquet")
    found = p5_found(spark, str(tmp_path))
    assert rows(found) == [(1, "vekso"), (5, "mill")] == rows(shared_rare_terms(p5_scores(spark, str(tmp_path))))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


# 6 linking


def test_linking_needs_more_than_a_name(frame):
    schema = "id long, data_source_id string, name string, description string, city string, country_code string, founded_year int, src string"
    rng = random.Random(12)
    syl = ["bra", "kel", "mon", "tir", "vas", "dul", "fin", "gor"]
    data, truth = [], []
    for e in range(40):
        core = "".join(rng.choice(syl) for _ in range(3)).title()
        for s in ("1", "2"):
            i = len(data)
            name = core if s == "1" else core[:2] + core[3:]
            data.append((i, s, f"{name} Foods Ltd", f"Sold under the Q{core[::-1].lower()} label.", f"Town{e % 7}", "DE", 1950 + e, "x"))
            truth.append((i, e))
    data += [(900, "1", None, None, None, None, None, None), (901, "2", "", "", "", "", None, None), (None, "1", "x", "x", "x", "x", 1, "x"), data[0]]
    df = frame(data, schema)
    out = linking.link_sources(df, df.limit(0), frame([], "id long, entity long"))
    got = {(r["lid"], r["rid"]) for r in out.collect()}
    want = {(2 * e, 2 * e + 1) for e in range(40)}
    assert len(got & want) >= 38 and len(got - want) <= 1
    assert rows(linking.link_sources(df.limit(0), df.limit(0), frame([], "id long, entity long"))) == []


@pytest.mark.parametrize("floor", [0.0, 0.2, 0.4])
def test_nearest_score_all_shared_terms(spark, frame, floor):
    from collections import Counter

    from matchloom.session import Scratch

    rng = random.Random(21)
    # common terms (towns), rarer ones and single ones, of unequal weight; no pair is told apart by one rare term alone
    bags = {i: (str(i % 3), {f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(2, 9))} | {f"u{i}"}) for i in range(45)}
    weight = lambda t: 1.5 if t[-1] in "13579" else 1.0
    data = [(i, src, t, weight(t)) for i, (src, bag) in bags.items() for t in sorted(bag)]
    n, df = len(bags), Counter(t for _, bag in bags.values() for t in bag)
    kept = {i: {t for t in bag if df[t] >= 2} for i, (_, bag) in bags.items()}
    mean = sum(map(len, kept.values())) / n
    rarity = lambda t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) ** linking.IDF_POWER / np.log(n) ** (linking.IDF_POWER - 1)
    score = lambda q, d: sum(weight(t) * rarity(t) * 2.2 / (1 + 1.2 * (0.5 + 0.5 * len(kept[d]) / mean)) for t in kept[q] & kept[d])
    near = linking.bm25_nearest(frame(data, "id long, src string, term string, weight double"), n, Scratch(spark, "near"), floor).collect()
    got = {}
    for r in near:
        assert abs(r["s"] - score(r["q"], r["d"])) < 0.01 and bags[r["d"]][0] == r["side"] != bags[r["q"]][0]
        got.setdefault((r["q"], r["side"]), []).append(r["s"])
    least, some = floor * np.log(n), 0
    for q, side in itertools.product(bags, "012"):
        if side != bags[q][0]:
            want = sorted((score(q, d) for d in bags if bags[d][0] == side and kept[q] & kept[d] and min(score(q, d), score(d, q)) >= least), reverse=True)
            some += len(want)
            assert np.allclose(sorted(got.get((q, side), []), reverse=True), want[:2], atol=0.01)
    assert some


def test_common_terms_weigh(spark, frame):
    from matchloom.session import Scratch

    # ten words, each known to some 60 of 120 records
    rng = random.Random(22)
    bags = [frozenset(rng.sample("abcdefghij", 5)) for _ in range(60)]
    data = [(2 * i + j, str(j), f"t:{w}", 1.0) for i, bag in enumerate(bags) for j in (0, 1) for w in bag]
    near = linking.bm25_nearest(frame(data, "id long, src string, term string, weight double"), 120, Scratch(spark, "common"), 0.0)
    best = {r["q"]: r["d"] for r in near.where("rank = 1").collect()}
    assert len(best) == 120 and all(bags[q // 2] == bags[d // 2] for q, d in best.items())


def test_logistic_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w = linking.fit_logistic(x, y)
    assert (((x @ w[1:] + w[0]) > 0) == (y > 0)).mean() > 0.97


# 7 overlap


def test_overlap(frame):
    text = "brand: Acme color: red price: 12 weight: 300 g zoom: 5x screen: 3 in iso: 100 fps: 8 video: 4K battery: AB-1 model: ZZ1"
    near = text.replace(":", "=").replace("red", "blue").upper()
    other = "zoom: 9x brand: Acme video: 4K iso: 6400 price: 99 color: red model: ZZ1 battery: AB-1 fps: 8"
    cam = frame([(1, "Acme ZZ1 | Shop", text, "s//1"), (2, "ACME ZZ1 - Other", near, "s//2"), (3, "Acme ZZ1", other, "t//3"), (4, "Acme", None, "t//4"), (5, "Acme", None, "t//5"), (1, "Acme ZZ1 | Shop", text, "s//1"), (6, "y", "w " * 20_000, "t//6")], "id long, page_title string, text string, spec_id string")
    p = lambda *x: frame([(a, b, 1) for a, b in x], "lid long, rid long, label int")
    train, val, test = p((1, 4), (6, None)), p((2, 5)), p((3, 1), (4, 77))
    o = split_overlap.cross_split_overlaps(cam, train, {"val": val, "test": test})
    assert rows(split_overlap.overlap_pairs(o)) == [("test", 1, 1), ("test", 4, 4), ("val", 1, 2)]
    assert split_overlap.overlap_report(o, cam).agg(F.sum("n_pairs")).first()[0] == 3
    assert rows(split_overlap.overlap_pairs(split_overlap.cross_split_overlaps(cam.limit(0), train.limit(0), {"val": val.limit(0)}))) == []


def test_near_classes_match_brute_force(frame):
    from collections import Counter

    rng = random.Random(13)
    base = [[f"w{rng.randrange(40)}" for _ in range(30)] for _ in range(15)]
    other = [[w if rng.random() > 0.05 else "zz" for w in b] for b in base] + [[f"w{rng.randrange(40)}" for _ in range(30)] for _ in range(10)]
    a = frame([(f"a{i}", w) for i, w in enumerate(base)], "class string, words array<string>")
    b = frame([(f"b{i}", w) for i, w in enumerate(other)], "class string, words array<string>")
    want = set()
    for (i, x), (j, y) in itertools.product(enumerate(base), enumerate(other)):
        gx, gy = ({tuple(w[k : k + 3]) for k in range(28)} for w in (x, y))
        if len(gx & gy) >= 0.6 * max(len(gx), len(gy)) and sum((Counter(x) & Counter(y)).values()) >= 24:
            want.add((f"a{i}", f"b{j}"))
    found = split_overlap.near_classes(a, b).collect()
    assert {(r["class_a"], r["class_b"]) for r in found} == want and want
    for r in found:
        gx, gy = ({tuple(w[k : k + 3]) for k in range(28)} for w in (base[int(r["class_a"][1:])], other[int(r["class_b"][1:])]))
        assert abs(r["containment"] - len(gx & gy) / len(gx)) < 1e-9


@pytest.mark.parametrize("round_grams", [4_000_000, 40])
def test_near_classes_in_rounds(frame, monkeypatch, round_grams):
    from collections import Counter

    monkeypatch.setattr(split_overlap, "ROUND_GRAMS", round_grams)
    rng = random.Random(23)
    texts = [[f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 200]))] for _ in range(40)]
    texts += [[w if rng.random() > 0.04 else "zz" for w in t] for t in texts]
    data = [(i, t) for i, t in enumerate(texts)]
    want = set()
    for (i, x), (j, y) in itertools.product(data, data):
        gx, gy = ({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for w in (x, y))
        if i != j and x and y and 5 * len(gx & gy) >= 3 * max(len(gx), len(gy)) and 5 * sum((Counter(x) & Counter(y)).values()) >= 4 * max(len(x), len(y)):
            want.add((i, j))
    a = frame(data, "class long, words array<string>")
    assert {(r["class_a"], r["class_b"]) for r in split_overlap.near_classes(a, a).collect()} == want and want


def test_near_classes_write_no_candidates(frame, monkeypatch):
    """90,000 pairs share enough grams, but their words differ: they must not reach the disk, nor must each gram's row."""
    from matchloom.session import Scratch

    written, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, name, df: written.append((name, (t := put(self, name, df)).count())) or t)
    common = [f"c{k}" for k in range(20)]
    a = frame([(f"a{i}", common + [f"a{i}x{k}" for k in range(10)]) for i in range(300)], "class string, words array<string>")
    b = frame([(f"b{i}", common + [f"{'a' if i == 7 else 'b'}{i}x{k}" for k in range(10)]) for i in range(300)], "class string, words array<string>")
    assert [(r["class_a"], r["class_b"]) for r in split_overlap.near_classes(a, b).collect()] == [("a7", "b7")]
    assert max(n for _, n in written) < 10_000, written


def test_lean_scratch_leaves_no_shuffle_files(spark):
    from matchloom.session import FILE_CLEANUP, Scratch

    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").count("shuffle_")
    spark._jvm.System.gc()
    before = kept()
    t = Scratch(spark, "lean", lean=True).put("t", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before and t.count() == 7
    assert spark.conf.get(FILE_CLEANUP, "false") == "false"


# 8 packing


def test_plan_holds_everything():
    rng = random.Random(14)
    for _ in range(15):
        hist = {rng.randrange(1, 257): rng.randrange(1, 400) for _ in range(40)}
        plan = packing.plan(hist, 256)
        held = {}
        for pattern, n in plan:
            assert sum(k * v for k, v in pattern.items()) <= 256
            for k, v in pattern.items():
                held[k] = held.get(k, 0) + v * n
        assert held == hist
        need = sum(k * v for k, v in hist.items()) / 256
        assert sum(n for _, n in plan) <= need * 1.35 + 2


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 6)), rng.random(12)
    x = packing.nnls(a, b)
    y = np.zeros(6)
    for _ in range(20000):
        y = np.maximum(0, y - 0.02 * a.T @ (a @ y - b))
    assert np.allclose(x, y, atol=1e-3)


def test_pack_cuts_only_long_items(frame):
    sizes = [(i, s) for i, s in enumerate([0, 0, None, 5, 2048, 2049, 5000, 700, 700, 648, 1, 5])]
    got = packing.pack(frame(sizes, "id long, size long"), 2048).collect()
    load, parts = {}, {}
    for r in got:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["size"]
        parts.setdefault(r["id"], []).append((r["piece"], r["start"], r["size"]))
    assert max(load.values()) <= 2048 and len(parts) == len(sizes)
    assert sorted(parts[6]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and len(parts[4]) == 1
    assert packing.pack(frame([], "id long, size long")).count() == 0
    assert packing.pack(frame([(1, 0), (2, None)], "id long, size long")).select("container_id").distinct().collect() == [(0,)]


def test_pack_texts_counts_tokens(frame):
    df = frame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 30_000, "x")], "doc_id long, text string, size string")
    got = {}
    for r in packing.pack_texts(df).collect():
        got[r["id"]] = got.get(r["id"], 0) + r["size"]
    assert got == {1: 2, 2: 0, 3: 0, 4: 30_001}


# 9 leakage

ITEM = "Since 1966 the Sleirk office of Rultpauth has sold Lundwick while Heiltdrost once stored 38299 crates of Curkslan beside the old Gumgaulo mill."


def test_leaks(frame):
    w = ITEM.split()
    spoiled = " ".join("other" if i in (4, 18) else x for i, x in enumerate(w))
    docs = [(1, "Intro text. " + ITEM.upper() + " More."), (2, "a b c " + " ".join(w[3:18]) + " d e f"), (3, " ".join(w[2:12]) + " and nothing else follows here at all today"), (4, "> " + spoiled.replace("Lundwick", "<b>Lund-\nwick</b>")), (5, None), (6, ""), (7, "Answer with yes or no and give one reason. " + "other words " * 9000), (1, ITEM)]
    items = frame([(10, "Answer with yes or no and give one reason. " + ITEM, "t"), (11, "Answer with yes or no and give one reason. Quite different words follow in this item, none of which stands in any of the other texts here.", "t"), (12, None, "t"), (13, "Short item text.", "t")], "item_id long, text string, task string")
    d = frame([(*x, "s") for x in docs], "doc_id long, text string, item_id string")
    assert rows(leakage.leaked_items(d, items)) == [(1, 10), (2, 10), (4, 10)]
    assert rows(leakage.leaked_items(d.limit(0), items)) == rows(leakage.leaked_items(d, items.limit(0))) == []


def test_leaks_with_a_word_more_or_less(frame, monkeypatch):
    w = ITEM.split()
    more, less, two = w[2:9] + ["indeed"] + w[9:17], w[2:9] + w[10:18], w[2:7] + ["so"] + w[7:12] + ["it"] + w[12:17]
    docs = [(i, "Here it begins at last. " + " ".join(x) + " and then it ends for good.") for i, x in enumerate((more, less, two, w[2:17], w[2:15]))]
    d = frame(docs, "doc_id long, text string")
    items = frame([(10, ITEM), (11, "Quite different words follow in this item, none of which stands in any of the other texts here today.")], "item_id long, text string")
    assert rows(leakage.leaked_items(d, items)) == [(0, 10), (1, 10), (3, 10)]
    # more items than one index takes
    monkeypatch.setattr(leakage, "ITEMS_PER_INDEX", 1)
    assert rows(leakage.leaked_items(d, items)) == [(0, 10), (1, 10), (3, 10)]


def test_alignment_against_edit_distance():
    rng = np.random.default_rng(6)

    def near(p, item):
        n = len(item)
        subs = int((p[1 : n + 1] != item).sum()) <= 1
        more = any(list(item) == [*p[1 : k + 1], *p[k + 2 : n + 2]] for k in range(n))
        less = any([*item[:k], *item[k + 1 :]] == list(p[1:n]) for k in range(n))
        return subs or more or less

    passages = rng.integers(0, 2, size=(4000, 8))
    items = rng.integers(0, 2, size=(4000, 6))
    ok, held = leakage.aligned(passages, items, 1)
    assert ok.tolist() == [near(p, i) for p, i in zip(passages, items)] and held.shape == (4000, 5)


def test_hamming_index_is_complete():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, size=400, dtype=np.uint64)
    probe = base[:100].copy()
    for i in range(100):
        for bit in rng.choice(64, size=i % 9, replace=False):
            probe[i] ^= np.uint64(1) << np.uint64(bit)
    q, f = leakage.HammingIndex(base, 6).near(probe)
    want = {(i, j) for i in range(100) for j in range(400) if bin(int(probe[i] ^ base[j])).count("1") <= 6}
    assert set(zip(q.tolist(), f.tolist())) == want


# 10 residue


def test_residue(frame):
    real = ["The firm sold 12 pumps in 1999.", "The register shows three spellings.", "Orders rose by 4 percent in 2001.", "The job took 40 minutes instead of 20."]
    docs = [(i, " ".join(random.Random(i).sample(real, 3))) for i in range(60)]
    docs += [(100, "404 Not Found. The page you requested does not exist on this server."), (101, "The firm sold 12 pumps in 1999. Dear {{name}}, your order was reviewed."), (102, "Lorem ipsum dolor sit amet."), (103, "Please enable JavaScript to view this page."), (104, None), (105, ""), (106, "---"), (107, 'The guideline shows the pattern "{{name}}" as an example of what must be filled in. Orders rose by 4 percent in 2001.'), (108, "Filler such as \"lorem ipsum\" was found by a reader in 4 drafts and replaced."), (109, "The firm sold 12 pumps in 1999. " * 4000)]
    d = frame([(*x, "s") for x in docs], "doc_id long, text string, passage string")
    assert [r["doc_id"] for r in residue.residue_records(d).select("doc_id").orderBy("doc_id").collect()] == [100, 101, 102, 103]
    assert rows(residue.residue_records(d.limit(0))) == []


def test_model_rests_on_all_records(frame):
    # wordings that no list holds, in few of 20,000 records, beside sentences that speak about such things without quoting them
    stock = [f"The firm sold {w} pumps to {v} mills." for w in ("old", "new", "red", "big") for v in ("two", "four", "many", "few")]
    docs = [(i, f"{stock[i % 16]}\n{'home' if i % 50 else 'about us'}\n{stock[i * 7 % 16]}") for i in range(20_000)]
    known = ["Please enable JavaScript to view this page.", "404 Not Found.", "503 Service Unavailable.", "Lorem ipsum dolor sit amet.", "Your description here.", "Your browser does not support JavaScript."]
    docs += [(50_000 + i, known[i % 6]) for i in range(60)]
    new = ["Our booking form needs JavaScript, enable scripts in your browser.", "The page was not found on this server, sorry.", "Lorem sit amet dolor florp elit quis."]
    docs += [(60_000 + i, f"{stock[i]}\nabout us\n{new[i % 3]}") for i in range(9)]
    docs += [(70_000 + i, f"{stock[i]} In the audit of {1990 + i} the team counted listings that ask for JavaScript as empty and fixed them with the shop.") for i in range(9)]
    docs += [(80_000 + i, f"{stock[i]} Tags such as {{{{name}}}} were left by the import of {1990 + i}, and the team fixed them with the shop.") for i in range(9)]
    docs += [(85_000 + i, f'{stock[i]} The manual shows the pattern "{{{{name}}}}" as something that the team must fix.') for i in range(9)]
    docs += [(90_000 + i, f"Our shop in {{{{city}}}} sold {i} pumps.") for i in range(9)]
    got = {r["doc_id"] for r in residue.residue_records(frame(docs, "doc_id long, text string")).collect()}
    assert got == {50_000 + i for i in range(60)} | {60_000 + i for i in range(9)} | {90_000 + i for i in range(9)}


def test_cells_hold_every_feature():
    row, cell, field = residue.coded(["a b a", "a b a", "{{x}} a b a", "", "word " * 50_000])
    sets = [set(cell[row == i].tolist()) for i in range(5)]
    assert sets[0] == sets[1] and not sets[0] & sets[2] and field.tolist() == [False, False, True, False, False] and len(sets[4]) == 4


# tables


def test_views(frame):
    c = frame([(1, " a1", "5"), (2, "B2", "5"), (3, None, "5")], "id long, external_id string, data_source_id string")
    m = frame([(7, "A1 ", "5"), (None, "b2", "5"), (8, None, "5")], "gen_id long, external_id string, data_source_id string")
    e = company_entities(c, m)
    assert rows(e.where("entity is not null")) == [(1, 7)] and rows(unmapped(c, e).select("id")) == [(3,)]
    cam = frame([(1, "s//1"), (2, "s//2")], "id long, spec_id string")
    assert rows(unlabelled(cam, frame([("E", "s//1"), ("F", None)], "entity_id string, spec_id string")).select("id")) == [(2,)]
