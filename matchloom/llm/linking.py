"""Problem 6: matching entities across sources that share no key.

Every record becomes a bag of terms over all its attributes; an inverted index finds every pair of
different sources whose BM25 score, over all terms that the two share, reaches a floor.  The index holds of
each record only the rare terms that an exact upper bound requires.  A pair is kept if each is the
other's nearest in its source; its confidence comes from the scores, the gaps to the second best
and the agreement of attributes by a logistic calibration.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.skew import lookup_join, sliced_join
from matchloom.llm.groups import group_pairs, hash_to_min
from matchloom.llm.name_forms import plain, read_name
from matchloom.session import Scratch

_SUFFIX = re.compile(r"\s*(?:\([^()]*\)|\b[A-Z]{2})\s*$")
_TERM = re.compile(r"[a-z0-9à-ÿ]+")
_YEAR = re.compile(r"\b(1[89]\d\d|20[0-4]\d)\b")
K1, B = 1.2, 0.5
#: Power of a term's idf in its weight; above 1, a rare term that two records share says more than many common ones of the same sum.
IDF_POWER = 3.0
#: Score, in units of log(records) (about the idf of a term of one record), below which no pair is an answer.
FLOOR = 0.6
#: Weights are whole units of 1/UNIT, so that their sums are the same in any order, and have the lowest WEIGHT_BITS of a term's code.
UNIT = 4096
WEIGHT_BITS = 20
WEIGHT_MASK = (1 << WEIGHT_BITS) - 1
#: Words of this share of the records make a combination with place and year.
MID_SHARE = (0.002, 0.06)
#: At most about this many labelled records (whole entities, by hash) and pairs fit the calibration.
FIT_RECORDS = 40_000
FIT_PAIRS = 20_000


def read_records(records: DataFrame) -> DataFrame:
    """One row per id: ``(id, src, context, given, p1, p2, place, country, year, words)``.

    Of repeated rows of an id the smallest values are read.  Nulls in any attribute give no term.
    """
    one = (
        records.where("id is not null and data_source_id is not null")
        .groupBy("id")
        .agg(*[F.min(c).alias(c) for c in ("data_source_id", "name", "description", "city", "country_code", "founded_year")])
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, src, name, text, city, land, year in zip(
                b["id"], b["data_source_id"], b["name"], b["description"], b["city"], b["country_code"], b["founded_year"]
            ):
                name = name if isinstance(name, str) else ""
                context, first, parts = read_name(_SUFFIX.sub("", name))
                town = "".join(c for c in plain(city) if c.isalpha()) if isinstance(city, str) else None
                words = sorted({w for w in _TERM.findall(plain(text)) if len(w) >= 4}) if isinstance(text, str) else []
                years = sorted({int(w) for w in words if _YEAR.fullmatch(w)})
                y = None if pd.isna(year) else int(year)
                if y is None and len(years) == 1:
                    y = years[0]
                rows.append((i, src, context, first, parts[0] if parts else None, "".join(parts[1:]) or None, town or None, land if isinstance(land, str) else None, y, [w for w in words if not w.isdigit()]))
            out = pd.DataFrame(rows, columns=["id", "src", "context", "given", "p1", "p2", "place", "country", "year", "words"])
            out["year"] = out["year"].astype("Int32")
            yield out

    schema = "id long, src string, context string, given string, p1 string, p2 string, place string, country string, year int, words array<string>"
    return one.select(F.col("id").cast("long").alias("id"), F.col("data_source_id").cast("string").alias("data_source_id"), "name", "description", "city", "country_code", F.col("founded_year").cast("int").alias("founded_year")).mapInPandas(read, schema)


def deletion_terms(word: Column) -> Column:
    """Terms of the word without each of its letters: two words within one edit share one of them (or the word)."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n >= 5, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def terms_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, src, term, weight)``: the terms of every record, with field weights.

    Words and towns stand for themselves; words of middling frequency and business words also
    together with place and year.
    """
    n = rows.count()
    lo, hi = n * MID_SHARE[0], n * MID_SHARE[1]
    words = rows.select("id", F.explode("words").alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    mid = scratch.put("mid", df.where((F.col("df") >= max(lo, 3)) & (F.col("df") <= hi)).select("w", F.col("df").alias("n")))
    # at most (words per record) / MID_SHARE[0] such words, whatever the number of records
    mixed = lookup_join(rows.where("place is not null and year is not null").select("id", "src", "place", "year", F.explode("words").alias("w")), mid, "w", "n")
    combined = mixed.select("id", "src", F.concat_ws("|", F.lit("x:"), "place", F.col("year").cast("string"), "w").alias("term"), F.lit(0.5).alias("weight"))
    trade = rows.where("place is not null and year is not null").select("id", "src", "place", "year", F.explode(F.split("context", " ")).alias("w")).where("w <> ''")
    traded = trade.select("id", "src", F.concat_ws("|", F.lit("x:"), "place", F.col("year").cast("string"), F.concat(F.lit("b:"), "w")).alias("term"), F.lit(0.5).alias("weight"))
    single = rows.select("id", "src", F.explode("words").alias("w")).select("id", "src", F.concat(F.lit("t:"), "w").alias("term"), F.lit(1.0).alias("weight"))
    towns = rows.where("place is not null").select("id", "src", F.concat(F.lit("t:"), "place").alias("term"), F.lit(1.0).alias("weight"))
    names = rows.select("id", "src", F.explode(F.array_compact(F.array("p1", "p2"))).alias("p"))
    whole = names.select("id", "src", F.concat(F.lit("n:"), "p").alias("term"), F.lit(1.5).alias("weight"))
    cut = names.select("id", "src", F.explode(deletion_terms(F.col("p"))).alias("term"), F.lit(0.4).alias("weight"))
    every = combined
    for part in (traded, single, towns, whole, cut):
        every = every.unionByName(part)
    return every.groupBy("id", "src", "term").agg(F.max("weight").alias("weight"))


def rated_terms(terms: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``(id, src, t, df, w, f)``: the terms of every record as 64-bit hashes with their weights, and the record's length factor.

    ``w`` is field weight x idf^IDF_POWER in whole units of 1/UNIT, the same for a term in all records, and ``f`` the factor
    of BM25 for a term that is present (attributes are short: a term counts once a record).  The score of a record as
    an answer is the sum of ``w`` over the shared terms times its ``f``.  Terms of a single record can't be
    shared and are left out; all others count, however common.
    """
    terms = scratch.put("terms", terms)
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).where("n >= 2")
    unit = math.log(max(n, 3))
    idf = F.log(1 + (F.lit(float(n)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    w = F.round(F.col("weight") * UNIT * idf * F.pow(idf / unit, F.lit(IDF_POWER - 1))).cast("long")
    df = scratch.put("df", df.select("term", F.xxhash64("term").alias("t"), F.col("n").alias("df"), "n", F.least(w, F.lit(WEIGHT_MASK)).alias("w")))
    kept = scratch.put("kept", lookup_join(terms.select("id", "src", "term"), df, "term", "n").drop("term"))
    scratch.drop("terms")
    lengths = kept.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    mean = kept.count() / max(1, n)
    f = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    return kept.join(lengths.select("id", f.alias("f")), "id").select("id", "src", "t", "df", "w", "f")


def bm25_pairs(terms: DataFrame, n: int, scratch: Scratch, floor: float = FLOOR) -> DataFrame:
    """``(a, b, src_a, src_b, s_ab, s_ba)``, a < b: all pairs of different sources of which both scores reach the floor.

    ``s_ab`` is the score of b as an answer to a, over all terms that they share.  The terms of a record
    are ordered, the commonest first, in one order for all; those up to which the weights sum to less than the floor are
    behind its prefix.  The rarest shared term of a pair that reaches the floor is in the prefix of both,
    so the join of the prefixes finds every such pair, and each pair found is scored over all its terms.
    """
    least = floor * math.log(max(n, 3)) * UNIT
    by_df = Window.partitionBy("id").orderBy(F.desc("df"), "t").rowsBetween(Window.unboundedPreceding, 0)
    rated = scratch.put("rated", rated_terms(terms, n, scratch).withColumn("reach", F.sum("w").over(by_df)))
    scratch.drop("kept")
    code = F.shiftleft("t", WEIGHT_BITS).bitwiseOR(F.col("w"))
    bags = scratch.put("bags", rated.groupBy("id").agg(F.collect_list(code).alias("e"), F.first("f").alias("f")))
    # sums of doubles may differ in the last digits
    prefix = scratch.put("prefix", rated.where(F.col("reach") * F.col("f") >= least - 1e-6).select("t", "id", "src"))
    scratch.drop("rated")
    x, y = (prefix.select("t", F.col("id").alias(i), F.col("src").alias(f"src_{i}")) for i in "ab")
    met = sliced_join(x, y, ["t"], "b").where((F.col("a") < F.col("b")) & (F.col("src_a") != F.col("src_b")))
    met = scratch.put("met", met.select("a", "b", "src_a", "src_b").distinct())
    own = bags.select(F.col("id").alias("a"), F.col("e").alias("x"), F.col("f").alias("f_a"))
    other = bags.select(F.col("id").alias("b"), F.col("e").alias("y"), F.col("f").alias("f_b"))
    both = met.join(own, "a").join(other, "b").select("a", "b", "src_a", "src_b", "f_a", "f_b", F.array_intersect("x", "y").alias("shared"))
    total = F.aggregate("shared", F.lit(0).cast("long"), lambda s, c: s + c.bitwiseAND(F.lit(WEIGHT_MASK)))
    scored = both.select("a", "b", "src_a", "src_b", (total * F.col("f_b")).alias("s_ab"), (total * F.col("f_a")).alias("s_ba"))
    return scored.where(F.least("s_ab", "s_ba") >= least).withColumns({c: F.col(c) / UNIT for c in ("s_ab", "s_ba")})


def bm25_nearest(terms: DataFrame, n: int, scratch: Scratch, floor: float = FLOOR) -> DataFrame:
    """``(q, side, d, s, rank)``: the best two answers ``d`` of every other source ``side`` to the record ``q`` that reach the floor; ties go to the smaller id."""
    pairs = scratch.put("pairs", bm25_pairs(terms, n, scratch, floor))
    for name in ("bags", "prefix", "met", "df"):
        scratch.drop(name)
    there = pairs.select(F.col("a").alias("q"), F.col("src_b").alias("side"), F.col("b").alias("d"), F.col("s_ab").alias("s"))
    back = pairs.select(F.col("b").alias("q"), F.col("src_a").alias("side"), F.col("a").alias("d"), F.col("s_ba").alias("s"))
    w = Window.partitionBy("q", "side").orderBy(F.desc("s"), "d")
    return there.unionByName(back).withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def mutual_nearest(near: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs that are each other's best in the other's source, with the gaps to the second best.

    ``near`` is that of :func:`bm25_nearest`; where it has no second answer the gap is that to ``least``, the floor.
    """
    second = F.coalesce(F.min(F.when(F.col("rank") == 2, F.col("s"))), F.lit(least))
    best = near.groupBy("q", "side").agg(F.max_by("d", -F.col("rank")).alias("d"), F.max("s").alias("s"), second.alias("second"))
    x = best.where("q < d").select(F.col("q").alias("a"), F.col("d").alias("b"), F.col("s").alias("s_ab"), (F.col("s") - F.col("second")).alias("gap_a"))
    y = best.where("q > d").select(F.col("d").alias("a"), F.col("q").alias("b"), F.col("s").alias("s_ba"), (F.col("s") - F.col("second")).alias("gap_b"))
    return x.join(y, ["a", "b"])


FEATURES = ["score", "gap", "name", "near", "place", "place_off", "year", "year_off", "country", "country_off", "trade", "words", "given_off"]


def with_features(mutual: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Scores in units of log(records), gaps and the agreement of the attributes, all in 0..3."""
    unit = math.log(max(n, 3))
    wide = rows.select("id", "src", "context", "given", "p1", "p2", "place", "country", "year", "words")
    m = mutual.join(wide.select(F.col("id").alias("a"), F.struct(*[c for c in wide.columns if c != "id"]).alias("x")), "a").join(
        wide.select(F.col("id").alias("b"), F.struct(*[c for c in wide.columns if c != "id"]).alias("y")), "b"
    )

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    lev = F.levenshtein(F.concat_ws("", "x.p1", "x.p2"), F.concat_ws("", "y.p1", "y.p2"))
    has_names = F.col("x.p1").isNotNull() & F.col("y.p1").isNotNull()
    initial = (F.least(F.length("x.given"), F.length("y.given")) == 1) & (F.substring("x.given", 1, 1) == F.substring("y.given", 1, 1))
    years = F.abs(F.col("x.year") - F.col("y.year"))
    ctx = F.array_intersect(F.split("x.context", " "), F.split("y.context", " "))
    cols = {
        "score": F.least((F.col("s_ab") + F.col("s_ba")) / (2 * unit), F.lit(6.0)) / 2,
        "gap": F.least(F.least("gap_a", "gap_b") / unit, F.lit(3.0)),
        "name": flag(has_names & (lev == 0)),
        "near": flag(has_names & (lev > 0) & (lev <= 2)),
        "place": flag(F.col("x.place") == F.col("y.place")),
        "place_off": flag(F.levenshtein("x.place", "y.place") > 2),
        "year": flag(years <= 1),
        "year_off": flag(years > 1),
        "country": flag(F.col("x.country") == F.col("y.country")),
        "country_off": flag(F.col("x.country") != F.col("y.country")),
        "trade": flag((F.size(ctx) > 0) & (F.col("x.context") != "")),
        "words": F.least(F.size(F.array_intersect("x.words", "y.words")) / 10.0, F.lit(2.0)),
        "given_off": flag((F.col("x.given") != F.col("y.given")) & ~initial & (F.col("x.given") != "") & (F.col("y.given") != "")),
    }
    return m.select("a", "b", *[c.alias(k) for k, c in cols.items()])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients (intercept first) of a ridge-penalised logistic regression by Newton steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    pen = ridge * np.eye(z.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Coefficients used when there is no labelled pair to fit: intercept, then FEATURES.
PLAIN_WEIGHTS = np.array([-7.0, 3.0, 1.5, 4.0, 3.0, 2.0, -3.0, 1.5, -3.0, 0.7, -2.0, 0.7, 0.5, -4.0])


def candidates(records: DataFrame, label: str) -> DataFrame:
    """Mutual nearest pairs ``(a, b)`` of the records with FEATURES, written to the shared folder."""
    scratch = Scratch(records.sparkSession, label)
    rows = scratch.put("rows", read_records(records))
    n = rows.count()
    near = scratch.put("near", bm25_nearest(terms_of(rows, scratch), n, scratch))
    scratch.drop("pairs")
    scratch.drop("mid")
    out = scratch.put("mutual", with_features(mutual_nearest(near, FLOOR * math.log(max(n, 3))), rows, n))
    for name in ("rows", "near"):
        scratch.drop(name)
    return out


def calibrate(labelled: DataFrame, truth: DataFrame, fit_pairs: int = FIT_PAIRS) -> np.ndarray:
    """Logistic coefficients from candidates of labelled records; truth is (id, entity).

    A pair is right if its records share an entity.  At most ``fit_pairs`` pairs in hash order are
    used; without both right and wrong pairs the built-in coefficients stand.
    """
    t = truth.select("id", "entity").distinct()
    right = (
        labelled.join(t.withColumnRenamed("id", "a"), "a").withColumnRenamed("entity", "ea").join(t.withColumnRenamed("id", "b"), "b")
        .groupBy("a", "b").agg(F.max((F.col("ea") == F.col("entity")).cast("double")).alias("y"), *[F.first(f).alias(f) for f in FEATURES])
    )
    got = right.orderBy(F.xxhash64("a", "b"), "a", "b").limit(fit_pairs).select("y", *FEATURES).toPandas()
    if len(got) < 50 or got["y"].nunique() < 2:
        return PLAIN_WEIGHTS
    return fit_logistic(got[FEATURES].to_numpy(float), got["y"].to_numpy(float))


def with_confidence(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds ``confidence`` from FEATURES and the coefficients."""
    z = F.lit(float(weights[0]))
    for name, w in zip(FEATURES, weights[1:]):
        z = z + F.col(name) * F.lit(float(w))
    return pairs.withColumn("confidence", 1 / (1 + F.exp(-z)))


def fit_sample(labelled: DataFrame, truth: DataFrame, most: int = FIT_RECORDS) -> DataFrame:
    """Labelled records of so many entities, by the hash of the entity, that about ``most`` records remain."""
    home = truth.where("entity is not null").groupBy("id").agg(F.min("entity").alias("entity"))
    n = labelled.select("id").distinct().join(home, "id", "left_semi").count()
    if n <= most:
        return labelled
    share = F.pmod(F.xxhash64("entity"), F.lit(1_000_000)) < int(1_000_000 * most / n)
    return labelled.join(home.where(share).select("id"), "id", "left_semi")


def link_sources(records: DataFrame, labelled: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(lid, rid, confidence, kind)``: matches of ``records`` (columns of ``companies``) across sources.

    ``labelled`` are records with known entities ``truth`` (id, entity) for the calibration.
    Pairs at or above ``threshold`` are 'direct'; two records of different sources joined through
    others, in a group with at most one record per source, are 'joined' with the confidence of the
    weakest link of their group.  Null ids or sources give no row; an empty table an empty result;
    extra columns are not read.
    """
    scratch = Scratch(records.sparkSession, "link")
    weights = calibrate(candidates(fit_sample(labelled, truth), "link-fit"), truth)
    direct = with_confidence(candidates(records, "link-find"), weights).where(F.col("confidence") >= threshold)
    direct = scratch.put("direct", direct.select(F.col("a").alias("lid"), F.col("b").alias("rid"), "confidence"))
    groups = scratch.put("groups", hash_to_min(direct.select(F.col("lid").alias("a"), F.col("rid").alias("b"))))
    src = records.where("id is not null").groupBy("id").agg(F.min(F.col("data_source_id").cast("string")).alias("src"))
    member = groups.join(src, "id")
    clean = member.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("k")).where("n = k and n > 2").select("group_id")
    weakest = direct.join(groups.withColumnRenamed("id", "lid"), "lid").groupBy("group_id").agg(F.min("confidence").alias("confidence"))
    ends = group_pairs(member.join(clean, "group_id", "left_semi").select("id", "group_id"))
    joined = ends.join(groups.withColumnRenamed("id", "lid"), "lid").join(weakest, "group_id").select("lid", "rid", "confidence")
    new = joined.join(direct.select("lid", "rid"), ["lid", "rid"], "left_anti")
    return direct.withColumn("kind", F.lit("direct")).unionByName(new.withColumn("kind", F.lit("joined")))
