"""Problem 2: product listings that describe the same item.

Listings are read into tokens of one notation (brand with model name, and brand with each
measure).  Tokens are ordered by rarity; pairs that share a token of their prefixes are verified by their
weighted containment, the share of the weight that agrees in all that both state, and
the agreeing tokens must weigh enough for the size of the collection.  Links are clustered by stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.skew import lookup_join, sliced_join
from matchloom.llm.groups import group_pairs, hash_to_min
from matchloom.llm.listing_forms import fields, models_agree, read_listing, stated_brand, title_words
from matchloom.session import Scratch

ATTRIBUTES = ["mp", "zoom", "screen", "battery", "iso", "fps", "video", "sensor"]
#: The attributes and the weight's places on two grids.
MEASURES = [*ATTRIBUTES, "g0", "g1"]
#: A brand that at least so many listings state is looked for in titles.
BRAND_COUNT = 3
#: Evidence beyond log(listings) that listings without a common model name need: chance alone would call for about 5, and measures of one brand go together.
MARGIN = 8.0
#: Share of the weight of all that both state that must agree.
CONTAINMENT = 1.0


def known_brands(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, brands)``: the words of a listing's title and statements that are brands, with the number of listings that state them."""
    brands = parsed.select("id", F.explode("stated").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("stated")).where(F.col("stated") >= BRAND_COUNT)
    words = scratch.put("words", parsed.select("id", F.explode(F.array_distinct(F.concat("stated", "words"))).alias("word")))
    table = scratch.put("brands", words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(brands, "word"))
    hits = lookup_join(words, table, "word", "n")
    return hits.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "stated"))).alias("brands"))


def read_listings(listings: DataFrame, id_col: str = "id", title_col: str = "page_title", text_col: str = "text") -> DataFrame:
    """One row per listing of an item with a text: ``(id, brand, models, mp .. sensor, g0, g1)``.

    Of several rows of an id the smallest is read.  Listings without a text or a brand, and
    accessories, give no row.
    """
    scratch = Scratch(listings.sparkSession, "read-listings")
    one = (
        listings.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(text_col).alias("text"), F.col(title_col).alias("title")).alias("r"))
        .where("id is not null and r.text is not null and trim(r.text) <> ''")
        .groupBy("id").agg(F.min("r").alias("r"))
        .select("id", "r.text", F.coalesce("r.title", F.lit("")).alias("title"))
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [fields(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "title": b["title"], "keys": [list(x) for x in f], "values": [list(x.values()) for x in f], "stated": [sorted(set(stated_brand(x))) for x in f], "words": [title_words(t) for t in b["title"]]})

    parsed = scratch.put("parsed", one.mapInPandas(parse, "id long, title string, keys array<string>, values array<array<string>>, stated array<string>, words array<string>"))
    both = parsed.select("id", "title", "keys", "values").join(known_brands(parsed, scratch), "id", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, title, keys, values, known in zip(b["id"], b["title"], b["keys"], b["values"], b["brands"]):
                f = {k: list(v) for k, v in zip(keys, values)}
                brand, models, specs, accessory = read_listing(title, f, dict(known) if known is not None else {})
                if brand and not accessory:
                    w = specs.get("weight", [None, None])
                    rows.append((i, brand, models, *[specs.get(a, [None])[0] for a in ATTRIBUTES], w[0], w[1]))
            yield pd.DataFrame(rows, columns=["id", "brand", "models", *ATTRIBUTES, "g0", "g1"])

    schema = "id long, brand string, models array<string>, " + ", ".join(f"{a} string" for a in [*ATTRIBUTES, "g0", "g1"])
    return both.mapInPandas(read, schema)


def weighted(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Adds ``w``: a map from token to its weight log(n / listings with it), brand by brand."""
    tokens = F.filter(
        F.concat(F.array(*[F.col(a) for a in MEASURES]), F.transform("models", lambda m: F.concat(F.lit("m:"), m))), lambda t: t.isNotNull()
    )
    long = scratch.put("long", rows.select("id", "brand", F.explode(tokens).alias("t")).select("id", "t", F.concat_ws("|", "brand", "t").alias("token")))
    df = scratch.put("df", long.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("df", F.col("n")))
    half = F.when(F.col("t").startswith("g0:") | F.col("t").startswith("g1:"), 0.5).otherwise(1.0)
    w = lookup_join(long, df, "token", "n").select("id", F.struct("t", (half * F.log(F.lit(float(n)) / F.col("df"))).alias("w")).alias("e"))
    maps = w.groupBy("id").agg(F.map_from_entries(F.collect_set("e")).alias("w"))
    return rows.join(maps, "id")


def prefix_tokens(need: float) -> Column:
    """The prefix of a listing (column names as in :func:`weighted`): its model names and its rarest measures as ``(t, reach)``.

    The measures are ordered by weight, the lightest first; those up to which the weights stay below
    ``need`` are behind the prefix, so a listing whose measures weigh less has none (length filter).  The heaviest common
    measure of a pair whose common ones weigh ``need`` is in the prefix of both, so each such pair shares a token.  ``reach`` is
    the weight up to a token: the most that a pair can have in common if this is its rarest common measure (position filter).
    """
    stated = F.filter(F.array(*[F.struct(F.element_at("w", F.col(a)).alias("w"), F.col(a).alias("t")) for a in MEASURES]), lambda e: e["t"].isNotNull())

    def reach(e: Column) -> Column:
        return F.aggregate(F.filter(stated, lambda o: o <= e), F.lit(0.0), lambda total, o: total + o["w"])

    rated = F.transform(stated, lambda e: F.struct(e["t"].alias("t"), reach(e).alias("reach")))
    named = F.transform("models", lambda m: F.struct(F.concat(F.lit("m:"), m).alias("t"), F.lit(float("inf")).alias("reach")))
    # sums of another order may differ in the last digits
    return F.concat(named, F.filter(rated, lambda e: e["reach"] >= need - 1e-6))


def listing_links(rows: DataFrame, n: int, margin: float = MARGIN, containment: float = CONTAINMENT) -> DataFrame:
    """``(lid, rid)``, lid < rid: listings of which enough agrees in what both state, and that share enough.

    The tokens of the prefixes are joined, those of many listings in slices, with the id and the listing's measures as numbers:
    most pairs that meet contradict each other and go no further.
    """
    scratch = Scratch(rows.sparkSession, "links")
    need = math.log(max(n, 3)) + margin
    codes = [F.xxhash64(m).alias(f"c_{m}") for m in MEASURES]
    weights = [F.element_at("w", F.col(m)).cast("float").alias(f"w_{m}") for m in MEASURES]
    coded = [F.when(F.col(m).isNotNull(), c).alias(f"c_{m}") for m, c in zip(MEASURES, codes)]
    keyed = rows.select("id", "brand", *coded, *weights, F.transform("models", lambda m: F.xxhash64(m)).alias("models"), F.explode(prefix_tokens(need)).alias("e"))
    keyed = scratch.put("prefix", keyed.withColumn("key", F.xxhash64("brand", "e.t")).drop("brand", "e"))
    x = keyed.select("key", *[F.col(c).alias(f"a_{c}") for c in keyed.columns if c != "key"])
    y = keyed.select("key", *[F.col(c).alias(f"b_{c}") for c in keyed.columns if c != "key" and not c.startswith("w_")])
    agree, clash = F.lit(0.0), F.lit(0.0)
    for m in MEASURES:
        same, weight = F.col(f"a_c_{m}") == F.col(f"b_c_{m}"), F.col(f"a_w_{m}")
        agree = agree + F.when(same, weight).otherwise(0.0)
        if m in ATTRIBUTES:
            clash = clash + F.when(~same, F.greatest(weight, F.lit(1e-3))).otherwise(0.0)
    # two weights that differ on both grids
    clash = clash + F.when((F.col("a_c_g0") != F.col("b_c_g0")) & (F.col("a_c_g1") != F.col("b_c_g1")), 1.0).otherwise(0.0)
    met = sliced_join(x, y, ["key"], "b_id").where("a_id < b_id")
    rated = met.select(F.col("a_id").alias("lid"), F.col("b_id").alias("rid"), agree.alias("agree"), clash.alias("clash"), F.arrays_overlap("a_models", "b_models").alias("named"))
    # a common model name stands for all the weight; without one the measures alone must reach the bound
    kept = rated.where((F.col("agree") >= containment * (F.col("agree") + F.col("clash"))) & (F.col("named") | (F.col("agree") >= need - 1e-3)))
    kept = scratch.put("kept", kept.select("lid", "rid", "named").distinct())
    scratch.drop("prefix")
    unnamed = kept.where(~F.col("named")).join(rows.select(F.col("id").alias("lid"), F.col("models").alias("ma")), "lid").join(rows.select(F.col("id").alias("rid"), F.col("models").alias("mb")), "rid")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [models_agree(list(p), list(q)) in ("open", "near") for p, q in zip(b["ma"], b["mb"])]
            yield b.loc[ok, ["lid", "rid"]]

    return kept.where("named").select("lid", "rid").unionByName(unnamed.select("lid", "rid", "ma", "mb").mapInPandas(verify, "lid long, rid long"))


def star_clusters(links: DataFrame) -> DataFrame:
    """``(id, group_id)``: the links clustered by stars.

    Every listing follows its neighbour with most links (ties: smaller id) up to a centre that has none
    above it; the listings of one centre are a group, named by its smallest id.
    """
    scratch = Scratch(links.sparkSession, "stars")
    both = links.select(F.col("lid").alias("v"), F.col("rid").alias("u")).unionByName(links.select(F.col("rid").alias("v"), F.col("lid").alias("u")))
    both = scratch.put("both", both)
    degree = scratch.put("degree", both.groupBy("v").agg(F.count(F.lit(1)).alias("d")).withColumn("n", F.col("d")))
    rank = F.struct(F.col("d"), (-F.col("u")).alias("neg"))
    up = lookup_join(both, degree.withColumnRenamed("v", "u"), "u", "n").select("v", "u", "d").unionByName(degree.select("v", F.col("v").alias("u"), "d"))
    return hash_to_min(up.groupBy("v").agg(F.max_by("u", rank).alias("u")).where("u <> v").select(F.col("v").alias("a"), F.col("u").alias("b")))


def same_item_groups(listings: DataFrame, **columns: str) -> DataFrame:
    """``(id, group_id)`` of all listings with another listing of the same item.

    Nulls, blanks, repeated rows, extra columns: see :func:`read_listings`.  An empty table gives
    an empty result.
    """
    scratch = Scratch(listings.sparkSession, "listings")
    rows = scratch.put("rows", read_listings(listings, **columns))
    n = rows.count()
    rows = scratch.put("weighted", weighted(rows, n, scratch))
    links = scratch.put("links", listing_links(rows, n))
    return star_clusters(links)


def same_item_pairs(listings: DataFrame, **columns: str) -> DataFrame:
    """``(lid, rid)``, lid < rid: all pairs of one group."""
    return group_pairs(same_item_groups(listings, **columns))
