"""Problem 3: variant spellings of names typed by people.

Names are read into line of business, given name and names proper; the names proper are joined
by the pigeonhole principle: of k + 1 segments of one name at least one stands unchanged, at
most k places shifted, in any name within k edits.  Candidates are verified by banded edit
distance.  Names that agree on everything but a few letters must not contradict each other in
place, country or year.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.skew import sliced_join
from matchloom.llm.groups import hash_to_min
from matchloom.llm.name_forms import plain, read_name
from matchloom.session import Scratch


def read_names(records: DataFrame, id_col: str = "id", name_col: str = "name", place: str = "city", country: str = "country_code", year: str = "founded_year") -> DataFrame:
    """``(id, context, given, p1, p2, place, country, year)``: one row per id with a name proper.

    Of several rows of an id the smallest name is read.  Null, blank and letterless names, and names
    that are nothing but business words, give no row.
    """
    one = (
        records.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name"), F.col(place).alias("place"), F.col(country).alias("country"), F.col(year).cast("int").alias("year"))
        .where("id is not null and name is not null")
        .groupBy("id")
        .agg(F.min("name").alias("name"), F.min("place").alias("place"), F.min("country").alias("country"), F.min("year").alias("year"))
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name, city, land, y in zip(b["id"], b["name"], b["place"], b["country"], b["year"]):
                context, first, parts = read_name(name)
                if parts:
                    rest = "".join(parts[1:]) or None
                    town = "".join(c for c in plain(city) if c.isalpha()) if isinstance(city, str) else None
                    rows.append((i, context, first, parts[0], rest, town or None, land if isinstance(land, str) else None, None if pd.isna(y) else int(y)))
            out = pd.DataFrame(rows, columns=["id", "context", "given", "p1", "p2", "place", "country", "year"])
            out["year"] = out["year"].astype("Int32")
            yield out

    return one.mapInPandas(read, "id long, context string, given string, p1 string, p2 string, place string, country string, year int")


def segments(word: Column, k: int) -> Column:
    """The k + 1 even segments of a word as (len, seg, text); indexed side of the join."""
    n = F.length(word)

    def cut(i: Column) -> Column:
        lo, hi = F.floor(n * i / (k + 1)), F.floor(n * (i + 1) / (k + 1))
        return F.struct(n.alias("len"), i.alias("seg"), F.substring(word, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("text"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(k)), cut), lambda s: F.length(s["text"]) > 0)


def probes(word: Column, k: int) -> Column:
    """All (len, seg, text) that an indexed word within k edits of this one may hold, shifts bounded by position."""
    n = F.length(word)

    def at(length: Column, i: Column) -> Column:
        lo, hi = F.floor(length * i / (k + 1)), F.floor(length * (i + 1) / (k + 1))
        diff = n - length
        left = F.greatest(lo - i, lo + diff - (F.lit(k) - i), F.lit(0))
        right = F.least(lo + i, lo + diff + (F.lit(k) - i), n - (hi - lo))
        text = lambda p: F.struct(length.cast("int").alias("len"), i.alias("seg"), F.substring(word, (p + 1).cast("int"), (hi - lo).cast("int")).alias("text"))
        places = F.when((right >= left) & (hi > lo), F.sequence(left, right))
        return F.transform(F.coalesce(places, F.array().cast("array<long>")), text)

    lengths = F.sequence(F.greatest(n - k, F.lit(1)), n + k)
    per_length = F.transform(lengths, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: at(m.cast("long"), i.cast("long")))))
    return F.array_distinct(F.flatten(per_length))


def _entries(names: DataFrame, keys: list[str], entries, tag: str, mark: str) -> DataFrame:
    """``(key, <mark>)``: the entries of both names proper of every row, under its block keys, as one hash each, with the row's id."""
    parts = F.filter(F.array("p1", "p2"), lambda p: p.isNotNull() & (F.length(p) > 0))
    x = names.select("id", *keys, F.explode(parts).alias("part")).select("id", *keys, F.explode(entries(F.col("part"))).alias("e"))
    # rows with a null key meet none
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    key = F.xxhash64(F.lit(tag), *[F.col(k).cast("string") for k in keys], F.col("e.len").cast("int"), F.col("e.seg").cast("int"), "e.text")
    return x.where(known).select(key.alias("key"), F.col("id").alias(mark))


def met_pairs(passes: list[tuple[DataFrame, DataFrame, list[str], int]], more: DataFrame | None = None) -> DataFrame:
    """``(lid, rid)``, lid < rid: pairs of rows that meet at a segment in one of the passes (left, right, block keys, edits k).

    All passes are one join of an inverted index with its probes, over hashes and ids alone; a segment that very many
    names have is joined in slices.  ``more`` are further entries (key, id), each both indexed and probed.
    """
    index, probe = (more.select("key", F.col("id").alias(m)) if more is not None else None for m in ("a", "b"))
    for i, (left, right, keys, k) in enumerate(passes):
        x = _entries(left, keys, lambda p, k=k: segments(p, k), f"{i}", "a")
        y = _entries(right, keys, lambda p, k=k: probes(p, k), f"{i}", "b")
        index, probe = x if index is None else index.unionByName(x), y if probe is None else probe.unionByName(y)
    scratch = Scratch(index.sparkSession, "segments")
    index, probe = scratch.put("index", index), scratch.put("probe", probe)
    met = sliced_join(probe, index, ["key"], "a").where("a <> b")
    return met.select(F.least("a", "b").alias("lid"), F.greatest("a", "b").alias("rid")).distinct()


def _with_bodies(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    body = ["id", "context", "given", "p1", "p2", "place", "country", "year"]
    return pairs.join(left.select(F.col("id").alias("lid"), F.struct(*body).alias("a")), "lid").join(right.select(F.col("id").alias("rid"), F.struct(*body).alias("b")), "rid")


def _edits(k: int) -> Column:
    """Largest edit distance of the partners' names in the better pairing; k + 1 if there is none within k."""
    far = F.lit(k + 1)

    def lev(x: str, y: str) -> Column:
        d = F.levenshtein(F.col(x), F.col(y), k)
        return F.when(d < 0, far).otherwise(F.coalesce(d, far))

    straight = F.greatest(lev("a.p1", "b.p1"), lev("a.p2", "b.p2"))
    crossed = F.greatest(lev("a.p1", "b.p2"), lev("a.p2", "b.p1"))
    single = F.when(F.col("a.p2").isNull() & F.col("b.p2").isNull(), lev("a.p1", "b.p1"))
    double = F.when(F.col("a.p2").isNotNull() & F.col("b.p2").isNotNull(), F.least(straight, crossed))
    return F.coalesce(single, double, far)


def _given_fits() -> Column:
    a, b = F.col("a.given"), F.col("b.given")
    initial = ((F.length(a) == 1) | (F.length(b) == 1)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return (a == b) | initial


def _allowed(k: int) -> Column:
    """A short name has few letters to spare."""
    shortest = F.least(F.length("a.p1"), F.length("b.p1"), F.coalesce(F.length("a.p2"), F.lit(99)), F.coalesce(F.length("b.p2"), F.lit(99)))
    return F.least(F.when(shortest <= 4, 1).when(shortest <= 6, 2).otherwise(k), F.lit(k))


def segment_join(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Pairs ``(a, b, edits)`` of rows under equal keys with names proper within ``k`` edits; a.id < b.id.

    No row limit applies: every name within k edits of another under the same keys is found.
    """
    every = left.unionByName(right).dropDuplicates(["id"])
    found = _with_bodies(met_pairs([(left, right, keys, k)]), every, every).where(_given_fits())
    for key in keys:
        found = found.where(F.col(f"a.{key}") == F.col(f"b.{key}"))
    return found.withColumn("edits", _edits(k)).where(F.col("edits") <= _allowed(k)).select("a", "b", "edits")


def spelling_links(names: DataFrame) -> DataFrame:
    """``(lid, rid)``, lid < rid: directly linked spellings of one name.

    Rows meet under their line of business and town, country or year, whatever of these both state; rows without a
    common attribute under the line of business alone.  Each pair that meets is verified once.
    """
    n = names.withColumn("y", F.col("year"))
    placed, lost = n.where("place is not null"), n.where("place is null")
    years = F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1))
    equal = n.select(F.xxhash64(F.lit("same"), "context", "p1", F.coalesce("p2", F.lit(""))).alias("key"), "id")
    passes = [
        (placed, placed, ["context", "place"], 3),
        (n, lost, ["context", "country"], 2),
        (n, lost.where("year is not null").withColumn("y", years), ["context", "y"], 2),
        (n, lost, ["context"], 1),
    ]
    pairs = _with_bodies(met_pairs(passes, equal), names, names).where((F.col("a.context") == F.col("b.context")) & _given_fits())
    x = pairs.withColumn("edits", _edits(3))
    one_lost = F.col("a.place").isNull() | F.col("b.place").isNull()
    same_place, same_country = (F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False)) for c in ("place", "country"))
    near_year = F.coalesce(F.abs(F.col("a.year") - F.col("b.year")) <= 1, F.lit(False))
    no_country = F.col("a.country").isNull() | F.col("b.country").isNull()
    no_year = F.col("a.year").isNull() | F.col("b.year").isNull()
    country_ok, year_ok = same_country | no_country, near_year | no_year
    two = F.col("edits") <= _allowed(2)
    # equal names proper: only an initial in place of the given name needs the places to agree
    equal_name = F.col("a.p1").eqNullSafe(F.col("b.p1")) & F.col("a.p2").eqNullSafe(F.col("b.p2"))
    same = equal_name & ((F.col("a.given") == F.col("b.given")) | F.coalesce(F.col("a.place") == F.col("b.place"), country_ok & year_ok))
    town = same_place & (F.col("edits") <= _allowed(3)) & ((F.col("edits") < 3) | same_country | near_year)
    land = one_lost & same_country & two & year_ok
    age = one_lost & near_year & two & country_ok
    # rows without any shared attribute to compare, one of them without a place: one edit at most
    alone = one_lost & no_country & no_year & (F.col("edits") <= 1)
    return x.where(same | town | land | age | alone).select("lid", "rid")


def spelling_groups(records: DataFrame, **columns: str) -> DataFrame:
    """``(id, group_id)`` of all records with another spelling of their name; group_id is the smallest id.

    Nulls, blanks, repeated rows and extra columns: see :func:`read_names`.  An empty table gives
    an empty result.
    """
    scratch = Scratch(records.sparkSession, "names")
    names = scratch.put("names", read_names(records, **columns))
    links = scratch.put("links", spelling_links(names))
    return hash_to_min(links.select(F.col("lid").alias("a"), F.col("rid").alias("b")))
