"""Record preparation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import build_sequence, concat_row, drop_span, normalize, shuffle_span, shuffled, strip_punctuation, words
from matchloom.operators.pairs import PAIR, positional_ids


def assign_ids(records: DataFrame, order: list[str]) -> DataFrame:
    """``id`` := position in the stated order; columns named like 'unnamed' are dropped.  The order must be total."""
    kept = [c for c in records.columns if not re.search("unnamed", c, re.I) and c != "id"]
    key = F.struct(*order)
    keyed = records.select(*kept, key.alias("_key"))
    ids = positional_ids(keyed.select(F.col("_key").alias("_k")).distinct(), ["_k"], "_k")
    return keyed.join(ids, keyed["_key"] == ids["_k"]).select(F.col("position").alias("id"), *kept)


def attach_raw_id(records: DataFrame, raw: DataFrame, key: tuple[str, ...] = ("external_id", "data_source_id")) -> DataFrame:
    """Left join of the raw id on the key columns compared as strings."""
    r = raw.select(*[F.col(k).cast("string").alias(f"_{k}") for k in key], F.col("id").alias("raw_id")).distinct()
    on = [F.col(k).cast("string") == F.col(f"_{k}") for k in key]
    return records.join(r, on, "left").drop(*[f"_{k}" for k in key])


def whole_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Float columns as BIGINT; a fraction becomes null rather than a rounded number."""
    return df.withColumns({c: F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint")) for c in columns})


def company_view(records: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Companies as the matcher reads them: keys and dates dropped, name and description cleaned, description last."""
    out = records.drop("external_id", "data_source_id", "inserted", "last_modified")
    if "short_description" in out.columns:
        out = out.withColumnRenamed("short_description", "description")
    out = out.withColumns({"name": strip_punctuation(F.col("name")), "description": normalize(F.col("description"), stop_words)})
    return out.select(*[c for c in out.columns if c != "description"], "description")


def first_as_id(records: DataFrame) -> DataFrame:
    """The first column becomes ``id`` unless there is one."""
    return records if "id" in records.columns else records.withColumnRenamed(records.columns[0], "id")


def tokenise(records: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, concat_data, tokenized)``: all attributes but the id, and their words."""
    text = concat_row([c for c in records.columns if c != id_col])
    return records.select(F.col(id_col).alias("id"), text.alias("concat_data")).withColumn("tokenized", words(F.col("concat_data")))


def pair_samples(pairs: DataFrame, tokens: DataFrame, length: int = 128) -> DataFrame:
    """``(lid, rid, label, tokens, segment_ids, mask)`` of pairs whose records both have tokens."""
    l = tokens.select(F.col("id").alias("lid"), F.col("tokenized").alias("a"))
    r = tokens.select(F.col("id").alias("rid"), F.col("tokenized").alias("b"))
    x = pairs.join(l, "lid").join(r, "rid").withColumn("s", build_sequence(F.col("a"), F.col("b"), length))
    return x.select(*PAIR, "label", "s.tokens", "s.segment_ids", "s.mask")


def augment(tokens: DataFrame, kind: str, seed: int = 42) -> DataFrame:
    """``(id, tokenized)`` changed in one way: del_token, swap_token, shuffle_token or identical, fixed by the seed."""
    ways = {"del_token": drop_span(F.col("tokenized"), F.col("id"), seed), "swap_token": shuffle_span(F.col("tokenized"), F.col("id"), seed),
            "shuffle_token": shuffled(F.col("tokenized"), F.col("id"), seed), "identical": F.col("tokenized")}
    if kind not in ways:
        raise ValueError(f"unknown augmentation {kind}")
    return tokens.select("id", ways[kind].alias("tokenized"))


def training_set(pairs: DataFrame, tokens: DataFrame, kinds: tuple[str, ...] = ("identical", "del_token"), length: int = 128, seed: int = 42) -> DataFrame:
    """``(lid, rid, label, kind, tokens, segment_ids, mask)``: labelled pairs as a model trains on them, once for each kind of change to the right record."""
    out = None
    for k, kind in enumerate(kinds):
        changed = augment(tokens, kind, seed + k)
        l, r = tokens.select(F.col("id").alias("lid"), F.col("tokenized").alias("a")), changed.select(F.col("id").alias("rid"), F.col("tokenized").alias("b"))
        x = pairs.join(l, "lid").join(r, "rid").withColumn("s", build_sequence(F.col("a"), F.col("b"), length))
        x = x.select(*PAIR, "label", F.lit(kind).alias("kind"), "s.tokens", "s.segment_ids", "s.mask")
        out = x if out is None else out.unionByName(x)
    return out


def augment_columns(records: DataFrame, columns: list[str], kind: str, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``(id, cols, vals)``: attributes with one column dropped (del_col), two swapped (swap_col) or all shuffled (shuffle_col)."""
    entries = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"), F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(c), F.lit(str(seed)))).alias("h")) for c in columns])
    by_hash = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(e["h"].alias("h"), e["k"].alias("k"), e["v"].alias("v")))), lambda e: e)
    x = records.select(F.col(id_col).alias("id"), entries.alias("e"), by_hash.alias("o"))
    first, second = F.col("o")[0]["k"], F.col("o")[F.lit(min(1, len(columns) - 1))]["k"]
    if kind == "del_col":
        e = F.filter("e", lambda c: c["k"] != first) if len(columns) > 1 else F.col("e")
    elif kind == "swap_col":
        pick = lambda name: F.filter("e", lambda c: c["k"] == name)[0]
        e = F.transform("e", lambda c: F.when(c["k"] == first, pick(second)).when(c["k"] == second, pick(first)).otherwise(c))
    elif kind == "shuffle_col":
        e = F.transform("o", lambda c: F.struct(c["k"].alias("k"), c["v"].alias("v"), c["h"].alias("h")))
    else:
        raise ValueError(f"unknown augmentation {kind}")
    return x.select("id", F.transform(e, lambda c: c["k"]).alias("cols"), F.transform(e, lambda c: c["v"]).alias("vals"))
