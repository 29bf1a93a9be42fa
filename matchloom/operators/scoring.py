"""Pair scorers: a protocol, built-in token scorers, a learner and the prediction log."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import words
from matchloom.operators.pairs import PAIR, distinct_pairs


class PairScorer(Protocol):
    """Anything that gives pairs a probability: ``(lid, rid)`` and records in, ``(lid, rid, prob)`` out."""

    def score(self, pairs: DataFrame, records: DataFrame) -> DataFrame: ...


def token_sets(records: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """``(id, tokens)``: distinct words of every record; one row per id, null texts have none."""
    t = records.groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    return t.select("id", F.array_distinct(F.coalesce(words(F.col("text")), F.array().cast("array<string>"))).alias("tokens"))


class TokenScorer:
    """Jaccard or containment of distinct words; a pair with an empty side scores 0.

    With ``cut`` the score is the decision itself: 1 from the cut on, else 0.
    """

    def __init__(self, text_col: str, measure: str = "jaccard", id_col: str = "id", cut: float | None = None):
        if measure not in ("jaccard", "containment"):
            raise ValueError(f"unknown measure {measure}")
        self.text_col, self.measure, self.id_col, self.cut = text_col, measure, id_col, cut

    def prepare(self, records: DataFrame) -> DataFrame:
        """What :meth:`score` reads of the records, to be written once by who scores many times."""
        return token_sets(records, self.text_col, self.id_col)

    def score(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        t = records if records.columns == ["id", "tokens"] else self.prepare(records)
        p = distinct_pairs(pairs)
        x = p.join(t.select(F.col("id").alias("lid"), F.col("tokens").alias("a")), "lid").join(t.select(F.col("id").alias("rid"), F.col("tokens").alias("b")), "rid")
        shared, na, nb = F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b")
        whole = na + nb - shared if self.measure == "jaccard" else F.least(na, nb)
        value = F.coalesce(F.try_divide(shared, whole), F.lit(0.0))
        return x.select(*PAIR, (value if self.cut is None else (value >= self.cut).cast("double")).alias("prob"))


_LOADED: dict[str, object] = {}


def loaded(key: str, load: Callable[[], object]):
    """What ``load`` gives, made once in a Python worker and kept for its later tasks (Spark reuses workers)."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


class BatchScorer:
    """A plug-in model: a function from a frame of pairs with both texts to probabilities, per Arrow batch.

    With ``load`` the model is made by it in the worker, once, and not sent with every task;
    ``predict`` then takes the model first.
    """

    def __init__(self, predict: Callable[..., pd.Series], text_col: str, id_col: str = "id", load: Callable[[], object] | None = None):
        self.predict, self.text_col, self.id_col, self.load = predict, text_col, id_col, load
        self.key = f"{type(self).__name__}-{id(self)}"

    def score(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        t = records.groupBy(F.col(self.id_col).alias("id")).agg(F.min(self.text_col).alias("text"))
        x = distinct_pairs(pairs).join(t.select(F.col("id").alias("lid"), F.col("text").alias("left")), "lid").join(t.select(F.col("id").alias("rid"), F.col("text").alias("right")), "rid")
        predict, load, key = self.predict, self.load, self.key

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = () if load is None else (loaded(key, load),)
            for b in batches:
                yield b[PAIR].assign(prob=predict(*first, b).astype(float))

        return x.select(*PAIR, "left", "right").mapInPandas(run, "lid long, rid long, prob double")


class HashEncoder:
    """Records as vectors without a model: every word of the serialised record adds to the dimensions that its hash names, with its sign.

    Any class with ``encode(records, id_col) -> (id, v)`` can stand in its place.
    """

    def __init__(self, columns: list[str], dims: int = 128):
        self.columns, self.dims = columns, dims

    def encode(self, records: DataFrame, id_col: str = "id") -> DataFrame:
        """``(id, v)`` of length one for every record with a word; of several rows of an id the smallest values count."""
        one = records.groupBy(F.col(id_col).alias("id")).agg(*[F.min(F.col(c).cast("string")).alias(c) for c in self.columns])
        w = one.select("id", F.explode(F.array_distinct(words(F.concat_ws(" ", *self.columns)))).alias("w")).withColumn("h", F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"))
        sign = F.when(F.shiftright("h", 20).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
        sums = w.groupBy("id", F.pmod("h", F.lit(self.dims)).cast("int").alias("d")).agg(F.sum(sign).alias("x"))
        m = sums.where("x <> 0").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        v = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0)) / F.col("norm"))
        return m.select("id", v.alias("v"))


class LearnedEncoder(HashEncoder):
    """A hash encoder whose dimensions are weighted by how much more true pairs agree on them than wrong ones; until ``fit`` all weigh the same."""

    def __init__(self, columns: list[str], dims: int = 128):
        super().__init__(columns, dims)
        self.weights: list[float] = [1.0] * dims

    def fit(self, labelled: DataFrame, records: DataFrame, id_col: str = "id") -> LearnedEncoder:
        """From ``(lid, rid, label)``: per dimension the mean product over true pairs less that over wrong ones, at least a twentieth of the best."""
        v = HashEncoder.encode(self, records, id_col)
        x = labelled.where("label is not null").join(v.withColumnsRenamed({"id": "lid", "v": "a"}), "lid").join(v.withColumnsRenamed({"id": "rid", "v": "b"}), "rid")
        long = x.select("label", F.posexplode(F.zip_with("a", "b", lambda p, q: p * q)).alias("d", "x"))
        means = {r["d"]: (r["p"] or 0.0) - (r["q"] or 0.0) for r in long.groupBy("d").agg(F.avg(F.when(F.col("label") == 1, F.col("x"))).alias("p"), F.avg(F.when(F.col("label") == 0, F.col("x"))).alias("q")).collect()}
        top = max(means.values(), default=0.0)
        if top > 0:
            self.weights = [max(means.get(d, 0.0) / top, 0.05) for d in range(self.dims)]
        return self

    def encode(self, records: DataFrame, id_col: str = "id") -> DataFrame:
        w = F.array(*[F.lit(x**0.5) for x in self.weights])
        v = super().encode(records, id_col).select("id", F.zip_with("v", w, lambda x, y: x * y).alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return v.select("id", F.transform("v", lambda x: x / norm).alias("v"))


def padded(sequences: list, fill: int = 0) -> np.ndarray:
    """Sequences of a batch as one array, filled on the right up to the longest of them."""
    out = np.full((len(sequences), max(map(len, sequences), default=0)), fill)
    for i, s in enumerate(sequences):
        out[i, : len(s)] = s
    return out


class LearnedScorer:
    """Logistic regression over token measures; ``fit`` takes labelled pairs, optionally with weights."""

    MEASURES = ("jaccard", "containment")

    def __init__(self, text_col: str, id_col: str = "id"):
        self.text_col, self.id_col, self.model = text_col, id_col, None

    def _features(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        out = distinct_pairs(pairs)
        for m in self.MEASURES:
            out = out.join(TokenScorer(self.text_col, m, self.id_col).score(pairs, records).withColumnRenamed("prob", m), PAIR)
        return out

    def fit(self, labelled: DataFrame, records: DataFrame, weight_col: str | None = None) -> LearnedScorer:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        cols = [*PAIR, F.col("label").cast("double").alias("label"), *([weight_col] if weight_col else [])]
        x = self._features(labelled, records).join(labelled.where("label is not null").select(*cols), PAIR)
        lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=50, **({"weightCol": weight_col} if weight_col else {}))
        self.model = Pipeline(stages=[VectorAssembler(inputCols=list(self.MEASURES), outputCol="features"), lr]).fit(x)
        return self

    def score(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.model is None:
            raise ValueError("fit the scorer first")
        return self.model.transform(self._features(pairs, records)).select(*PAIR, vector_to_array("probability")[1].alias("prob"))


def prediction_log(scored: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(lids, rids, labels, predictions, prediction_proba)`` of scored pairs."""
    return scored.join(labels.select(*PAIR, "label"), PAIR, "left").select(
        F.col("lid").alias("lids"), F.col("rid").alias("rids"), F.col("label").cast("int").alias("labels"),
        (F.col("prob") >= threshold).cast("int").alias("predictions"), F.col("prob").alias("prediction_proba"),
    )
