"""Labellers: the truth as an oracle, or any function that answers for a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.pairs import PAIR, distinct_pairs
from matchloom.schema import UNCHECKED


def parse_answer(text: Column) -> Column:
    """1 if the answer says yes anywhere, else 0; null counts as no."""
    return F.when(F.coalesce(F.lower(text).contains("yes"), F.lit(False)), 1).otherwise(0)


def oracle_label(preds: DataFrame, selected: DataFrame) -> DataFrame:
    """manual_check_label := label on the selected rows; the others keep theirs (-1 where null).  prob is not touched."""
    s = distinct_pairs(selected).withColumn("_s", F.lit(True))
    checked = F.when(F.col("_s") & F.col("label").isNotNull(), F.col("label")).otherwise(F.coalesce("manual_check_label", F.lit(UNCHECKED)))
    return preds.join(s, PAIR, "left").withColumn("manual_check_label", checked.cast("int")).drop("_s").select(*preds.columns)


def training_rows(labelled: DataFrame, remove_positives: bool = False) -> DataFrame:
    """Labelled rows for the learner, on demand only those that were wrong (label 0)."""
    rows = labelled.where(F.col("manual_check_label") >= 0)
    return rows.where("manual_check_label = 0") if remove_positives else rows


class FunctionLabeller:
    """Asks a language model, or any function, about every unchecked pair, in batches.

    ``ask`` takes a list of prompts and gives as many answers; it is called with at most ``batch`` prompts and again, up to
    ``tries`` times, if it raises.  A batch that fails to the end fails the task, so that no pair is left out in silence.  With
    ``load`` a model is made by it once in a worker and comes first in the call.  Only pairs whose ``manual_check_label``, if there is
    such a column, is negative or null are asked about.
    """

    PROMPT = "Do these two records describe the same entity? Answer yes or no.\nA: {a}\nB: {b}"

    def __init__(self, ask: Callable[..., list[str]], text_col: str, id_col: str = "id", batch: int = 16, tries: int = 3, prompt: str = PROMPT, load: Callable[[], object] | None = None):
        self.ask, self.text_col, self.id_col, self.batch, self.tries, self.prompt, self.load = ask, text_col, id_col, batch, tries, prompt, load
        self.key = f"{type(self).__name__}-{id(self)}"

    def label(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        """``(lid, rid, manual_check_label)`` of the pairs whose records both exist."""
        from matchloom.operators.scoring import loaded

        if "manual_check_label" in pairs.columns:
            pairs = pairs.where(F.coalesce("manual_check_label", F.lit(UNCHECKED)) < 0)
        t = records.groupBy(F.col(self.id_col).alias("id")).agg(F.min(self.text_col).alias("text"))
        x = pairs.select(*PAIR).distinct().join(t.select(F.col("id").alias("lid"), F.col("text").alias("a")), "lid").join(t.select(F.col("id").alias("rid"), F.col("text").alias("b")), "rid")
        ask, batch, tries, prompt, load, key = self.ask, self.batch, self.tries, self.prompt, self.load, self.key

        def answers(first: tuple, prompts: list[str]) -> list[str]:
            for left in range(tries - 1, -1, -1):
                try:
                    got = list(ask(*first, prompts))
                    if len(got) != len(prompts):
                        raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
                    return got
                except Exception:
                    if not left:
                        raise
            return []

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = () if load is None else (loaded(key, load),)
            for b in batches:
                said: list[str] = []
                for lo in range(0, len(b), batch):
                    part = b.iloc[lo : lo + batch]
                    said += answers(first, [prompt.format(a=x or "", b=y or "") for x, y in zip(part["a"], part["b"])])
                yield b[PAIR].assign(answer=said)

        said = x.mapInPandas(run, "lid long, rid long, answer string")
        return said.select(*PAIR, parse_answer(F.col("answer")).alias("manual_check_label"))


def label_summary(preds: DataFrame) -> DataFrame:
    """One row: pairs checked right, wrong, not at all, the effort and the percentage checked (null if empty)."""
    c = F.col("manual_check_label")
    checked = F.count(F.when(c >= 0, 1))
    return preds.agg(
        F.count(F.when(c == 1, 1)).alias("checked_positive"), F.count(F.when(c == 0, 1)).alias("checked_negative"),
        F.count(F.when(c < 0, 1)).alias("unchecked"), checked.alias("effort"), F.count(F.lit(1)).alias("pairs"),
        F.round(F.try_divide(checked * 100.0, F.count(F.lit(1))), 4).alias("percent_checked"),
    )
