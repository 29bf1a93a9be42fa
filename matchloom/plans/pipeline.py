"""The whole clean-up of a match graph, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import clean, graph
from matchloom.operators.blocking import label_candidates, merge_candidates
from matchloom.operators.labeling import label_summary, oracle_label
from matchloom.operators.metrics import pair_scores, purity
from matchloom.operators.pairs import PAIR, accumulate, dedupe_predictions
from matchloom.operators.scoring import PairScorer
from matchloom.schema import COMPONENT_CAP, MATCH_THRESHOLD
from matchloom.session import Scratch


@dataclass
class Cleaned:
    """What a run leaves: predictions, recovered pairs, and one row of counts per stage."""

    preds: DataFrame
    recovered: DataFrame
    stages: DataFrame
    labels: DataFrame
    finetuning: DataFrame | None = None
    notes: dict = field(default_factory=dict)


class CleanUp:
    """Selects edges, labels them, cuts, cleans to the fixpoint, checks and recovers.

    ``scorer`` scores transitive pairs; labels come from the label column of the predictions (an
    oracle).  A scorer with ``fit`` is refitted on the labelled edges of every iteration.
    """

    def __init__(self, scorer: PairScorer, records: DataFrame, threshold: float = MATCH_THRESHOLD, cap: int = COMPONENT_CAP, budget: int = 1000, iterations: int = 5):
        self.scorer, self.records, self.threshold, self.cap, self.budget, self.iterations = scorer, records, threshold, cap, budget, iterations

    def _members(self, preds: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        edges = scratch.put("edges", graph.match_graph(preds, self.threshold))
        return edges, scratch.put("members", graph.components(edges))

    def _transitive(self, edges: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
        pairs = graph.transitive_pairs(edges, members, self.cap)
        return scratch.put("scored", self.scorer.score(pairs, self._ready))

    def run(self, predictions: DataFrame) -> Cleaned:
        scratch = Scratch(predictions.sparkSession, "clean-up", lean=True)
        self._ready = scratch.put("records", self.scorer.prepare(self.records)) if hasattr(self.scorer, "prepare") else self.records
        preds = scratch.put("preds", dedupe_predictions(predictions).withColumn("manual_check_label", F.coalesce("manual_check_label", F.lit(-1))))
        stages: list[DataFrame] = []

        def note(name: str, scored: DataFrame) -> None:
            stages.append(scratch.put(f"stage-{len(stages)}", clean.stage_counts(preds, scored, self.threshold).select(F.lit(len(stages)).alias("step"), F.lit(name).alias("stage"), "*")))

        edges, members = self._members(preds, scratch)
        scored = self._transitive(edges, members, scratch)
        note("start", scored)
        preds = scratch.put("preds", graph.truncate_large(preds, members, self.threshold, self.cap))
        each, finetuning = max(1, self.budget // (2 * self.iterations)), None
        for i in range(1, self.iterations + 1):
            edges, members = self._members(preds, scratch)
            scored = self._transitive(edges, members, scratch)
            chosen = scratch.put("chosen", clean.select_edges(preds, scored, members, each, self.threshold, most=self.cap))
            preds = scratch.put("preds", oracle_label(preds, chosen))
            new = preds.join(chosen.select(*PAIR), PAIR, "left_semi").withColumn("iteration", F.lit(i))
            finetuning = scratch.put("finetuning", new if finetuning is None else accumulate(finetuning, new))
            if hasattr(self.scorer, "fit") and finetuning.where("label is not null").select("label").distinct().count() == 2:
                self.scorer.fit(finetuning, self.records)
                scored = self._transitive(edges, members, scratch)
            preds = scratch.put("preds", clean.update_predictions(preds, scored, members, self.threshold, self.cap))
            note(f"iteration {i}", scored)
        edges, members = self._members(preds, scratch)
        scored = self._transitive(edges, members, scratch)
        preds = scratch.put("preds", clean.post_cleanup(preds, scored, self.threshold, self.cap))
        note("post clean-up", scored)
        edges, members = self._members(preds, scratch)
        preds = scratch.put("preds", clean.check_large(preds, members, self.threshold, self.cap))
        edges, members = self._members(preds, scratch)
        transitive = scratch.put("transitive", graph.transitive_pairs(edges, members, self.cap))
        preds = scratch.put("preds", clean.check_checked_false(preds, transitive, members, self.threshold))
        scored = self._transitive(edges, members, scratch)
        preds = scratch.put("preds", clean.check_transitive(preds, scored, members, self.threshold))
        note("checks", scored)
        gone = preds.where("prob = 0 and manual_check_label < 0").select(*PAIR)
        rescored = scratch.put("rescored", self.scorer.score(gone, self._ready))
        again = rescored.where(F.col("prob") >= self.threshold)
        closing = scratch.put("closing", self.scorer.score(clean.recovery_pairs(preds, again, self.threshold, self.cap), self._ready))
        recovered = scratch.put("recovered", clean.edge_recovery(preds, rescored, closing, self.threshold, self.cap))
        back = recovered.withColumn("_r", F.lit(True))
        preds = scratch.put("preds", preds.join(back, PAIR, "left").withColumn("prob", F.when(F.col("_r"), 1.0).otherwise(F.col("prob"))).drop("_r"))
        note("recovery", scored)
        every = stages[0]
        for s in stages[1:]:
            every = every.unionByName(s)
        return Cleaned(preds, recovered, every, label_summary(preds), finetuning)


def match_records(records: DataFrame, blocks: dict[str, DataFrame], matcher: PairScorer, checker: PairScorer, truth: DataFrame | None = None, entities: DataFrame | None = None, threshold: float = 0.5, **options) -> Cleaned:
    """From records to a cleaned matching: candidates of several blockings, the matcher's scores, then :class:`CleanUp` with ``checker``.

    ``truth`` (pairs) or ``entities`` (id, entity) answer for the labeller; ``options`` are those of CleanUp.
    """
    scratch = Scratch(records.sparkSession, "match", lean=True)
    candidates = scratch.put("candidates", label_candidates(merge_candidates(blocks), truth, entities))
    scored = matcher.score(candidates, records)
    preds = scratch.put("preds", candidates.join(scored, PAIR).withColumn("manual_check_label", F.lit(-1)))
    return CleanUp(checker, records, threshold=threshold, **options).run(preds)


def report(truth: DataFrame, stages: dict[str, DataFrame], threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """``(stage, tp, fp, fn, precision, recall, f1, purity)`` of several prediction tables."""
    from matchloom.operators.metrics import confusion

    out = None
    for name, p in stages.items():
        edges = graph.match_graph(p, threshold)
        s = pair_scores(confusion(truth, p.where(F.col("prob") >= threshold))).crossJoin(purity(truth, graph.components(edges)).select("purity")).select(F.lit(name).alias("stage"), "*")
        out = s if out is None else out.unionByName(s)
    return out
