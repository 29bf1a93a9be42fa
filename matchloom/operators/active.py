"""Active learning: pseudo labels, consistency, uncertainty and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.pairs import PAIR, first_per_pair
from matchloom.session import Scratch


def mutual_pseudo_labels(forward: DataFrame, backward: DataFrame, gap: float = 0.01) -> DataFrame:
    """``(lid, rid, label)``: mutual nearest pairs as positives, their far runners-up as negatives.

    ``forward`` and ``backward`` are (lid, rid, sim, rank) of both directions; a runner-up counts if its
    similarity lies at least ``gap`` below the best.
    """
    best = forward.where("rank = 1").select(*PAIR, F.col("sim").alias("top"))
    back = backward.where("rank = 1").select(F.col("rid").alias("lid"), F.col("lid").alias("rid"))
    mutual = best.join(back, PAIR)
    far = forward.where("rank > 1").join(mutual.select("lid", "top"), "lid").where(F.round(F.col("top") - F.col("sim"), 9) >= gap)
    return mutual.select(*PAIR, F.lit(1).alias("label")).unionByName(far.select(*PAIR, F.lit(0).alias("label")))


def similarity_gap(valid: DataFrame, share: float = 0.1, default: float = 0.01) -> DataFrame:
    """One row ``gap``: the share-th percentile of positive gaps min(positive) - max(negative) per lid."""
    g = valid.groupBy("lid").agg(F.min(F.when(F.col("label") == 1, F.col("sim"))).alias("p"), F.max(F.when(F.col("label") == 0, F.col("sim"))).alias("q"))
    gaps = g.select((F.col("p") - F.col("q")).alias("gap")).where("gap > 0")
    return gaps.agg(F.coalesce(F.expr(f"percentile(gap, {share})"), F.lit(default)).alias("gap"))


def positive_threshold(valid: DataFrame, share: float = 0.25) -> DataFrame:
    """One row ``threshold``: the share-th percentile of the positive similarities."""
    return valid.where("label = 1").agg(F.expr(f"percentile(sim, {share})").alias("threshold"))


def matcher_pseudo_labels(scored: DataFrame, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """``(lid, rid, score, label)``: 1 above max(median of the positives, high), 0 below min(median of the negatives, low)."""
    m = scored.agg(F.expr("median(case when score >= 0.5 then score end)").alias("mp"), F.expr("median(case when score < 0.5 then score end)").alias("mn"))
    x = scored.crossJoin(F.broadcast(m))  # one row
    up, down = F.greatest(F.coalesce("mp", F.lit(high)), F.lit(high)), F.least(F.coalesce("mn", F.lit(low)), F.lit(low))
    return x.withColumn("label", F.when(F.col("score") > up, 1).when(F.col("score") < down, 0)).where("label is not null").select(*PAIR, "score", "label")


def consistent(labels: DataFrame) -> DataFrame:
    """Pseudo labels whose positives agree: negatives stay, a single positive of a lid stays.

    Of several positives of a lid those rids stay that every lid sharing one of its rids has too.  All
    lids of a rid of this lid are among those, so it is enough to compare the most shared rid of the lid with its
    others: each of them must have its lids among those of the most shared one, and the rids shared as often stay.
    Counts of lids per pair of rids tell that; lids are never paired with lids.
    """
    scratch = Scratch(labels.sparkSession, "consistent")
    pos = scratch.put("pos", labels.where("label = 1").select(*PAIR).distinct())
    n = pos.groupBy("lid").agg(F.count(F.lit(1)).alias("n"))
    many = pos.join(n.where("n > 1").select("lid"), "lid", "left_semi")
    shared = scratch.put("shared", pos.groupBy("rid").agg(F.count(F.lit(1)).alias("deg")))
    rated = scratch.put("rated", many.join(shared, "rid"))
    most = rated.groupBy("lid").agg(F.max_by("rid", F.struct("deg", -F.col("rid"))).alias("top"), F.max("deg").alias("top_deg"))
    rated = scratch.put("topped", rated.join(most, "lid"))
    asked = rated.select("rid", "top").distinct()
    held = asked.join(pos.select("lid", "rid"), "rid").join(pos.select("lid", F.col("rid").alias("top")), ["lid", "top"], "left_semi")
    inside = rated.join(held.groupBy("rid", "top").agg(F.count(F.lit(1)).alias("both")), ["rid", "top"])
    sound = inside.groupBy("lid").agg(F.min(F.col("both") == F.col("deg")).alias("ok")).where("ok").select("lid")
    agreed = rated.where("deg = top_deg").join(sound, "lid", "left_semi").select(*PAIR)
    kept = pos.join(n.where("n = 1").select("lid"), "lid", "left_semi").unionByName(agreed)
    return labels.join(kept.withColumn("_k", F.lit(True)), PAIR, "left").where((F.col("label") == 0) | F.col("_k")).drop("_k")


def best_per_side(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """``(lid, rid, label)``: of pairs with score > least the best partner of every lid and of every rid; ties to the smaller id."""
    s = scored.where(F.col("score") > least)
    l = s.groupBy("lid").agg(F.max_by("rid", F.struct("score", -F.col("rid"))).alias("rid")).select(*PAIR)
    r = s.groupBy("rid").agg(F.max_by("lid", F.struct("score", -F.col("lid"))).alias("lid")).select(*PAIR)
    return l.union(r).distinct().withColumn("label", F.lit(1))


def uncertain(scored: DataFrame, budget: int, share: float = 0.5, pivot: float = 0.5) -> DataFrame:
    """The ``budget`` pairs nearest the pivot: the lowest scores at or above it up to share x budget, then the highest below (a budgeted report)."""
    up = scored.where(F.col("score") >= pivot).orderBy("score", *PAIR).limit(int(budget * share))
    k = up.count()
    down = scored.where(F.col("score") < pivot).orderBy(F.desc("score"), *PAIR).limit(budget - k)
    return up.unionByName(down)


def agreed_training(pseudo: DataFrame, scored: DataFrame, matcher: DataFrame, annotated: DataFrame) -> DataFrame:
    """``(lid, rid, label)`` for the matcher: blocker labels the matcher agrees with, and the matcher's own; annotated pairs left out."""
    both = pseudo.join(scored.select(*PAIR, "score"), PAIR).where((F.col("score") > 0.5).cast("int") == F.col("label")).select(*PAIR, "label", F.lit(0).alias("_p"))
    own = matcher.select(*PAIR, "label", F.lit(1).alias("_p"))
    return first_per_pair(both.unionByName(own), [F.col("_p")]).drop("_p").join(annotated.select(*PAIR), PAIR, "left_anti")


def annotate(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """Samples with the truth's label, 0 where it has none."""
    t = truth.groupBy(*PAIR).agg(F.max("label").cast("int").alias("_y"))
    return samples.join(t, PAIR, "left").withColumn("label", F.coalesce("_y", F.lit(0))).drop("_y")


def balanced(pseudo: DataFrame, annotated: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Pseudo labels of each class cut, in hash order, at 3 x ratio x the annotated ones; no annotated positives, no negatives (a sampling operator)."""
    c = annotated.agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("q")).first()
    h = F.md5(F.concat_ws("-", F.col("lid").cast("string"), F.col("rid").cast("string")))
    pos = pseudo.where("label = 1").orderBy(h, *PAIR).limit(int(3 * ratio * c["p"]))
    neg = pseudo.where("label = 0").orderBy(h, *PAIR).limit(int(3 * ratio * c["q"]) if c["p"] else 0)
    return pos.unionByName(neg)


def merge_votes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(lid, rid, votes, avg_score)`` over rounds: full outer merge with a vote count and a running mean."""
    o = old.select(*PAIR, F.col("votes").alias("_v"), F.col("avg_score").alias("_s"))
    x = o.join(new.select(*PAIR, F.col("score").alias("_n")), PAIR, "full_outer")
    v = F.coalesce("_v", F.lit(0)) + F.when(F.col("_n").isNotNull(), 1).otherwise(0)
    total = F.coalesce(F.col("_v") * F.col("_s"), F.lit(0.0)) + F.coalesce("_n", F.lit(0.0))
    return x.select(*PAIR, v.cast("long").alias("votes"), (total / v).alias("avg_score"))


def pseudo_quality(pseudo: DataFrame, truth: DataFrame, annotated: DataFrame) -> DataFrame:
    """``(label, n, right, precision)`` per class of pseudo labels outside the annotated pairs."""
    y = annotate(pseudo.join(annotated.select(*PAIR), PAIR, "left_anti").withColumnRenamed("label", "guess"), truth)
    right = F.count(F.when(F.col("guess") == F.col("label"), 1))
    return y.groupBy("guess").agg(F.count(F.lit(1)).alias("n"), right.alias("right"), F.round(right / F.count(F.lit(1)), 6).alias("precision")).withColumnRenamed("guess", "label")


def threshold_scan(scored: DataFrame, score: Column | None = None, steps: int = 20) -> DataFrame:
    """``(threshold, tp, fp, fn, f1)`` for thresholds 0, 1/steps, ..; f1 is null without true or predicted positives."""
    s = scored.select((F.col("score") if score is None else score).alias("s"), "label")
    t = s.select("s", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / F.lit(float(steps)))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    tp, fp, fn = F.count(F.when(hit & (F.col("label") == 1), 1)), F.count(F.when(hit & (F.col("label") == 0), 1)), F.count(F.when(~hit & (F.col("label") == 1), 1))
    return t.groupBy("threshold").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), 6).alias("f1"))


class ActiveLoop:
    """Active learning of a matcher and, on demand, of the blocker, until the budget is spent.

    Every round the most uncertain candidates are labelled by ``truth``; the matcher is fitted on them, on its own
    pseudo labels that are consistent and on those of the blocker that it agrees with, cut to the classes' balance; the blocker, an encoder with
    ``fit`` and ``encode``, is fitted on the same pairs and finds the candidates anew.  ``scorer`` has fit(labelled, records) and
    score(pairs, records).
    """

    def __init__(self, scorer, records: DataFrame, truth: DataFrame, budget: int, rounds: int = 10, pseudo: bool = False, encoder=None, sides: tuple[DataFrame, DataFrame] | None = None, top_k: int = 5, gap: float = 0.01):
        self.scorer, self.records, self.truth, self.budget, self.rounds = scorer, records, truth, budget, rounds
        self.pseudo, self.encoder, self.sides, self.top_k, self.gap = pseudo, encoder, sides, top_k, gap

    def _block(self, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """Candidates and the blocker's pseudo labels."""
        from matchloom.operators.blocking import embed_top_k

        found = scratch.put("found", embed_top_k(*self.sides, self.encoder, self.top_k))
        there = found.where("side = 'left'")
        back = found.where("side = 'right'").select(F.col("rid").alias("lid"), F.col("lid").alias("rid"), "sim", "rank")
        return found.select(*PAIR).distinct(), mutual_pseudo_labels(there.drop("side"), back, self.gap)

    def run(self, candidates: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(scores, labelled)`` of the candidates after the last round, from first scores (lid, rid, score)."""
        scratch = Scratch(candidates.sparkSession, "active")
        scores, labelled, spent, guesses = scratch.put("scores", first.select(*PAIR, "score")), None, 0, None
        each = max(1, self.budget // self.rounds)
        if self.encoder is not None:
            pool, guesses = self._block(scratch)
            candidates, guesses = scratch.put("pool", pool), scratch.put("guesses", guesses)
        while spent < self.budget:
            todo = scores if labelled is None else scores.join(labelled.select(*PAIR), PAIR, "left_anti")
            new = scratch.put("new", annotate(uncertain(todo, min(each, self.budget - spent)), self.truth))
            got = new.count()
            if not got:
                break
            spent += got
            labelled = scratch.put("labelled", new.select(*PAIR, "label") if labelled is None else labelled.unionByName(new.select(*PAIR, "label")))
            if labelled.select("label").distinct().count() < 2:
                continue
            training = labelled
            if self.pseudo:
                own = scratch.put("own", consistent(matcher_pseudo_labels(scores).select(*PAIR, "label")))
                picked = agreed_training(own if guesses is None else guesses, scores, own, labelled)
                training = scratch.put("training", labelled.unionByName(balanced(picked, labelled).select(*PAIR, "label")))
            self.scorer.fit(training, self.records)
            if self.encoder is not None:
                self.encoder.fit(training, self.records)
                pool, guesses = self._block(scratch)
                candidates, guesses = scratch.put("pool", pool), scratch.put("guesses", guesses)
            scores = scratch.put("scores", self.scorer.score(candidates, self.records).select(*PAIR, F.col("prob").alias("score")))
        return scores, labelled
