"""Scores of probability forecasts.

Predictions arrive in long form: key columns (for example the model name), label `y` in {0, 1} and
probability `p`. They are first aggregated to one row per distinct probability, which every metric is
then computed from; ranking metrics accumulate along that order with partition-wise prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.fixed import PROB_EPS
from tremora.functions.rates import clip
from tremora.operators.ranking import exact_quantiles, prefix_sums
from tremora.session import materialize


def score_counts(predictions: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", p_ref: str | None = None) -> DataFrame:
    """(keys, p, pos, neg) per distinct clipped probability; with p_ref also ref_error, the reference's squared errors."""
    clipped = lambda c: clip(F.col(c).cast("double"), PROB_EPS, 1 - PROB_EPS)
    label = F.col(y).cast("long")
    ref = [F.sum(F.pow(clipped(p_ref) - label, 2)).alias("ref_error")] if p_ref else []
    return predictions.groupBy(*keys, clipped(p).alias("p")).agg(
        F.sum(label).alias("pos"), (F.count(F.lit(1)) - F.sum(label)).alias("neg"), *ref
    )


def proper_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, n_pos, base_rate, brier, logloss)."""
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    n = F.sum(pos + neg)
    return scores.groupBy(*keys).agg(
        n.alias("n"), F.sum(pos).alias("n_pos"), (F.sum(pos) / n).alias("base_rate"),
        (F.sum(pos * (p - 1) * (p - 1) + neg * p * p) / n).alias("brier"),
        (-F.sum(pos * F.ln(p) + neg * F.ln(F.lit(1.0) - p)) / n).alias("logloss"),
    )


def ranking_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, roc_auc, pr_auc), at least one key; NULL when only one class is present.

    ROC area counts ties as one half. The precision-recall area is the step sum of recall gains times
    the precision at that score.
    """
    running = prefix_sums(scores, keys, ["p"], {"pos_upto": "pos", "neg_upto": "neg"})
    total = running.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = running.join(total, list(keys))
    below = F.col("neg_upto") - F.col("neg")
    hits = F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    alarms = F.col("all_neg") - F.col("neg_upto") + F.col("neg")
    positives, negatives = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    return joined.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)), positives * negatives).alias("roc_auc"),
        F.when(negatives > 0, F.try_divide(F.sum(F.col("pos") * F.try_divide(hits, hits + alarms)), positives)).alias("pr_auc"),
    )


def skill(brier, reference):
    """1 - brier/reference, NULL for a zero reference."""
    return F.lit(1.0) - F.try_divide(brier, reference)


def evaluate(
    predictions: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", p_ref: str | None = None
) -> DataFrame:
    """All scores per key; `bss` compares with the reference probability column if one is named."""
    keys = list(keys)
    # Written once: the predictions behind it are usually far more expensive than the score table.
    scores = materialize(score_counts(predictions, keys, y, p, p_ref))
    out = proper_scores(scores, keys).join(ranking_scores(scores, keys), keys)
    if p_ref is None:
        return out
    ref = scores.groupBy(*keys).agg((F.sum("ref_error") / F.sum(F.col("pos") + F.col("neg"))).alias("brier_ref"))
    return out.join(ref, keys).withColumn("bss", skill(F.col("brier"), F.col("brier_ref")))


def reliability(
    predictions: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", n_bins: int = 10,
    strategy: str = "quantile",
) -> DataFrame:
    """(keys, bin, mean_pred, obs_freq, n) for quantile or equal-width bins; empty bins are absent.

    Bins open at inner edges. A constant prediction yields one bin.
    """
    keys = list(keys)
    scores = materialize(score_counts(predictions, keys, y, p))
    if strategy == "quantile":
        counted = scores.select(*keys, "p", (F.col("pos") + F.col("neg")).alias("weight"))
        marks = exact_quantiles(counted, keys, "p", [b / n_bins for b in range(n_bins + 1)], "weight")
        edges = marks.groupBy(*keys).agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
    else:
        low, step = F.min("p"), (F.max("p") - F.min("p")) / n_bins
        edges = scores.groupBy(*keys).agg(F.array(*[low + step * b for b in range(n_bins)], F.max("p")).alias("edges"))
    inner = F.when(F.size("edges") > 2, F.slice("edges", F.lit(2), F.size("edges") - 2)).otherwise(
        F.array().cast("array<double>")
    )
    binned = scores.join(edges.select(*keys, inner.alias("inner")), keys)
    slot = F.size(F.filter("inner", lambda e: e <= F.col("p"))).cast("long")
    weight = F.col("pos") + F.col("neg")
    return binned.groupBy(*keys, slot.alias("bin")).agg(
        (F.sum(weight * F.col("p")) / F.sum(weight)).alias("mean_pred"),
        (F.sum("pos") / F.sum(weight)).alias("obs_freq"), F.sum(weight).alias("n"),
    )
