"""Quality of binary classifiers from a table of (label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.stats import running_total

CUTOFF = 0.5


def _share(part: Column, whole: Column) -> Column:
    """Ratio of counts, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _hits(label: str, score: str) -> dict[str, Column]:
    positive, predicted = F.col(label) == 1, F.col(score) >= CUTOFF
    return {
        "tp": F.count(F.when(positive & predicted, 1)),
        "fp": F.count(F.when(~positive & predicted, 1)),
        "fn": F.count(F.when(positive & ~predicted, 1)),
        "tn": F.count(F.when(~positive & ~predicted, 1)),
    }


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting half. Pairs are never
    formed: per distinct score, its positives meet the number of negatives below."""
    per_score = scored.groupBy(score).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("_pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("_neg"),
    )
    ranked = running_total(per_score, score, "_neg")
    below = F.col("_upto") - F.col("_neg") / 2
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.agg(F.try_divide(F.sum(F.col("_pos") * below), pairs).alias("roc_auc"))


def classification_metrics(
    scored: DataFrame, label: str = "label", score: str = "score"
) -> DataFrame:
    """One row: accuracy, precision, recall, f1 at the cut-off, and roc_auc."""
    hits = scored.agg(*[value.alias(name) for name, value in _hits(label, score).items()])
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    return hits.select(
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        roc_auc(scored, label, score).scalar().alias("roc_auc"),
    )


def confusion_matrix(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Four rows (actual, predicted, n), zeros included."""
    hits = scored.agg(*[value.alias(name) for name, value in _hits(label, score).items()])
    cells = [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]
    return hits.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")
                    )
                    for a, p, c in cells
                ]
            )
        )
    )


def select_best_model(
    scored: DataFrame, preferred: str, label: str = "label", score: str = "score"
) -> DataFrame:
    """The model with the highest recall over (model, label, score); a tie goes to ``preferred``."""
    hits = _hits(label, score)
    recalls = scored.groupBy("model").agg(_share(hits["tp"], hits["tp"] + hits["fn"]).alias("r"))
    order = F.struct("r", (F.col("model") == preferred).alias("preferred"), "model")
    return recalls.agg(F.max(order).alias("best")).select(
        F.col("best.model").alias("best_model"), F.col("best.r").alias("recall")
    )
