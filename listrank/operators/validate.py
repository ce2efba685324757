"""Checks that a table of lists is what evaluation needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import bad_score, lists


def violations(candidates: DataFrame) -> DataFrame:
    """One row of counts: lists without exactly one positive, lists whose positive item repeats, unequal widths, scores
    that are null, NaN or infinite. One shuffle. Of several positives, that with the largest item is looked for, so that
    the order in which rows arrive decides nothing."""
    positives, others = (F.transform(F.filter("cands", f), lambda x: x["item_idx"]) for f in (lambda x: x["is_positive"], lambda x: ~x["is_positive"]))
    rows = lists(candidates).select(
        "n_positive", F.size("cands").cast("long").alias("width"), F.size(F.filter("cands", lambda x: bad_score(x["score"]))).alias("bad"),
        F.array_contains(others, F.array_max(positives)).alias("twice"),
    )
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_positive") != 1).alias("not_one_positive"), F.count_if("twice").alias("positive_repeats"), (F.max("width") - F.min("width")).alias("width_spread"), F.min("width").alias("width"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_scores"))


def require(candidates: DataFrame, k: int, diagnostics: bool = False) -> None:
    """Raises ValueError unless the lists can be evaluated at k; k must leave a candidate over for diagnostics."""
    v = violations(candidates).first()
    if not v["n_rows"]:
        raise ValueError("at least one row is required")
    faults = [name for name in ("not_one_positive", "positive_repeats", "width_spread", "bad_scores") if v[name]]
    if faults:
        raise ValueError("lists can't be evaluated: " + ", ".join(f"{n} = {v[n]}" for n in faults))
    if not 1 <= k <= v["width"] - diagnostics:
        raise ValueError(f"k = {k} does not fit lists of {v['width']}")
