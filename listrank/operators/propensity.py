"""Out-of-fold propensities of item labels from masked text."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listrank.functions.text import mask_terms
from listrank.sources.tables import checkpointed

#: Rows of a partition of a fit: few small partitions make an iteration one short job.
ROWS_A_PARTITION = 20_000


def stratified_folds(items: DataFrame, label: str, folds: int, seed: int, key: str = "item_idx") -> DataFrame:
    """items with fold. Only keys and labels are dealt to the windows, of which there is one a label."""
    narrow = items.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    place = F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64(F.lit(seed), F.col("_key")), "_key")) - 1
    dealt = narrow.select("_key", (place % folds).cast("int").alias("fold"))
    return items.join(dealt, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def terms_of(text: Column) -> Column:
    """Words of two characters or more, then pairs of neighbours."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.transform(F.array(words), lambda w: F.concat(w, F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))))[0]


def out_of_fold(items: DataFrame, label: str, terms: Sequence[str], folds: int = 3, seed: int = 42, max_features: int = 15_000, min_df: int = 2, c: float = 3.0, max_iter: int = 300) -> DataFrame:
    """items(item_idx, item_text, label), item_idx unique: item_idx, label, fold, p. Words of two letters or more, one
    and two at a time, weighed by TF-IDF at unit length; logistic with an L2 penalty of 1 / (c n) and balanced classes.
    Texts are masked and parted once; the folds' fits run side by side. The fold of one label only has that label's
    odds."""
    data = items.select("item_idx", F.col(label).cast("double").alias("label"), terms_of(mask_terms(F.lower("item_text"), terms)).alias("terms"))
    data = checkpointed(stratified_folds(data, "label", folds, seed))
    found = data.groupBy("fold", "label").count().collect()

    def fit(fold: int) -> DataFrame:
        counts: dict[float, int] = {}
        for r in found:
            if r["fold"] != fold:
                counts[r["label"]] = counts.get(r["label"], 0) + r["count"]
        n = sum(counts.values())
        weights = F.coalesce(*[F.when(F.col("label") == k, F.lit(n / (len(counts) * v))) for k, v in counts.items()]) if counts else F.lit(1.0)
        train, rest = data.where(F.col("fold") != fold).coalesce(-(-n // ROWS_A_PARTITION) or 1), data.where(F.col("fold") == fold)
        steps = [
            CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=max_features, minDF=min_df), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features"),
            LogisticRegression(weightCol="w", regParam=1.0 / (c * max(n, 1)), maxIter=max_iter, standardization=False),
        ]
        model = Pipeline(stages=steps).fit(train.withColumn("w", weights))
        return model.transform(rest.withColumn("w", F.lit(1.0))).select("item_idx", "label", "fold", vector_to_array("probability")[1].alias("p"))

    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(fit, range(folds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
