"""Quality classifier with hierarchical empirical Bayes over sites and paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, spread_join

#: Labelled rows that a fit sees at most, chosen by a hash of their ids.
FIT_ROWS = 20_000
KEEP_FROM = 0.5
#: How much a site's or path's posterior moves a document's logit.
SITE_WEIGHT = 0.5
#: Rows of the site table up to which it is broadcast.
BROADCAST_ROWS = 50_000
FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "distinct_share", "dup_line_share")


def with_features(docs: DataFrame, name: str) -> DataFrame:
    """Adds an array of shares and lengths that tell prose from junk; an empty text has zeros. Words are lower-cased and
    parted once; characters other than a-z and blanks are counted in what is left without these."""
    t = F.coalesce("text", F.lit(""))
    parts = docs.withColumn("_w", F.filter(F.split(F.lower(t), SPACES), lambda w: w != "")).withColumn("_r", F.regexp_replace(t, "[a-z ]+", "")).withColumn("_l", F.split(t, "\n"))
    n, chars = F.greatest(F.size("_w"), F.lit(1)).cast("double"), F.greatest(F.length(t), F.lit(1)).cast("double")
    share = [F.regexp_count("_r", F.lit(p)) / chars for p in (r"[#*$%&|<>^~_{}=+\[\]\\/@]", "[A-Z]", "[0-9]", "[!?]")]
    values = [F.log1p(F.size("_w")), F.length(F.array_join("_w", "")) / n, *share, F.size(F.array_distinct("_w")) / n, 1 - F.size(F.array_distinct("_l")) / F.greatest(F.size("_l"), F.lit(1))]
    return parts.withColumn(name, F.array(*[v.cast("double") for v in values])).drop("_w", "_r", "_l")


class LogisticModel:
    """Weights over standardized features and their squares, with predictions as a Column."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, rate: float):
        self.mean, self.scale, self.weights, self.bias, self.rate = mean, scale, weights, bias, rate

    def logit(self, x: Column) -> Column:
        """x: an array of the features."""
        k = len(self.mean)
        out = F.lit(self.bias)
        for i in range(k):
            z = F.least(F.greatest((F.get(x, F.lit(i)) - F.lit(float(self.mean[i]))) / F.lit(float(self.scale[i])), F.lit(-8.0)), F.lit(8.0))
            out = out + z * F.lit(float(self.weights[i])) + z * z * F.lit(float(self.weights[k + i]))
        return F.least(F.greatest(out, F.lit(-20.0)), F.lit(20.0))


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 50) -> LogisticModel:
    """Newton's method on the penalized logistic loss. Without both labels, the model gives everything even odds."""
    k = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return LogisticModel(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0 if len(y) == 0 else 4.0 * (2 * y[0] - 1), float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.concatenate([z, z * z, np.ones((len(z), 1))], 1)
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(2 * k, decay * len(y)), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return LogisticModel(mean, scale, w[: 2 * k], float(w[-1]), float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> LogisticModel:
    """A model of labels.quality from at most fit_rows labelled documents, those first by a hash of their ids. A
    document's labels are averaged where they repeat, and so are the features of rows that share an id."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = cut(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    means = [F.avg(F.get("x", F.lit(i))).alias(name) for i, name in enumerate(FEATURES)]
    rows = with_features(rows, "x").groupBy("doc_id", "quality").agg(*means).orderBy("doc_id").toArrow()
    x = np.stack([np.asarray(rows[name].to_pylist(), float) for name in FEATURES], 1).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows["quality"].to_pylist(), float).round())


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, rate: float) -> float:
    """Prior strength by moments: the larger the spread between groups beyond chance, the weaker the prior."""
    m = groups.where("n >= 2").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(rate), F.lit(2.0))).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("v").alias("v")).first()
    if not m["k"] or m["k"] < 2:
        return 10.0
    within = m["v"] / m["n"]
    between = (m["ss"] - (m["k"] - 1) * within) / max(m["n"] - m["nn"] / m["n"], 1e-9)
    return float(np.clip(within / max(between, 1e-9), 1.0, 1e4))


def score_sites(scored: DataFrame) -> DataFrame:
    """scored(site, path, p): per (site, path) the sums and prior strengths of the hierarchy: site_n, site_s, path_n,
    path_s, k_site, k_path, rate. Sums are partial before the shuffle, so a hot site costs one row a task."""
    path = cut(scored.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v")))
    site = cut(path.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")))
    total = site.agg(F.sum("n"), F.sum("s")).first()
    rate = float(total[1] / total[0]) if total[0] else 0.5
    site = site.select(F.col("site").alias("_site"), F.col("n").alias("site_n"), F.col("s").alias("site_s"), F.lit(_strength(site, rate)).alias("k_site"))
    k_path = _strength(path, rate)
    return path.join(site, F.col("site").eqNullSafe(F.col("_site"))).select("site", "path", "site_n", "site_s", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "k_site", F.lit(k_path).alias("k_path"), F.lit(rate).alias("rate"))


def classify(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", keep_from: float = KEEP_FROM, site_weight: float = SITE_WEIGHT, fit_rows: int = FIT_ROWS, keep_text: bool = True, column: str = "quality") -> DataFrame:
    """Adds struct quality(doc_score, site_posterior, path_posterior, score, kept) to each row of docs.

    doc_score is the classifier's probability. A site's posterior is (sum of the other documents' scores there +
    k * global rate) / (their number + k); a path's is the same around its site's posterior. Each k comes from the
    spread between the groups, so sparse sites and paths shrink to what lies above them. The document's logit moves by
    site_weight * (logit of its path's posterior - logit of the global rate). A document's own score is left out of its
    site and path. Null and empty texts have the features of nothing; null sites and paths are groups of their own; all
    rows and columns stay, repeated rows too, but for one named like `column`; an empty table stays empty.

    Each text is measured once for the groups' sums and once for its row, so that no text is shuffled or staged; without
    keep_text it leaves the rows, which are then checkpointed and measured once. The table of groups is broadcast up to
    BROADCAST_ROWS rows; beyond, rows are dealt at random to copies of it, so that a hot site is spread."""
    model = train(docs, labels, fit_rows)
    own = [c for c in docs.columns if c != column and (keep_text or c != "text")]
    # rows travel as structs, so that no column of theirs can clash with the join's own
    rows = docs.select(F.struct(*own).alias("row"), "text", F.col(site).alias("site"), F.col(path).alias("path"))
    rows = with_features(rows, "_x")
    rows = rows.select("row", "site", "path", (1 / (1 + F.exp(-model.logit(F.col("_x"))))).alias("_p"))
    if not keep_text:
        rows = cut(rows)
    sites = cut(score_sites(rows.select("site", "path", F.col("_p").alias("p"))))
    sites = sites.withColumnsRenamed({c: f"_{c}" for c in sites.columns})
    both = spread_join(rows, sites, [("site", "_site"), ("path", "_path")], "inner", BROADCAST_ROWS)
    at_site = (F.col("_site_s") - F.col("_p") + F.col("_k_site") * F.col("_rate")) / (F.col("_site_n") - 1 + F.col("_k_site"))
    both = both.withColumn("_at_site", at_site)
    both = both.withColumn("_at_path", (F.col("_path_s") - F.col("_p") + F.col("_k_path") * F.col("_at_site")) / (F.col("_path_n") - 1 + F.col("_k_path")))
    both = both.withColumn("_z", _logit(F.col("_p")) + F.lit(site_weight) * (_logit(F.col("_at_path")) - _logit(F.col("_rate"))))
    final = 1 / (1 + F.exp(-F.col("_z")))
    return both.select("row.*", F.struct(F.col("_p").alias("doc_score"), F.col("_at_site").alias("site_posterior"), F.col("_at_path").alias("path_posterior"), final.alias("score"), (final >= keep_from).alias("kept")).alias(column))
