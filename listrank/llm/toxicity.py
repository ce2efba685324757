"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .decontam import words_of
from .simhash import shingle_hashes

#: Documents that a fit sees at most, of either kind, and words that a model has at most.
FIT_ROWS, VOCABULARY = 5_000, 5_000
#: Errors that a word's rate among the positives must be off its rate among all, and families that must have it.
LEAST_CONTRAST, LEAST_FAMILIES = 4.0, 3.0
#: Penalties tried, and turns of the families that each is tried on.
DECAYS, TURNS = (1e-3, 1e-4, 1e-5), 5
#: Minima of the 3-word shingles by which near copies in a fit are known: those that share two are one family.
MINIMA = 8
CUT = 0.7


#: Bytes of a word's beginning that are a term too, as inflected words share their stem.
STEM = 5


def term_counts(text: bytes | None, known=None) -> dict[bytes, int]:
    """Counts of a text's words, and of their stems behind a mark that no word has; of those in known, if given."""
    counts: dict[bytes, int] = {}
    for word in words_of(text):
        if known is None or word in known:
            counts[word] = counts.get(word, 0) + 1
        stem = b"^" + word[:STEM]
        if len(word) > STEM and (known is None or stem in known):
            counts[stem] = counts.get(stem, 0) + 1
    return counts


class PUModel:
    """Weights of terms (words and stems): a document's logit is the bias and the sum over its terms of weight * log(1 + count)."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes | None) -> float:
        weights, logit = self.weights, self.bias
        for term, n in term_counts(text, weights).items():
            logit += weights[term] * math.log1p(n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


class Part:
    """The documents of one kind: term numbers and values of each, and its weight (weights sum to 1)."""

    def __init__(self, features: list[dict[int, float]], weights: list[float]):
        self.row = np.array([i for i, f in enumerate(features) for _ in f], np.int64)
        self.column = np.array([c for f in features for c in f], np.int64)
        self.value = np.array([x for f in features for x in f.values()], np.float64)
        self.weight = np.array(weights, np.float64) / max(sum(weights), 1e-300)

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        logits = np.bincount(self.row, self.value * w[self.column], len(self.weight)) + w[-1]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def back(self, slope: np.ndarray, size: int) -> np.ndarray:
        slope = slope * self.weight
        g = np.bincount(self.column, self.value * slope[self.row], size)
        g[-1] += slope.sum()
        return g


def pu_risk(w: np.ndarray, positive: Part, unlabelled: Part, prior: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """prior * R+(positive) and R-(unlabelled) - prior * R-(positive) under the logistic loss, each with its gradient. The
    second estimates the loss on what is not toxic; it can be negative, which no loss is."""
    p, u = positive.probabilities(w), unlabelled.probabilities(w)
    up = prior * float(-(positive.weight * np.log(np.maximum(p, 1e-12))).sum())
    rest = float(-(unlabelled.weight * np.log(np.maximum(1 - u, 1e-12))).sum() + prior * (positive.weight * np.log(np.maximum(1 - p, 1e-12))).sum())
    return up, prior * positive.back(p - 1, len(w)), rest, unlabelled.back(u, len(w)) - prior * positive.back(p, len(w))


def fit_pu(positive: Part, unlabelled: Part, n_terms: int, prior: float, decay: float, rounds: int = 800, rate: float = 0.05) -> np.ndarray:
    """Weights of the terms and the bias that minimize prior * R+(positive) + max(0, R-(unlabelled) - prior *
    R-(positive)) + decay / 2 * |weights|^2, by full-batch Adam steps; where the second part is negative, a step ascends
    it instead."""
    w = np.append(np.zeros(n_terms), np.log(prior / (1 - prior)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        _, up, rest, negative = pu_risk(w, positive, unlabelled, prior)
        grad = (up + negative if rest >= 0 else -negative) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def families(minima: list[list[int]]) -> list[int]:
    """The family of each document: documents that share two minima of their shingles are linked. Each pair of minima is
    a bucket whose members link to its first, so a large family costs no more than its members."""
    parent, first = list(range(len(minima))), {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, ms in enumerate(minima):
        for a, b in combinations(range(len(ms)), 2):
            j = first.setdefault((a, b, ms[a], ms[b]), i)
            if j != i:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(minima))]


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms, their counts and the minima of the 3-word shingles of each text."""
    for batch in batches:
        terms, counts, minima = [], [], []
        for text in batch.column(3).cast(pa.binary()):
            seen = term_counts(text.as_py())
            terms.append(list(seen))
            counts.append(list(seen.values()))
            h = shingle_hashes(text.as_py(), 3)
            minima.append([int((h * m).min() >> np.uint64(1)) for m in _FACTORS] if len(h) else [])
        made = [pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32())), pa.array(minima, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "toxic", "drawn", "terms", "counts", "minima"])


_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, vocabulary: int = VOCABULARY) -> PUModel:
    """A model from at most fit_rows confirmed toxic documents, and as many drawn from all documents whatever their
    labels, each kind first by a hash of their ids; held-out ids are neither. A confirmed document that is drawn counts
    as both: the class prior, the toxic share of the labels outside the held-out ids, corrects for it. A document's label
    is the largest where it repeats; of rows that share an id, the one whose text has the least hash is fitted.

    Near copies are a family whose members share one document's weight, so that the words of one text that was copied
    often do not look like a habit of toxic ones. Terms are counted on the cluster; the driver sees those chosen, the
    sample's minima and the places of chosen terms. Chosen are terms in three families or more whose rate among the
    positives is furthest from their rate among all, in units of its error. The penalty is the one whose verdicts
    at the cut have the least risk (of the same form) over five turns, in each of which a fifth of the families is left
    out of the fit."""
    known = cut(labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    prior = float(np.clip(share, 1e-3, 0.5))
    first = (F.xxhash64("doc_id"), "doc_id")
    toxic = known.where("toxic = 1").select("doc_id").orderBy(*first).limit(fit_rows).select("doc_id", F.lit(True).alias("toxic"), F.lit(False).alias("drawn"))
    drawn = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    drawn = drawn.orderBy(*first).limit(fit_rows).select("doc_id", F.lit(False).alias("toxic"), F.lit(True).alias("drawn"))
    chosen = cut(toxic.unionByName(drawn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("drawn").alias("drawn")))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "toxic", "drawn").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = cut(rows.mapInArrow(_term_batches, "doc_id long, toxic boolean, drawn boolean, terms array<binary>, counts array<int>, minima array<long>"))

    ids = sample.select("doc_id", "toxic", "drawn", "minima").orderBy("doc_id").collect()  # 2 * fit_rows rows of eight numbers at most
    of = families([r["minima"] for r in ids])
    sizes = {kind: Counter(f for f, r in zip(of, ids, strict=True) if r[kind]) for kind in ("toxic", "drawn")}
    weight = {r["doc_id"]: tuple(1 / sizes[kind][f] if r[kind] else 0.0 for kind in ("toxic", "drawn")) for f, r in zip(of, ids, strict=True)}
    n_toxic, n_drawn = (sum(w[k] for w in weight.values()) for k in (0, 1))
    if not n_toxic or not n_drawn:
        return PUModel({}, float(np.log(prior / (1 - prior))))

    spark = docs.sparkSession
    weights = spark.createDataFrame([(i, *w) for i, w in weight.items()], "_id long, as_toxic double, as_drawn double")
    flat = sample.select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("doc_id", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    counted = flat.join(F.broadcast(weights), F.col("doc_id") == F.col("_id")).groupBy("term").agg(F.sum("as_toxic").alias("p"), F.sum("as_drawn").alias("u"))
    base = (F.col("p") + F.col("u") + 1) / F.lit(n_toxic + n_drawn + 2)
    contrast = F.round(F.abs(F.col("p") / F.lit(n_toxic) - base) / F.sqrt(base * (1 - base) / F.lit(n_toxic)), 9)
    picked = counted.where(F.greatest("p", "u") >= LEAST_FAMILIES - 1e-9).withColumn("contrast", contrast).where(F.col("contrast") >= LEAST_CONTRAST)
    terms = [bytes(r["term"]) for r in picked.orderBy(F.desc("contrast"), "term").limit(vocabulary).select("term").collect()]
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "_term binary, number int")
    features: dict[int, dict[int, float]] = {i: {} for i in weight}
    for r in flat.join(F.broadcast(numbers), F.col("term") == F.col("_term")).select("doc_id", "number", "n").orderBy("doc_id", "number").toLocalIterator():
        features[r["doc_id"]][r["number"]] = math.log1p(r["n"])

    def part(kind: int, keep) -> Part:
        own = [i for i in weight if weight[i][kind] and keep(i)]
        return Part([features[i] for i in own], [weight[i][kind] for i in own])

    # families take turns by the hash of their first id, so that the folds do not depend on the order of rows
    turn = {r["doc_id"]: zlib.crc32(str(ids[f]["doc_id"]).encode()) % TURNS for f, r in zip(of, ids, strict=True)}
    risks = dict.fromkeys(DECAYS, 0.0)
    for fold in range(TURNS):
        fitted, rest = [(part(0, keep), part(1, keep)) for keep in (lambda i, fold=fold: turn[i] != fold, lambda i, fold=fold: turn[i] == fold)]
        for decay in DECAYS:
            w = fit_pu(*fitted, len(terms), prior, decay)
            caught, flagged = (float(p.weight[p.probabilities(w) >= CUT].sum()) for p in rest)
            risks[decay] += prior * (1 - caught) + max(0.0, flagged - prior * caught)
    best = min(DECAYS, key=risks.get)
    w = fit_pu(part(0, lambda i: True), part(1, lambda i: True), len(terms), prior, best)
    return PUModel({t: float(x) for t, x in zip(terms, w, strict=False)}, float(w[-1]))


def _score_batches(model: PUModel, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(at).cast(pa.binary())], pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), scores], names=[*(n for i, n in enumerate(batch.schema.names) if i != at), "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without text, plus score (0 to 1) of every whole text. The model's size is bounded by its vocabulary, and no
    row is shuffled for its score. Null and empty texts get the score of no words; repeated rows each get theirs; a
    column named score is replaced. Without toxic labels every score is that of the prior."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))
    rest = [c for c in docs.columns if c not in ("text", "score")]
    docs = docs.select(*rest, "text")
    schema = docs.select(*rest, F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(lambda batches: _score_batches(shipped.value, len(rest))(batches), schema)
