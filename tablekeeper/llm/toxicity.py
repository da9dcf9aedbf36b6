"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = 1 / (1 + exp(s - t_k)) with ascending thresholds t_k; the score s is one weighted sum for all
thresholds. Features are the words of a text and their first five bytes, by hash; a feature counts with
log(1 + occurrences). The result is the expected grade; a document is rejected if a grade above 0 is likelier.

The labels say toxic or not. Grade 0 is not toxic; toxic documents have grades 1 to 3 by thirds of the share
of their words that are marked features.

The model is fitted on a bounded sample: ``SAMPLE`` labelled documents, those of the smallest id digests.
Features are ``FEATURES`` ones seen in enough of its toxic documents (``least_seen``), those most tied to them.
All documents are scored, whole.

Defined results: NULL and blank texts score 0 words and are not rejected; labels without a document, or NULL
ones, are left out; without toxic labels nothing is rejected; repeated rows are scored each; an empty table
gives no rows; other columns are ignored.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from tablekeeper.llm import hashing
from tablekeeper.llm.tables import load, staged

SAMPLE = 20_000
FEATURES = 4096
#: The most toxic documents that a feature must be seen in.
LEAST = 4
PREFIX = 5
GRADES = 4
_PREFIX_SEED = np.uint64(0x7072656669780001)


def features(column):
    """(row, feature, occurrences) sorted by row and feature, and words per row."""
    words, bounds, prefixes = hashing.word_hashes(column, hashing.ALPHANUMERIC, PREFIX)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    both = np.concatenate((words, hashing.mixed(prefixes ^ _PREFIX_SEED)))
    return np.concatenate((row, row)), both, sizes


def _selected(column, known):
    """(row, feature number, occurrences) of the known features, and words per row."""
    row, found, sizes = features(column)
    if not len(known):
        none = np.empty(0, np.int64)
        return none, none, none, sizes
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    hit = known[at] == found
    joint, times = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
    return joint // len(known), joint % len(known), times, sizes


class Ordinal:
    """Weights shared by all thresholds."""

    def __init__(self, known, weights, thresholds):
        self.known, self.weights, self.thresholds = known, weights, thresholds

    def scores(self, row, feature, times, n):
        return np.bincount(row, self.weights[feature] * np.log1p(times), n) if len(row) else np.zeros(n)

    def probabilities(self, scores):
        """Of each grade, a row per document."""
        below = _sigmoid(self.thresholds[None, :] - scores[:, None])
        full = np.concatenate((np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))), axis=1)
        return np.diff(full, axis=1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(row, feature, times, grades, size, rounds=400, rate=0.1, ridge=1e-3):
    """Weights and thresholds by gradient steps (Adam) on the mean log-likelihood."""
    n, levels = len(grades), GRADES - 1
    x = np.log1p(times)
    weights = np.zeros(size)
    # The first threshold and the logs of the gaps keep the thresholds ascending.
    free = np.concatenate(([2.0], np.zeros(levels - 1)))
    moments = [np.zeros(size + levels), np.zeros(size + levels)]
    for step in range(1, rounds + 1):
        thresholds = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        s = np.bincount(row, weights[feature] * x, n)
        cumulative = np.concatenate((np.zeros((n, 1)), _sigmoid(thresholds[None, :] - s[:, None]), np.ones((n, 1))), axis=1)
        slope = cumulative * (1 - cumulative)
        at = np.arange(n)
        chance = np.maximum(cumulative[at, grades + 1] - cumulative[at, grades], 1e-12)
        upper, lower = slope[at, grades + 1] / chance, slope[at, grades] / chance
        by_score = (upper - lower) / n
        by_threshold = np.array([
            -(upper[grades == k].sum() - lower[grades == k + 1].sum()) / n for k in range(levels)])
        gaps = np.exp(free[1:])
        by_free = np.concatenate((
            [by_threshold.sum()], [by_threshold[k + 1:].sum() * gaps[k] for k in range(levels - 1)]))
        by_weight = np.bincount(feature, by_score[row] * x, size) + ridge * weights / n
        gradient = np.concatenate((by_weight, by_free))
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        weights -= move[:size]
        free -= move[size:]
    return weights, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def least_seen(n_bad, most=LEAST):
    """Toxic documents that a feature must be seen in: half the binary digits of their number, rounded up."""
    return min(most, max(1, math.ceil(math.log2(n_bad + 1) / 2)))


def train(docs, labels, sample=SAMPLE, most=FEATURES, least=LEAST):
    """Model from at most ``sample`` labelled documents."""
    picked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", (F.col("toxic") > 0).alias("toxic")).distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = staged(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text"),
                   "toxicity-sample")

    def count(batches):
        import pyarrow as pa

        for batch in hashing.small_batches(batches):
            row, found, sizes = features(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (found[1:] != found[:-1]))) if len(row) else []
            row, found = row[new], found[new]
            each, inverse = np.unique(found, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(each.view(np.int64)), pa.array(np.bincount(inverse, toxic[row], len(each)).astype(np.int64)),
                pa.array(np.bincount(inverse, ~toxic[row], len(each)).astype(np.int64)),
            ], ["feature", "bad", "good"])

    n_bad, n_good = texts.agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)),
                              F.coalesce(F.sum((~F.col("toxic")).cast("int")), F.lit(0))).first()
    if not n_bad or not n_good:
        return Ordinal(np.empty(0, np.uint64), np.empty(0), np.array([30.0, 31.0, 32.0]))
    seen = texts.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= least_seen(n_bad, least))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    chosen = seen.withColumn("odds", odds).where("odds > 1").orderBy(
        F.desc(F.col("odds") * F.col("bad")), "feature").limit(most).collect()
    known = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))
    marked = np.sort(np.array([r["feature"] for r in chosen if r["odds"] > 2], np.int64).view(np.uint64))

    def vectors(batches):
        import pyarrow as pa

        for batch in hashing.small_batches(batches):
            row, feature, times, sizes = _selected(batch.column("text"), known)
            lists = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("toxic"), pa.array(sizes),
                pa.ListArray.from_arrays(lists, pa.array(feature)), pa.ListArray.from_arrays(lists, pa.array(times)),
            ], ["toxic", "n", "feature", "times"])

    table = texts.mapInArrow(vectors, "toxic boolean, n long, feature array<long>, times array<long>").toArrow()
    table = table.combine_chunks()
    toxic = table.column("toxic").to_numpy().astype(bool)
    lists = table.column("feature").combine_chunks()
    feature = lists.flatten().to_numpy()
    times = table.column("times").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    is_marked = np.isin(known, marked)
    share = np.bincount(row, times * is_marked[feature], len(toxic)) / np.maximum(1, table.column("n").to_numpy())
    edges = np.quantile(share[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + np.searchsorted(edges, share), 0)
    weights, thresholds = fit_ordinal(row, feature, times, grades, max(1, len(known)))
    return Ordinal(known, weights, thresholds)


def scored(docs, model, carry=()):
    """``doc_id``, ``n_words``, ``score``, ``p_0`` ... ``p_3``, ``severity``, ``grade`` and ``rejected`` of every
    row; ``carry`` names further columns to keep."""
    columns = ["doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")]]
    rows = docs.select(*columns)
    kept = [f for f in rows.schema.fields if f.name == "doc_id" or f.name in carry]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "score", *[f"p_{k}" for k in range(GRADES)], "severity", "grade", "rejected"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [
        "n_words long", "score double", *[f"p_{k} double" for k in range(GRADES)], "severity double", "grade int",
        "rejected boolean"])

    def run(batches):
        import pyarrow as pa

        fitted = sent.value
        for batch in hashing.small_batches(batches):
            row, feature, times, sizes = _selected(batch.column("text"), fitted.known)
            score = fitted.scores(row, feature, times, len(sizes))
            chances = fitted.probabilities(score)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(f.name) for f in kept], pa.array(sizes), pa.array(score),
                *[pa.array(np.ascontiguousarray(chances[:, k])) for k in range(GRADES)],
                pa.array(chances @ np.arange(GRADES)), pa.array(chances.argmax(axis=1).astype(np.int32)),
                pa.array(chances[:, 0] < 0.5),
            ], [*[f.name for f in kept], *names])

    return rows.mapInArrow(run, schema)


def op6_toxicity(spark, folder):
    """Every row of ``documents`` with its severity."""
    docs = load(spark, folder, "documents")
    return scored(docs, train(docs, load(spark, folder, "labels")))
