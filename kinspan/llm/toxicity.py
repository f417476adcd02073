"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts and unlabelled texts
only. With the class prior p, g(x) the score before the logistic function and
l(z) = log(1 + exp(-z)), the risk

    p E_toxic[l(g)] + max(0, E_unlabelled[l(-g)] - p E_toxic[l(-g)])

is minimised; where the second part falls below zero its gradient is reversed,
which keeps the classifier from fitting the unlabelled texts as clean ones.
Features say whether a text has a word or a word that begins with given letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, written
from .words import LOWER, SPACES_AND_MARKS, chunks, mix, shingles, words_of

#: Bytes of a word's beginning that are features beside the whole word.
PREFIX_BYTES = (4, 5, 6, 7, 8)
#: Bounds of the training sample: confirmed toxic texts, unlabelled texts.
MAX_TOXIC = 3000
MAX_UNLABELLED = 9000
#: Features that enter the model. They must occur in LEAST_TEXTS toxic texts and
#: more often there than chance allows: the Chernoff bound of their count, times the
#: number of features tried, is below exp(-MARGIN). Of their texts a share of
#: LEAST_PURITY must be toxic, as the class prior tells it, give or take TOLERANCE
#: standard deviations.
MAX_FEATURES = 20_000
LEAST_TEXTS = 4
MARGIN = 2.0
LEAST_PURITY = 0.85
TOLERANCE = 2.0
#: Shingle minima that the sample's texts are compared by: of texts that share one,
#: the first trains, so that copies of one text don't make its words look toxic.
SKETCH = 4
STEPS, STEP_SIZE, DECAY = 400, 0.1, 1e-5
FILTER_BITS = 22
#: Bytes of text whose features are held at once (six of 16 bytes a word and more).
FEATURE_BYTES = 1 << 19


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word of a chunk of texts; a text repeats features."""
    words = words_of(data, offsets, SPACES_AND_MARKS, LOWER)
    text = np.repeat(np.arange(len(offsets) - 1), words.counts())
    length = words.ends - words.starts
    found = [words.hashes()]
    texts = [text]
    for k in PREFIX_BYTES:
        has = length >= k
        found.append(mix(words.hashes(words.starts[has], words.starts[has] + k) + np.uint64(k)))
        texts.append(text[has])
    return np.concatenate(texts), np.concatenate(found)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in chunks(batch.column("text"), FEATURE_BYTES):
            text, feature = features(data, offsets)
            order = np.lexsort((feature, text))
            text, feature = text[order], feature[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
            text, feature = text[new], feature[new]
            ends = np.searchsorted(text, np.arange(to - at + 1)).astype(np.int32)
            hashes, counts = shingles(words_of(data, offsets, SPACES_AND_MARKS, LOWER))
            sketch = np.zeros((to - at, SKETCH), np.int64)
            full = counts > 0
            for k in range(SKETCH if len(hashes) else 0):
                sketch[full, k] = np.minimum.reduceat(mix(hashes + np.uint64(k)), (np.cumsum(counts) - counts)[full]).view(np.int64)
            columns = [batch.column("toxic").slice(at, to - at), pa.ListArray.from_arrays(ends, feature.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, (to - at) * SKETCH + 1, SKETCH, dtype=np.int32), sketch.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "features", "sketch"])


def one_of_copies(toxic: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Which rows share no shingle minimum with an earlier row of their kind."""
    keep = np.ones(len(toxic), bool)
    for k in range(SKETCH):
        seen: set[tuple[bool, int]] = set()
        for i in np.flatnonzero(keep):
            value = (bool(toxic[i]), int(sketches[i, k]))
            keep[i] = value not in seen
            seen.add(value)
    return keep


def fit_non_negative_pu(rows: list[np.ndarray], toxic: np.ndarray, prior: float, least_purity: float = LEAST_PURITY, non_negative: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Features (sorted), their weights and the intercept.

    ``rows`` holds the feature hashes of each text; ``toxic`` says which texts
    are the confirmed ones. Without any of either kind the model is the prior. A
    ``least_purity`` of 0 takes features whatever their share of toxic texts; without
    ``non_negative`` the risk is the plain unbiased one, which may fall below zero.
    """
    bias = float(np.log(prior / (1 - prior)))
    n_toxic, n_other = int(toxic.sum()), int((~toxic).sum())
    nothing = np.zeros(0, np.uint64), np.zeros(0), bias
    if not n_toxic or not n_other:
        return nothing
    flat, text = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen_toxic = toxic[text]
    names, counts = np.unique(flat[seen_toxic], return_counts=True)
    names, counts = names[counts >= LEAST_TEXTS], counts[counts >= LEAST_TEXTS]
    if not len(names):
        return nothing
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    hit = names[at] == flat
    other = np.bincount(at[hit & ~seen_toxic], minlength=len(names))
    chance = n_toxic * (other + 1.0) / (n_other + 2.0)
    evidence = np.where(counts > chance, counts * np.log(counts / chance) - counts + chance, 0.0)
    toxic_among_other = prior * counts / n_toxic * n_other
    pure = other * least_purity <= toxic_among_other + least_purity * TOLERANCE * np.sqrt(toxic_among_other)
    good = pure & (evidence >= np.log(len(names)) + MARGIN)
    chosen = np.sort(np.argsort(-np.where(good, evidence, -1.0), kind="stable")[: min(MAX_FEATURES, int(good.sum()))])
    if not len(chosen):
        return nothing
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = hit & (place[at] >= 0)
    column, row = place[at[keep]], text[keep]
    w, b = np.zeros(len(chosen)), bias
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    plus = toxic / n_toxic
    minus = (~toxic) / n_other
    for step in range(1, STEPS + 1):
        g = b + np.bincount(row, w[column], len(rows))
        s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
        soft = np.logaddexp(0, g)
        rest = minus @ soft - prior * (plus @ soft)
        correction = (minus - prior * plus) * s
        slope = prior * plus * (s - 1) + correction if rest >= 0 or not non_negative else -correction
        gradient = np.append(np.bincount(column, slope[row], len(chosen)) + DECAY * w, slope.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = STEP_SIZE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return names[chosen], w, float(b)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED, least_purity: float = LEAST_PURITY) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Rows without doc_id or text are not trained on; an id labelled both ways, or
    with a null label, has no label. The sample is at most ``max_toxic`` confirmed
    and ``max_unlabelled`` other texts, by the hash of the id. The class prior is the
    share of toxic ones among all labelled rows: there, and nowhere else, labels of 0 are
    used. The model has MAX_FEATURES features at most, those with the most evidence.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("lo"), F.max("toxic").alias("toxic")).where("lo = toxic").select("doc_id", "toxic")
    counted = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(known, "doc_id", "left").withColumn("order", F.xxhash64("doc_id"))
    share = counted.agg(F.avg("toxic").alias("p")).first().p
    prior = min(max(share if share is not None else 0.1, 1e-3), 0.5)
    some = counted.where("toxic = 1").orderBy("order", "doc_id").limit(max_toxic).select("doc_id", F.lit(True).alias("toxic"))
    rest = counted.withColumn("order", F.xxhash64("order")).orderBy("order", "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("toxic"))
    # The bounded sample's ids are broadcast: at most max_toxic + max_unlabelled rows.
    chosen = F.broadcast(written(some.union(rest), "sample"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("toxic", "text")
    sample = texts.mapInArrow(_sample_features, "toxic boolean, features array<long>, sketch array<long>")
    sample = written(sample, "features")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic, sketches = [], [], []
        for batch in batches:
            toxic += batch.column("toxic").to_pylist()
            sketches += batch.column("sketch").to_pylist()
            column = batch.column("features")
            values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            rows += [values[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        marked = np.array(toxic, bool)
        keep = np.flatnonzero(one_of_copies(marked, np.array(sketches, np.int64).reshape(len(rows), SKETCH)))
        names, weights, bias = fit_non_negative_pu([rows[i] for i in keep], marked[keep], prior, least_purity)
        model = [pa.array([x], pa.list_(t)) for x, t in ((names.view(np.int64), pa.int64()), (weights, pa.float64()))]
        yield pa.RecordBatch.from_arrays([*model, pa.array([bias])], ["names", "weights", "bias"])

    model = sample.repartition(1).mapInArrow(fit, "names array<long>, weights array<double>, bias double").first()
    if model is None:
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior)))
    return np.array(model.names, np.int64).view(np.uint64), np.array(model.weights, float), model.bias


class Scorer:
    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(names & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        text, feature = features(data, offsets)
        near = np.flatnonzero(self.maybe[(feature & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        text, feature = text[near], feature[near]
        at = np.minimum(np.searchsorted(self.names, feature), max(len(self.names) - 1, 0))
        hit = self.names[at] == feature if len(self.names) else np.zeros(0, bool)
        pairs = np.unique(text[hit] * np.int64(len(self.names)) + at[hit])
        g = self.bias + np.bincount(pairs // max(len(self.names), 1), self.weights[pairs % max(len(self.names), 1)], n)
        return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and score (0 to 1); null text scores as empty text."""
    schema = docs.select(*columns).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            found = [scorer.scores(data, offsets) for _, _, data, offsets in chunks(batch.column(batch.num_columns - 1), FEATURE_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0), *found]))], schema.names)

    return docs.select(*columns, F.col("text").cast("string").alias("text_")).mapInArrow(run, schema)


def bucket(column="doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out of training."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    A null doc_id is in no training fold and counts as held out. Null and empty texts
    have the intercept's score; texts of any length are scored whole; repeated rows give
    repeated scores; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(bucket() == 0, F.lit(True))
    model = train(docs.where(~held).select("doc_id", "text"), read_table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; other columns, whatever their
    names, pass unchanged. Null and empty texts score as the intercept does."""
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    text = docs.schema["text"]
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others, "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            found = [scorer.scores(data, offsets) for _, _, data, offsets in chunks(batch.column(batch.num_columns - 1), FEATURE_BYTES)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *found]) < 0.5))

    return docs.select(*others, F.col("text").cast(text.dataType).alias("text")).mapInArrow(run, schema).select(*docs.columns)


__all__ = ["Scorer", "drop_toxic", "fit_non_negative_pu", "op1_nnpu_toxicity", "score", "train"]
