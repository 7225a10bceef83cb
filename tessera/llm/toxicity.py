"""op9: toxicity by a classifier chain of linear models.

The data have one label.  Categories come from the data too: toxic documents of the sample are clustered by the features
that tell toxic from other documents (k-means, from fixed starts), and a category holds for the toxic documents of
one cluster.  Categories are predicted in a fixed order, the label last; each model sees the features and the
probabilities of the categories before it.  For training, those probabilities are out of fold, so that a later model meets the
quality of prediction that it will meet on new documents.  Fitting uses at most MOST_ROWS labelled documents for each
class (those with the least hash of doc_id); scoring runs over all documents and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as b
from .storage import materialize

MOST_ROWS, FOLDS, MOST_FEATURES, LEAST_Z, LEAST_DOCS, PENALTY = 3000, 5, 400, 5.0, 5, 0.5
GROUPS, STEPS = 2, 50
AT_ONCE, MOST_DOCS = 1 << 20, 2048  # bytes and documents of a block of work; short texts make wide tables
LEVELS, BEGINNINGS = (1, 2, 3), (5, 6, 7, 8, 9)

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def grams(buf: np.ndarray, offs: np.ndarray):
    """(hashes, documents) of all runs of letters in lower case, then of their first bytes, for each length."""
    n = len(buf)
    if not n:
        yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return
    solid = ~NOT_LETTER[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = solid & np.append(True, ~solid[:-1] | edge[1:n])
    last = solid & np.append(~solid[1:] | edge[1:n], True)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
    spans = b.Spans(buf, b.BYTE_LOWER)
    yield spans(starts, ends), doc
    for k in BEGINNINGS:
        some = ends - starts >= k
        yield spans(starts[some], starts[some] + k) ^ np.uint64(k), doc[some]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Penalised logistic regression by Newton's method; the last column is the intercept.  One class: a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 8.0 if len(y) and y[0] else -8.0
        return w
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), gradient)
        size = np.abs(step).max()
        w += step * min(1.0, 3 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """Fitted chain: chosen features (a hash and a least count each) and one weight vector a category over features,
    earlier probabilities and 1."""

    def __init__(self, features: np.ndarray, levels: np.ndarray, x: np.ndarray, labels: np.ndarray, fold: np.ndarray):
        self.hashes, self.column = np.unique(features, return_inverse=True)
        self.levels, self.weights = levels, []
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            out = np.zeros(len(y))
            for f in range(FOLDS):
                held = fold == f
                if held.any():
                    out[held] = predict(x[held], fit_logistic(x[~held], y[~held]))
            self.weights.append(fit_logistic(x, y))
            x = np.column_stack([x, out])

    def score(self, x: np.ndarray) -> np.ndarray:
        wide, out = x.shape[1], np.zeros((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            earlier = out[:, :k] @ w[wide : wide + k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(x @ w[:wide] + earlier + w[-1], -30, 30)))
        return out

    def presence(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return _presence(self.hashes, self.column, self.levels, buf, offs)


def _presence(hashes: np.ndarray, column: np.ndarray, levels: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, features): 1 where a document has the feature at least as often as its level."""
    count = np.zeros((len(offs) - 1, len(hashes)), np.int32)
    if len(hashes):
        for h, doc in grams(buf, offs):
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            np.add.at(count, (doc[hit], at[hit]), 1)
    return (count[:, column] >= levels).astype(float)


def clusters(x: np.ndarray, most: int = GROUPS, steps: int = STEPS) -> np.ndarray:
    """k-means numbers of the rows of x, 0 for the largest cluster.  Starts: the row farthest from the mean, then rows
    farthest from the starts so far; ties go to the first row.  Fewer different rows than clusters: fewer clusters."""
    if not len(x):
        return np.zeros(0, int)
    norm = x / np.maximum(1e-12, np.sqrt((x * x).sum(1, keepdims=True)))
    apart = lambda c: ((norm - c) ** 2).sum(1)
    centres = [norm[np.argmax(apart(norm.mean(0)).round(9))]]
    while len(centres) < most:
        away = np.min([apart(c) for c in centres], 0).round(9)
        if away.max() == 0:
            break
        centres.append(norm[np.argmax(away)])
    own = np.full(len(x), -1)
    for _ in range(steps):
        new = np.argmin([apart(c).round(9) for c in centres], 0)
        if (new == own).all():
            break
        own = new
        centres = [norm[own == k].mean(0) if (own == k).any() else c for k, c in enumerate(centres)]
    size = np.bincount(own, minlength=len(centres))
    rank = np.empty(len(centres), int)
    rank[np.argsort(-size, kind="stable")] = np.arange(len(centres))
    return rank[own]


def categories(x: np.ndarray, label: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """(documents, most + 1): whether a document is toxic and of each cluster, then the label."""
    y = np.zeros((len(label), most + 1), int)
    toxic = np.flatnonzero(label)
    y[toxic, clusters(x[toxic], most)] = 1
    y[:, -1] = label
    return y


def _features(batches):
    """For each feature of a batch the number of documents with it, and of toxic ones; one row a feature."""
    for batch in batches:
        buf, offs = b.texts_of(batch.column("text"))
        label = np.asarray(batch.column("label").to_numpy(zero_copy_only=False), int)
        keys, counts = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), int)]
        for i, j, part, at in b.slices(buf, offs, AT_ONCE, MOST_DOCS):
            both = np.column_stack([np.ones(j - i, int), label[i:j]])
            for h, doc in grams(part, at):
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                for level in LEVELS:
                    some = first[times >= level]
                    keys.append(np.stack([h[some].view(np.int64), np.full(len(some), level)], 1))
                    counts.append(both[doc[some]])
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, counts = keys[order], counts[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts, first) if len(first) else counts
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*keys[first].T, *sums.T)], names=["h", "level", "n", "n1"])


def _matrix(hashes: np.ndarray, column: np.ndarray, levels: np.ndarray):
    def run(batches):
        for batch in batches:
            buf, offs = b.texts_of(batch.column("text"))
            xs = []
            for _, _, part, at in b.slices(buf, offs, AT_ONCE, MOST_DOCS):
                xs += [r.tobytes() for r in np.packbits(_presence(hashes, column, levels, part, at).astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(xs, pa.binary())], names=["doc_id", "label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, groups: int = GROUPS) -> Chain:
    """Fit on at most most_rows documents with label 1 and as many with label 0.  Null labels, ids and texts are left
    out; a doc_id that is labelled or stored several times counts once (largest label, least text), and so do equal
    texts (least doc_id).  Features: words and word beginnings, by how often a document has them, whose shares differ
    between the classes by LEAST_Z standard errors; the most_features strongest."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most 2 * most_rows rows, so the broadcast is bounded
    picked = own.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).unionByName(own.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(picked), "doc_id")
    sample = materialize(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))).select("doc_id", "label", "text")
    size, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    chosen = []
    if 0 < positive < size:
        found = sample.mapInArrow(_features, "h long, level long, n long, n1 long").groupBy("h", "level").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).filter(F.col("n") >= LEAST_DOCS)
        share = F.col("n") / size
        z = F.abs(F.col("n1") / positive - (F.col("n") - F.col("n1")) / (size - positive)) / F.sqrt(F.greatest(F.lit(1e-12), share * (1 - share)) * (1 / positive + 1 / (size - positive)))
        chosen = found.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h", "level").limit(most_features).collect()
    chosen = sorted((np.uint64(r.h & 0xFFFFFFFFFFFFFFFF), r.level) for r in chosen)
    features, levels = np.array([c[0] for c in chosen], np.uint64), np.array([c[1] for c in chosen], np.int64)
    hashes, column = np.unique(features, return_inverse=True)
    rows = sorted(sample.mapInArrow(_matrix(hashes, column, levels), "doc_id long, label int, x binary").collect(), key=lambda r: r.doc_id)
    x = np.array([np.unpackbits(np.frombuffer(r.x, np.uint8))[: len(levels)] for r in rows], float).reshape(len(rows), len(levels))
    y = categories(x, np.array([r.label for r in rows], int), groups)
    fold = (b.mix(np.array([r.doc_id for r in rows], np.int64).astype(np.uint64)) % np.uint64(FOLDS)).astype(int) if rows else np.zeros(0, int)
    return Chain(features, levels, x, y, fold)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_group1 and so on in chain order, p_toxic, toxic.  One row per input row; a null or empty text has
    no words and gets the intercepts' probabilities.  Null ids and repeated rows are scored like others."""
    names = [*(f"p_group{k}" for k in range(1, len(chain.weights))), "p_toxic"]

    def run(batches):
        for batch in batches:
            buf, offs = b.texts_of(batch.column("text"))
            got = [np.zeros((0, len(names)))]
            for _, _, part, at in b.slices(buf, offs, AT_ONCE, MOST_DOCS):
                got.append(chain.score(chain.presence(part, at)))
            p = np.round(np.concatenate(got), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], names=["doc_id", *names, "toxic"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names), "toxic boolean"]))
