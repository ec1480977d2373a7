"""Quality: supervised subword embeddings. Hashed words and their character n-grams have learned vectors; a text is their
mean, and a softmax layer stands on it.

Training is plain stochastic gradient descent in numpy on a bounded labelled sample. As mean and output layer are
linear, scoring needs one number a bucket: the vector's product with the difference of the two output rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import code_points, fold, gram_hashes, labelled_sample, passes, sigmoid, small_batches, with_fields


@dataclass(frozen=True)
class Params:
    """max_train_rows and max_train_chars bound the labelled sample. doubled: a vector of its own for words that follow themselves, beside those of the method."""

    label: str = "quality"
    held_out: int = 2
    folds: int = 4
    threshold: float = 0.7
    sizes: tuple[int, ...] = (3, 4)
    bits: int = 16
    dims: int = 10
    max_train_rows: int = 4000
    max_train_chars: int = 16_000_000
    doubled: bool = True
    epochs: int = 6
    rate: float = 1.0
    least_steps: int = 4000
    seed: int = 11


def text_features(texts: list[str], p: Params):
    """For each pass over some texts: the index of the first, and arrays of owner (from 0 in the pass) and bucket."""
    mask = np.uint32((1 << p.bits) - 1)
    for a, b in passes(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) if texts else np.zeros(0, np.int64)):
        codes, starts = code_points(texts[a:b])
        space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0)
        codes = np.where(space, np.uint32(32), codes)
        owners, found = [], []
        inside = np.cumsum(space)
        for n in p.sizes:  # grams within a word, its two edges marked by one white space
            h = gram_hashes(codes, n)
            at = np.flatnonzero(inside[n - 2 : len(codes) - 1] - inside[: len(h)] == 0) if len(h) else np.zeros(0, np.int64)
            owners.append(np.searchsorted(starts, at + 1, side="right") - 1)
            found.append(h[at] & mask)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        values = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        values ^= values >> np.uint64(29)
        places = np.arange(len(codes), dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        weighted = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * places)))
        whole, moved = total[end] - total[begin], weighted[end] - weighted[begin]
        h = (moved - whole * begin.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + whole  # order matters, place doesn't
        h ^= h >> np.uint64(31)
        owner = np.searchsorted(starts, begin, side="right") - 1
        owners.append(owner)
        found.append((h & np.uint64(mask)).astype(np.uint32))
        if p.doubled:
            twice = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
            owners.append(owner[twice])
            found.append(np.full(len(twice), 1 << p.bits, dtype=np.uint32))
        yield a, b, np.concatenate(owners), np.concatenate(found)


def fit(features: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """A number for each bucket whose mean, with the bias, is the log-odds of label 1. features: buckets and their shares."""
    random = np.random.default_rng(p.seed)
    vectors = random.uniform(-1 / p.dims, 1 / p.dims, ((1 << p.bits) + 1, p.dims)).astype(np.float32)
    out, bias = np.zeros((2, p.dims), dtype=np.float32), np.zeros(2, dtype=np.float32)
    if len(y):
        rate = (np.bincount(y, minlength=2)[:2] + 0.5) / (len(y) + 1)
        bias += np.log(rate).astype(np.float32)
    epochs = max(p.epochs, -(-p.least_steps // max(1, len(y)))) if len(set(y.tolist())) > 1 else 0
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            buckets, shares = features[i]
            rate = p.rate * (1 - step / steps)
            step += 1
            if not len(buckets):
                continue
            hidden = shares @ vectors[buckets]
            logits = out @ hidden + bias
            logits = np.exp(logits - logits.max())
            error = logits / logits.sum()
            error[y[i]] -= 1
            back = error @ out
            out -= rate * np.outer(error, hidden)
            bias -= 0.1 * rate * error
            vectors[buckets] -= (rate * len(buckets) ** 0.5) * np.outer(shares, back)
    return (vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[np.ndarray, float]:
    sample = labelled_sample(docs, labels, p.label, p.held_out, p.folds, p.max_train_rows, p.max_train_chars)

    def features(batches):
        for batch in batches:
            texts, buckets, shares = batch.column("text").to_pylist(), [], []
            for a, b, owner, found in text_features(texts, p):
                pair, n = np.unique((owner.astype(np.uint64) << np.uint64(32)) | found.astype(np.uint64), return_counts=True)
                edges = np.searchsorted(pair, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(32))
                for i in range(b - a):
                    own = n[edges[i] : edges[i + 1]].astype(np.float32)
                    buckets.append((pair[edges[i] : edges[i + 1]] & np.uint64(0xFFFFFFFF)).astype(np.int32))
                    shares.append(own / max(1.0, float(own.sum())))
            yield pa.record_batch([batch.column("k"), pa.array(buckets, type=pa.list_(pa.int32())), pa.array(shares, type=pa.list_(pa.float32())), batch.column("y")], names=["k", "b", "s", "y"])

    # bounded by max_train_chars, as a word or n-gram starts at a character
    rows = sample.mapInArrow(features, "k long, b array<int>, s array<float>, y int").toArrow()
    if not rows.num_rows:
        return fit([], np.zeros(0, np.int64), p)
    y = rows.column("y").to_numpy()
    order = np.lexsort((y, rows.column("k").to_numpy()))  # rows come in any order
    b, s = rows.column("b").combine_chunks(), rows.column("s").combine_chunks()
    cuts, flat, shares = b.offsets.to_numpy(), b.values.to_numpy(), s.values.to_numpy()
    return fit([(flat[cuts[i] : cuts[i + 1]], shares[cuts[i] : cuts[i + 1]]) for i in order], y[order], p)


def score_quality(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> DataFrame:
    """docs with the added columns held_out, score and predicted (those of these names are replaced).

    Null and empty texts have no words and get the score of the bias alone. Repeated rows get the same score; an empty docs
    table gives an empty result; without labels every score is 0.5.
    """
    p = p or Params()
    small_batches(docs.sparkSession)
    weights, bias = train(docs, labels, p)
    base = docs.drop("held_out", "score", "predicted")
    schema = with_fields(base, "score double")

    def score(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            values = np.zeros(len(texts))
            for a, b, owner, found in text_features(texts, p):
                total = np.bincount(owner, weights=weights[found], minlength=b - a)
                values[a:b] = total / np.maximum(1, np.bincount(owner, minlength=b - a))
            yield pa.record_batch([*batch.columns, pa.array(sigmoid(values + bias), type=pa.float64())], names=[*batch.schema.names, "score"])

    return base.mapInArrow(score, schema).withColumns(
        {"held_out": fold(F.col("doc_id"), p.folds) == p.held_out, "predicted": (F.col("score") >= p.threshold).cast("int")}
    )
