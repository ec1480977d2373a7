"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Each text is the set of its hashed character 3- to 5-grams (lower case). On a bounded sample of labelled texts executors
count every bucket by label, which gives its log-count ratio r = log((p+a)/|p|) - log((q+a)/|q|). The buckets that tell most
become features with value r, and a logistic regression is fitted on them: the driver fetches those features alone.
Scoring gathers one weight a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import code_points, fold, gram_hashes, labelled_sample, materialize, passes, sigmoid, small_batches, with_fields


@dataclass(frozen=True)
class Params:
    """max_train_rows and max_train_chars bound the labelled sample; max_features are the buckets that carry a weight, None: all that the sample has (then the driver holds every distinct bucket of every sampled text)."""

    label: str = "toxic"
    held_out: int = 2
    folds: int = 4
    threshold: float = 0.3
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    max_train_rows: int = 4000
    max_train_chars: int = 16_000_000
    max_features: int | None = 1000
    smoothing: float = 1.0
    penalty: float = 5e-4
    rounds: int = 300


def text_buckets(texts: list[str], sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct buckets of each text; wanted, a boolean per bucket, keeps some."""
    out: list[np.ndarray] = []
    lower = [t.lower() for t in texts]
    mask = np.uint32((1 << bits) - 1)
    for a, b in passes(np.fromiter(map(len, lower), dtype=np.int64, count=len(lower))):
        codes, starts = code_points(lower[a:b])
        owners, found = [], []
        for n in sizes:
            h = gram_hashes(codes, n)
            h &= mask
            at = np.flatnonzero(wanted[h]) if wanted is not None else np.arange(len(h))
            owner = np.searchsorted(starts, at, side="right") - 1
            # a gram may take in the zero before or after its text, but not reach over it
            ends = np.append(starts[1:], len(codes))
            keep = at + n <= np.where(owner >= 0, ends[np.maximum(owner, 0)], 0)
            first = (owner < 0) | ~keep
            if first.any():  # grams that begin with the zero before a text belong to that text
                nxt = owner + 1
                ok = first & (nxt < len(starts)) & (at == np.where(nxt < len(starts), starts[np.minimum(nxt, len(starts) - 1)], 0) - 1)
                ok &= at + n <= np.where(nxt < len(ends), ends[np.minimum(nxt, len(ends) - 1)], 0)
                owner, keep = np.where(ok, nxt, owner), keep | ok
            owners.append(owner[keep])
            found.append(h[at[keep]])
        pair = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(32)) | np.concatenate(found).astype(np.uint64))
        edges = np.searchsorted(pair, np.arange(1, b - a, dtype=np.uint64) << np.uint64(32))
        out += [x.astype(np.int32) for x in np.split((pair & np.uint64(0xFFFFFFFF)), edges)]
    return out


def ratios(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's log-count ratio, and its likelihood gain: how much knowing it tells of the label. pos, neg: texts of either label that have the bucket, of n1 and n0."""
    a, b = pos + p.smoothing, neg + p.smoothing
    ratio = np.log(a / a.sum()) - np.log(b / b.sum())
    a, b = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    either = (a * n1 + b * n0) / (n1 + n0)
    return ratio, np.where(pos + neg > 0, n1 * a * np.log(a / either) + n0 * b * np.log(b / either), 0.0)


def fit(owner: np.ndarray, feature: np.ndarray, values: np.ndarray, y: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Weights of the features, and the bias, by accelerated gradient steps over sparse rows: text owner[i] has feature[i]. values: of the features."""
    n = len(y)
    x = values[feature]
    positive = int(y.sum())
    w, bias = np.zeros(len(values)), float(np.log(positive / (n - positive)))
    step_w, step_b = np.zeros_like(w), 0.0
    scale = 0.25 * float((x * x).sum()) / n + p.penalty + 0.25
    for k in range(p.rounds):
        momentum = k / (k + 3)
        at_w, at_b = w + momentum * step_w, bias + momentum * step_b
        error = sigmoid(np.bincount(owner, weights=x * at_w[feature], minlength=n) + at_b) - y
        new_w = at_w - (np.bincount(feature, weights=x * error[owner], minlength=len(w)) / n + p.penalty * at_w) / scale * 2
        new_b = at_b - float(error.mean()) / scale * 2
        step_w, step_b, w, bias = new_w - w, new_b - bias, new_w, new_b
    return w, bias


def train(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the bias."""
    sample = labelled_sample(docs, labels, p.label, p.held_out, p.folds, p.max_train_rows, p.max_train_chars)

    def features(batches):
        for batch in batches:
            found = text_buckets(batch.column("text").to_pylist(), p.sizes, p.bits) if batch.num_rows else []
            yield pa.record_batch([batch.column("k"), batch.column("y"), pa.array(found, type=pa.list_(pa.int32()))], names=["k", "y", "f"])

    rows = materialize(sample.mapInArrow(features, "k long, y int, f array<int>"), "toxic-features")
    size = 1 << p.bits
    weights = np.zeros(size)
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("positive")).first()
    n, positive = seen["n"], seen["positive"]
    if positive in (0, n):  # one class only: its rate, smoothed
        rate = (positive + 0.5) / (n + 1)
        return weights, float(np.log(rate / (1 - rate)))
    counts = rows.select("y", F.explode("f").alias("b")).groupBy("b").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).toArrow()  # 2 ** bits rows at most
    pos, both = np.zeros(size), np.zeros(size)
    pos[counts.column("b").to_numpy()] = counts.column("pos").to_numpy()
    both[counts.column("b").to_numpy()] = counts.column("n").to_numpy()
    ratio, gain = ratios(pos, both - pos, positive, n - positive, p)
    chosen = np.argsort(-gain, kind="stable")[: p.max_features]
    chosen = np.sort(chosen[gain[chosen] > 0])
    place = np.full(size, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def wanted(batches):
        for batch in batches:
            found = [place[f] for f in (np.asarray(x.values) for x in batch.column("f"))]
            yield pa.record_batch([batch.column("k"), batch.column("y"), pa.array([f[f >= 0] for f in found], type=pa.list_(pa.int32()))], names=["k", "y", "f"])

    table = rows.mapInArrow(wanted, "k long, y int, f array<int>").toArrow()  # max_train_rows x max_features numbers at most
    table = table.take(np.lexsort((table.column("y").to_numpy(), table.column("k").to_numpy())))  # rows come in any order
    f = table.column("f").combine_chunks()
    owner = np.repeat(np.arange(n), np.diff(f.offsets.to_numpy()))
    w, bias = fit(owner, f.flatten().to_numpy(), ratio[chosen], table.column("y").to_numpy().astype(np.float64), p)
    weights[chosen] = w * ratio[chosen]
    return weights, bias


def score_toxicity(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> DataFrame:
    """docs with the added columns held_out, score and predicted (those of these names are replaced).

    Null and empty texts have no grams but those of their edges and get a score near the base rate. Repeated rows get the
    same score. An empty docs table gives an empty result; without labels every score is 0.5. Labels other than 0 and 1 are
    read as labelled_sample says.
    """
    p = p or Params()
    spark = docs.sparkSession
    small_batches(spark)
    weights, bias = train(docs, labels, p)
    used = weights != 0
    base = docs.drop("held_out", "score", "predicted")
    schema = with_fields(base, "score double")

    def score(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = text_buckets(texts, p.sizes, p.bits, used) if texts else []
            values = sigmoid(np.array([float(weights[f].sum(dtype=np.float64)) + bias for f in found]))
            yield pa.record_batch([*batch.columns, pa.array(values, type=pa.float64())], names=[*batch.schema.names, "score"])

    return base.mapInArrow(score, schema).withColumns(
        {"held_out": fold(F.col("doc_id"), p.folds) == p.held_out, "predicted": (F.col("score") >= p.threshold).cast("int")}
    )
