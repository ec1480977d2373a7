"""LM scoring: likelihood under a subword lattice.

The pieces of an existing vocabulary are the arcs of a lattice over the bytes of a text; a text's probability is the sum
over all ways to cut it into pieces, by a forward recursion in log space. A text is its words, each with one space before
it (what white space stood there isn't scored), and one end. No piece that occurs in it holds a space but at its start, so
the lattice of a text falls apart into those of its words, and its log10 probability is the sum of theirs and of the end.
Each distinct word is scored once, wherever it occurs.

The vocabulary is never changed. All its pieces are kept, and their scores weight the arcs as they stand: the file's scores
are ranks, read as weights 1 / (rank + 2.7) and normalised. Every single byte is a piece, so every text has a probability.

Two variants are off by default. `rounds` fits the weights by expected counts over the lattices of all training words.
`whole_words` makes each word of the training texts an arc of its own, weighted by its count: a share of all words is drawn
whole, the others cut, and the share is fitted with each occurrence left out of its own word's count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import fold, materialize, powers, small_batches

POWER, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
LONG = 40  # bytes; longer words are scored one by one
PIECE, BEGINNING = np.uint8(1), np.uint8(2)
PASS_WORDS, PASS_BYTES = 1 << 16, 4 << 20  # words that are scored together: few of one length would leave numpy with small arrays

Arcs = dict[tuple[int, int], tuple[np.ndarray | slice, np.ndarray]]


@dataclass(frozen=True)
class Params:
    """vocabulary: a sentencepiece model file, by default the one of the public tokenizers; block_bytes: text that one task holds at once."""

    vocabulary: str | None = None
    held_out: int = 2
    folds: int = 7
    rounds: int = 0
    whole_words: bool = False
    prior: float = 0.001
    block_bytes: int = 16 << 20


def vocabulary(path: str | None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (spaces where the file marks them), all 256 bytes among them, and their log weights (natural)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    rank = 0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        rank += 1
        if raw:
            found[raw] = max(found.get(raw, -np.inf), -np.log((20_000 if model.is_byte(i) else rank) + 2.7))
    for b in range(256):
        found.setdefault(bytes([b]), -np.log(40_000.0))
    pieces = sorted(found)
    weights = np.array([found[x] for x in pieces])
    return pieces, weights - np.logaddexp.reduce(weights)


def log_sums(n: int, terms: list[tuple[np.ndarray | slice, np.ndarray]]) -> np.ndarray:
    """For each of n words the logarithm of the sum of its terms. terms: which words have one, each once, and its logarithm."""
    top, total = np.full(n, -np.inf), np.zeros(n)
    for at, x in terms:
        top[at] = np.maximum(top[at], x)
    for at, x in terms:
        total[at] += np.exp(x - top[at])
    return top + np.log(total)


class Lattice:
    """Forward and backward recursions over the pieces, for many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.index = pieces, {x: i for i, x in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for k in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == k)
            data = np.frombuffer(b"".join(pieces[i] for i in at), dtype=np.uint8).reshape(len(at), k)
            hashes[at] = ((data.astype(np.uint64) + np.uint64(1)) * powers(POWER, k)).sum(axis=1, dtype=np.uint64) + np.uint64(k)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two pieces share a hash")
        # by hash, whether it may be a piece's (1), and whether it may be that of a longer piece's beginning (2)
        self.filter = np.zeros(1 << 22, dtype=np.uint8)
        self.filter[self.slot(hashes)] = PIECE
        data = np.frombuffer(b"".join(x.ljust(self.longest, b"\0") for x in pieces), dtype=np.uint8).reshape(len(pieces), -1)
        h = np.zeros(len(pieces), dtype=np.uint64)
        for k, power in enumerate(powers(POWER, self.longest)[:-1], 1):
            h += (data[:, k - 1].astype(np.uint64) + np.uint64(1)) * power
            self.filter[self.slot(h[sizes > k] + np.uint64(k))] |= BEGINNING
        self.single = np.array([self.index.get(bytes([b]), -1) for b in range(256)])

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * SPREAD) >> np.uint64(42)

    def arcs(self, words: np.ndarray) -> Arcs:
        """words: n x L bytes. By start and length: the words that have a piece there (a slice, if all have), and which.

        From each start on only the words that a longer piece may still fit are followed.
        """
        n, size = words.shape
        out: Arcs = {}
        p = powers(POWER, self.longest)
        data = np.ascontiguousarray(words.T)
        values = data.astype(np.uint64) + np.uint64(1)
        for i in range(size):
            ids = self.single[data[i]]
            at = np.flatnonzero(ids >= 0)
            if len(at):
                out[i, 1] = (slice(None), ids) if len(at) == n else (at, ids[at])
            h = values[i] * p[0]
            live = np.flatnonzero(self.filter[self.slot(h + np.uint64(1))] & BEGINNING)
            h = h[live]
            for k in range(2, min(self.longest, size - i) + 1):
                if not len(live):
                    break
                h = h + values[i + k - 1, live] * p[k - 1]
                g = h + np.uint64(k)
                found = self.filter[self.slot(g)]
                at = np.flatnonzero(found & PIECE)
                if len(at):
                    place = np.minimum(np.searchsorted(self.sorted, g[at]), len(self.sorted) - 1)
                    same = self.sorted[place] == g[at]
                    if same.any():
                        out[i, k] = (live[at[same]], self.order[place[same]])
                on = np.flatnonzero(found & BEGINNING)
                live, h = live[on], h[on]
        return out

    def forward(self, words: np.ndarray, weights: np.ndarray, arcs: Arcs | None = None) -> np.ndarray:
        """alpha: (L + 1) x n, the log probability of all ways to each place."""
        arcs = self.arcs(words) if arcs is None else arcs
        n, size = words.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            into = [(j - k, arcs[j - k, k]) for k in range(1, min(self.longest, j) + 1) if (j - k, k) in arcs]
            alpha[j] = log_sums(n, [(at, alpha[i][at] + weights[ids]) for i, (at, ids) in into])
        return alpha

    def expect(self, words: np.ndarray, counts: np.ndarray, weights: np.ndarray, share: float, n_all: float, total: np.ndarray) -> None:
        """Add the expected number of each piece over all ways to cut the words, and last the number of words that were cut.

        A word is cut, or else drawn whole with the probability of its other occurrences (its own left out).
        """
        arcs = self.arcs(words)
        alpha = self.forward(words, weights, arcs)
        n, size = words.shape
        cut = (1 - share) * np.exp(np.maximum(alpha[size], -700.0))
        counts = counts * cut / (cut + share * np.maximum(counts - 1, 0) / n_all)
        total[-1] += counts.sum()
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0
        which, found = [], []
        for i in range(size - 1, -1, -1):
            out = [(ids, at, beta[i + k][at] + weights[ids]) for k in range(1, min(self.longest, size - i) + 1) if (i, k) in arcs for at, ids in [arcs[i, k]]]
            beta[i] = log_sums(n, [(at, x) for _, at, x in out])
            for ids, at, x in out:
                which.append(ids)
                found.append(np.exp(alpha[i][at] + x - alpha[size][at]) * counts[at])
        total += np.bincount(np.concatenate(which), weights=np.concatenate(found), minlength=len(total))

    def long_forward(self, word: bytes, weights: np.ndarray) -> float:
        """The same for one word of any length; the window of places it keeps is as long as the longest piece."""
        alpha = [0.0]
        for j in range(1, len(word) + 1):
            terms = [alpha[-k] + weights[p] for k in range(1, min(self.longest, j) + 1) if (p := self.index.get(word[j - k : j])) is not None]
            top = max(terms)
            alpha.append(top + float(np.log(sum(np.exp(t - top) for t in terms))))
            if len(alpha) > self.longest:
                alpha.pop(0)
        return alpha[-1]

    def scores(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Natural log probability of each word with the space before it."""
        out = np.zeros(len(words))
        for size, at in by_length(words).items():
            if size > LONG:
                out[at] = [self.long_forward(b" " + words[i], weights) for i in at]
            else:
                for k in range(0, len(at), 4096):
                    out[at[k : k + 4096]] = self.forward(matrix([words[i] for i in at[k : k + 4096]]), weights)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, weights: np.ndarray, share: float, n_all: float, total: np.ndarray) -> None:
        for size, at in by_length(words).items():
            step = 4096 if size <= LONG else max(1, (1 << 18) // size)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                self.expect(matrix([words[i] for i in part]), counts[part], weights, share, n_all, total)


def by_length(words: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    return {int(sizes[g[0]]): g for g in np.split(order, cuts) if len(g)}


def matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8).reshape(len(words), -1)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of words put together, PASS_WORDS or PASS_BYTES at a time, about."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PASS_WORDS or size >= PASS_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only


def word_counts(docs: DataFrame, p: Params) -> DataFrame:
    """word, c: how often each word of any document occurs in the training documents (0 if in others only)."""

    def count(batches):
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text, out in zip(batch.column("text").to_pylist(), batch.column("out").to_pylist(), strict=True):
                if out:
                    for w in set(tokens(text)):
                        held.setdefault(w, 0)
                else:
                    held.update(tokens(text))
            if len(held) > 300_000:
                yield pa.record_batch([pa.array(list(held), type=pa.binary()), pa.array(list(held.values()), type=pa.int64())], names=["word", "c"])
                held = Counter()
        if held:
            yield pa.record_batch([pa.array(list(held), type=pa.binary()), pa.array(list(held.values()), type=pa.int64())], names=["word", "c"])

    texts = docs.select("text", (fold(F.col("doc_id"), p.folds) == p.held_out).alias("out"))
    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_weights(words: DataFrame, pieces: list[bytes], weights: np.ndarray, n_all: int, p: Params) -> tuple[np.ndarray, float]:
    """Weights of the pieces and the share of words drawn whole; what comes to the driver is one number a piece."""
    prior, share = np.exp(weights), 0.5 if p.whole_words else 0.0
    for _ in range(max(p.rounds, p.whole_words) if n_all else 0):

        def expect(batches, weights=weights, share=share):
            lattice, total = Lattice(pieces), np.zeros(len(pieces) + 1)
            for batch in together(batches):
                lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64), weights, share, float(n_all), total)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, type=pa.int64()), pa.array(total[at], type=pa.float64())], names=["piece", "n"])

        rows = words.where("c > 0").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(pieces) + 1)
        n[rows.column("piece").to_numpy()] = rows.column("n").to_numpy()
        share = float(np.clip(1 - n[-1] / n_all, 0.01, 0.99)) if p.whole_words else 0.0
        if not p.rounds:
            break
        n = n[:-1] + prior * max(1.0, p.prior * n[:-1].sum())  # every piece keeps a little of its first weight
        weights = np.log(n) - np.log(n.sum())
    return weights, share if n_all else 0.0


def score_lm(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    A null or empty text is its end alone. Repeated rows count as often as they occur and each gets its row. Without training
    rows N and V are 0, and no weight is fitted. Other columns of docs are not read, whatever their names.
    """
    p = p or Params()
    spark = docs.sparkSession
    small_batches(spark)
    pieces, weights = vocabulary(p.vocabulary)
    words = materialize(word_counts(docs, p), "lm-words")
    out = fold(F.col("doc_id"), p.folds) == p.held_out
    sums = docs.agg(F.count(F.when(~out, 1)).alias("ends"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars")).first()
    got = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = sums["ends"]
    n, v = got["n"] + ends, got["v"] + (1 if ends else 0)
    weights, share = fit_weights(words, pieces, weights, got["n"], p)
    # a word or the end comes next: the end's share is as its share of all that was seen
    seen = float(ends) + 1.0
    log_end = float(np.log10(seen / (seen + max(1.0, got["n"]))))
    log_more = float(np.log10(1 - 10**log_end))

    def scored(batches):
        lattice = Lattice(pieces)
        for batch in together(batches):
            ws = batch.column("word").to_pylist()
            cut = np.log1p(-share) + lattice.scores(ws, weights)
            with np.errstate(divide="ignore"):
                whole = np.log(share * batch.column("c").to_numpy() / max(1, got["n"]))
            values = np.logaddexp(cut, whole) / np.log(10) + log_more
            yield from batch.append_column("lp", pa.array(values, type=pa.float64())).to_batches(max_chunksize=8192)

    known = words.mapInArrow(scored, "word binary, c long, lp double")
    blocks = max(1, -(-int(sums["chars"] or 0) // p.block_bytes))
    own = docs.select("doc_id", "text", out.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    own = own.repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")

    def distinct(batches):
        held: dict[int, set[bytes]] = {}
        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(block, set()).update(tokens(text))
        for block, ws in held.items():
            ws = list(ws)
            for k in range(0, len(ws), 50_000):
                part = ws[k : k + 50_000]
                yield pa.record_batch([pa.array([block] * len(part), type=pa.int64()), pa.array(part, type=pa.binary())], names=["block", "word"])

    needed = own.select("block", "text").mapInArrow(distinct, "block long, word binary").join(known.hint("merge"), "word").select("block", "word", "c", "lp")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(right.column("word").to_pylist())}
        c, lp = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base = np.log10((c + 1) / (n + (v + 1)))
        end = np.log10((ends + 1) / (n + (v + 1)))
        size, known, low, high = [], [], [], []
        for text in left.column("text"):
            at = np.fromiter(map(place.__getitem__, tokens(text.as_py())), dtype=np.int64)
            size.append(len(at) + 1)
            known.append(int((c[at] > 0).sum()) + (1 if ends else 0))
            low.append(float(base[at].sum() + end))
            high.append(float(lp[at].sum() + log_end))
        return pa.table(
            [left.column("doc_id"), left.column("held_out"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * len(size), pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return own.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(
        total, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
