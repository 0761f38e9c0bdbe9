"""Quality by random-indexing word vectors, pooled per document, and a two-layer network with calibrated temperature.

Every word, as it is written, has a fixed sparse ternary index vector by its hash. A word's vector is the sum of the index
vectors of the words around it over the whole corpus; being integers, the sums do not depend on partitions or order. A
document is the mean of its words' vectors with its length, and how well the words' vectors fit the words around them here:
mean and spread of their cosine with the local sum of index vectors, and of the product of neighbours' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Tokens, blocks, crc_mod5, release, text_bytes
from .training import ROWS_PER_CLASS, Adam, sigmoid, training_rows

BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    words: int = 1 << 15
    dims: int = 48
    entries: int = 4
    around: int = 2
    hidden: int = 32
    steps: int = 500
    rate: float = 0.01
    decay: float = 1e-3
    seed: int = 5

    @property
    def features(self) -> int:
        return self.dims + 6

    def index_vectors(self) -> np.ndarray:
        """A fixed sparse ternary vector for each hash bucket of words."""
        rng = np.random.default_rng(self.seed)
        out = np.zeros((self.words, self.dims), dtype=np.int8)
        for _ in range(self.entries):
            out[np.arange(self.words), rng.integers(0, self.dims, self.words)] = rng.choice(np.array([-1, 1], np.int8), self.words)
        return out


def words_of(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[Tokens, np.ndarray]:
    """Tokens as they are written, and the bucket of each."""
    tokens = Tokens(data, offsets, lower=False)
    return tokens, (tokens.hash >> U64(20) & U64(settings.words - 1)).astype(np.int64)


def surroundings(tokens: Tokens, word: np.ndarray, index: np.ndarray, settings: Settings) -> np.ndarray:
    """For each token the sum of the index vectors of the words around it in its text."""
    near = np.zeros((len(word), settings.dims), dtype=np.int8)
    own = index[word]
    for k in range(1, min(settings.around, len(word) - 1) + 1):
        same = (tokens.doc[k:] == tokens.doc[:-k])[:, None]
        near[k:] += own[:-k] * same
        near[:-k] += own[k:] * same
    return near


def _context_sums(settings: Settings):
    """Of each partition, the summed context vector and count of each word that occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = settings.index_vectors()
        total = np.zeros((settings.words, settings.dims + 1), dtype=np.int64)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                tokens, word = words_of(*text_bytes(block.column(0)), settings)
                if not len(word):
                    continue
                near = surroundings(tokens, word, index, settings)
                order = np.argsort(word, kind="stable")
                ids, start = np.unique(word[order], return_index=True)
                total[ids, :-1] += np.add.reduceat(near[order], start, axis=0, dtype=np.int64)
                total[ids, -1] += np.diff(np.append(start, len(word)))
        seen = np.flatnonzero(total[:, -1])
        yield pa.record_batch([pa.array(seen.astype(np.int32))] + [pa.array(total[seen, j]) for j in range(settings.dims + 1)], names=["word"] + [f"s{j}" for j in range(settings.dims + 1)])

    return run


def word_vectors(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Centred unit vectors of all words, from every text of docs; a word that never occurs is the zero vector."""
    names = [f"s{j}" for j in range(settings.dims + 1)]
    sums = docs.mapInArrow(_context_sums(settings), "word int, " + ", ".join(f"{c} long" for c in names))
    table = sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # a fixed number of buckets
    out, counts = np.zeros((settings.words, settings.dims)), np.zeros(settings.words)
    ids, values = table["word"].to_numpy(), np.stack([table[c].to_numpy() for c in names], axis=1).astype(np.float64)
    counts[ids] = values[:, -1]
    out[ids] = values[:, :-1] / np.maximum(values[:, -1:], 1)
    seen = counts > 0
    if seen.any():
        out[seen] -= np.average(out[seen], axis=0, weights=counts[seen])
        out[seen] /= np.linalg.norm(out[seen], axis=1, keepdims=True) + 1e-6
    return out.astype(np.float32)


def pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, index: np.ndarray, settings: Settings) -> np.ndarray:
    """Each document's mean word vector, its length, log word count, and mean and spread of the words' fit to the words
    around them and of neighbours' products (no words: zeros)."""
    tokens, word = words_of(data, offsets, settings)
    some = tokens.count > 0
    out = np.zeros((tokens.n_docs, settings.features), dtype=np.float64)
    if some.any():
        starts, count = tokens.first[:-1][some], tokens.count[some].astype(np.float64)
        mean = lambda x: np.add.reduceat(x, starts, axis=0, dtype=np.float64)
        own = vectors[word]
        near = surroundings(tokens, word, index, settings).astype(np.float32)
        fit = np.einsum("ij,ij->i", near, own) / (np.sqrt(np.einsum("ij,ij->i", near, near)) + 1e-6)
        step = np.zeros(len(word), dtype=np.float32)
        step[1:] = np.einsum("ij,ij->i", own[1:], own[:-1]) * (tokens.doc[1:] == tokens.doc[:-1])
        out[some, : settings.dims] = mean(own) / count[:, None]
        out[some, settings.dims] = np.linalg.norm(out[some, : settings.dims], axis=1)
        out[some, settings.dims + 1] = np.log(count)
        for k, x in enumerate((fit, step)):
            middle = mean(x) / count
            out[some, settings.dims + 2 + 2 * k] = middle
            out[some, settings.dims + 3 + 2 * k] = np.sqrt(np.maximum(mean(x * x) / count - middle * middle, 0))
    return out


class Network:
    """Standardised inputs, one hidden layer, a logit and its temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.parts = mean, scale, w1, b1, w2, b2, temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2, temperature = self.parts
        return sigmoid((np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2[0]) / temperature)


def train_network(x: np.ndarray, y: np.ndarray, totals: dict[int, int], settings: Settings) -> Network:
    """Learns on four fifths of the sample and sets the temperature on the rest; classes weigh as among all labelled rows."""
    rng = np.random.default_rng(settings.seed)
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    n = x.shape[1]
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), np.array([np.log((share + 1e-6) / (1 - share + 1e-6))]), 1.0)
    weight = np.array([totals.get(c, 1) / max((y == c).sum(), 1) for c in (0, 1)])[y]
    check = np.arange(len(y)) % 5 == 4
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    w1 = rng.normal(0, n**-0.5, (n, settings.hidden))
    b1, w2, b2 = np.zeros(settings.hidden), rng.normal(0, settings.hidden**-0.5, settings.hidden), np.zeros(1)
    adam = Adam([w1, b1, w2, b2], settings.rate)
    fx, fy, fw = z[~check], y[~check], weight[~check] / weight[~check].sum()
    for _ in range(settings.steps):
        h = np.tanh(fx @ w1 + b1)
        pull = fw * (sigmoid(h @ w2 + b2[0]) - fy)
        back = np.outer(pull, w2) * (1 - h * h)
        adam.step([fx.T @ back + settings.decay * w1 / n, back.sum(axis=0), h.T @ pull + settings.decay * w2 / n, np.array([pull.sum()])])
    logit = np.tanh(z[check] @ w1 + b1) @ w2 + b2[0]

    def loss(t: float) -> float:
        p = np.clip(sigmoid(logit / t), 1e-9, 1 - 1e-9)
        return float(-(weight[check] * np.where(y[check] == 1, np.log(p), np.log(1 - p))).sum())

    return Network(mean, scale, w1, b1, w2, b2, min(np.geomspace(0.25, 8, 61), key=loss))


class Scorer:
    """Scores blocks of texts with word vectors and a network."""

    def __init__(self, vectors: np.ndarray, network: Network, settings: Settings):
        self.vectors, self.network, self.settings, self.index = vectors, network, settings, settings.index_vectors()

    def __call__(self, column: pa.Array) -> np.ndarray:
        return self.network.score(pool(*text_bytes(column), self.vectors, self.index, self.settings))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out_fold: int, settings: Settings) -> Scorer:
    """Word vectors from all texts of docs (no labels enter them), and a network from at most ROWS_PER_CLASS labelled
    rows of each class outside the held-out fold."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs.select(F.col(text_col).alias("text")), settings))
    rows, totals = training_rows(docs, labels, label_col, id_col, text_col, held_out_fold, ROWS_PER_CLASS)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = settings.index_vectors()
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                x = pool(*text_bytes(block.column(1)), vectors.value, index, settings)
                yield pa.record_batch([block.column(0), block.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    sample = rows.mapInArrow(pooled, f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<double>").collect()  # bounded: ROWS_PER_CLASS
    sample.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in sample]).reshape(len(sample), settings.features)
    scorer = Scorer(vectors.value, train_network(x, np.array([r.y for r in sample], dtype=np.int64), totals, settings), settings)
    del sample, x
    release()
    return scorer


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, held_out_fold: int = 0, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text of df.

    A null or empty text is the zero vector; a null id counts as the empty text in the fold; rows with equal ids
    are scored apart; with fewer than ten labelled rows, or without labels of both classes, the score is the share of label 1.
    Very long texts are pooled whole, as blocks of their own; an empty table gives an empty result. Other columns are not read.
    """
    scorer = df.sparkSession.sparkContext.broadcast(learn(df, labels, id_col, text_col, label_col, held_out_fold, settings))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                score = scorer.value(block.column(1))
                held = crc_mod5(block.column(0).to_pylist()) == held_out_fold
                yield pa.record_batch([block.column(0), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, held_out_fold: int = 0, settings: Settings = Settings()) -> DataFrame:
    """The rows of df, with all their columns, whose quality score reaches the threshold; row by row, without a join.

    Null and empty texts, repeated ids, few labels, very long texts and empty tables are handled as by `score_quality`; columns
    of any name pass through.
    """
    scorer = df.sparkSession.sparkContext.broadcast(learn(df, labels, id_col, text_col, label_col, held_out_fold, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text_col, BLOCK):
                column = block.column(block.schema.get_field_index(text_col))
                yield block.filter(pa.array(scorer.value(column) >= threshold))

    return df.mapInArrow(run, df.schema)
