"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its byte n-grams (with word marks) and of itself, so a misspelling or an inflection
that was never seen shares most of its vector with known words. A text is read in runs of words; the mean
of a run's word vectors goes through a linear softmax, and the text is as toxic as its most toxic run, so that one
insult counts alike in a short and in a very long text. Vectors and softmax are trained jointly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BASE, U64, Tokens, blocks, crc_mod5, mix, release, text_bytes
from .training import Adam, sigmoid, training_rows

#: At most so many labelled rows of each class are learned from.
ROWS_PER_CLASS = 1500
#: And at most so many bytes of text of each class, so that the sample fits the driver; every text is scored whole.
BYTES_PER_CLASS = 32 << 20

BLOCK = 2 << 20


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dims: int = 4
    run: int = 6
    grams: tuple[int, ...] = (3, 4, 5)
    rounds: int = 4
    steps: int = 25
    rate: float = 0.1
    decay: float = 1e-6
    seed: int = 11


def subwords(tokens: Tokens, rows: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(position in rows, bucket) of each byte n-gram of <word> and of the whole word, for the tokens in rows."""
    start, length = tokens.start[rows], tokens.end[rows] - tokens.start[rows]
    size = length + 2
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), dtype=np.uint8)
    word = np.repeat(np.arange(len(rows)), size)
    inside = np.arange(len(data)) - at[word]
    source = np.clip(start[word] + inside - 1, 0, max(len(tokens.data) - 1, 0))
    data = tokens.data[source] if len(tokens.data) else data
    data = np.where(inside == 0, ord("<"), np.where(inside == size[word] - 1, ord(">"), data)).astype(U64)
    owners, values = [np.arange(len(rows))], [mix(tokens.hash[rows] ^ U64(0xA5A5))]
    for n in settings.grams:
        if len(data) < n:
            continue
        acc = np.full(len(data) - n + 1, U64(n))
        for j in range(n):
            acc = acc * U64(BASE) + data[j : len(data) - n + 1 + j] + U64(1)
        fits = inside[: len(acc)] + n <= size[word[: len(acc)]]
        owners.append(word[: len(acc)][fits])
        values.append(mix(acc[fits]))
    return np.concatenate(owners), (np.concatenate(values) & U64(settings.buckets - 1)).astype(np.int64)


def runs_of(count: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """First token (in the concatenation) of each run of `run` words, and the first run of each text with words."""
    n = -(-count // run)
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(count)), n)
    start = (np.cumsum(count) - count)[doc] + (np.arange(len(doc)) - first[doc]) * run
    return start, first[count > 0]


class Model:
    """Weights by bucket (vectors times the softmax difference), bias, and the calibration of the largest run."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, shift: float, settings: Settings):
        self.weight, self.bias, self.slope, self.shift, self.settings = weight.astype(np.float32), bias, slope, shift, settings

    def words(self, tokens: Tokens) -> np.ndarray:
        """The score of each token's mean vector; each distinct word is worked out once."""
        _, rows, at = np.unique(tokens.hash, return_index=True, return_inverse=True)
        if not len(rows):
            return np.zeros(0)
        owner, bucket = subwords(tokens, rows, self.settings)
        total = np.bincount(owner, weights=self.weight[bucket], minlength=len(rows))
        return (total / np.bincount(owner, minlength=len(rows)))[at]

    def largest(self, tokens: Tokens) -> np.ndarray:
        """The largest run's logit of each text; a text without words has the bias alone."""
        out = np.full(tokens.n_docs, self.bias)
        start, first = runs_of(tokens.count, self.settings.run)
        if len(start):
            size = np.diff(np.append(start, len(tokens.hash)))
            logits = np.add.reduceat(self.words(tokens), start) / size + self.bias
            out[tokens.count > 0] = np.maximum.reduceat(logits, first)
        return out

    def score(self, tokens: Tokens) -> np.ndarray:
        return sigmoid(self.slope * self.largest(tokens) + self.shift)


def train(texts: list[str | None], y: np.ndarray, totals: dict[int, int], settings: Settings = Settings()) -> Model:
    """Learns from whole texts and their labels (0 or 1).

    First every run has its text's label; then, in rounds, a toxic text is stood for by its largest run and
    another text by its largest run and all runs of the first stage. The calibration weighs the sample's classes as
    they are among all labelled rows.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.normal(0, 0.05, (settings.buckets, settings.dims)).astype(np.float32)
    out = rng.normal(0, 0.5, settings.dims).astype(np.float32)
    bias = np.zeros(1, dtype=np.float32)
    if not len(y) or len(set(y.tolist())) < 2:
        share = totals.get(1, 0) / max(sum(totals.values()), 1)
        return Model(np.zeros(settings.buckets), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), settings)
    tokens = Tokens(*text_bytes(pa.array(texts, pa.large_string())))
    _, rows, word = np.unique(tokens.hash, return_index=True, return_inverse=True)
    owner, bucket = subwords(tokens, rows, settings)
    per_word = np.bincount(owner, minlength=len(rows))
    start, first = runs_of(tokens.count, settings.run)
    size = np.diff(np.append(start, len(word)))
    run_of = np.repeat(np.arange(len(start)), size)
    doc_of = tokens.doc[start]
    runs_in = np.bincount(doc_of, minlength=tokens.n_docs)[doc_of]
    class_size = np.bincount(y, minlength=2)
    adam = Adam([vectors, out, bias], settings.rate)

    def logits() -> np.ndarray:
        mean = np.bincount(owner, weights=(vectors @ out)[bucket], minlength=len(rows)) / per_word
        return np.bincount(run_of, weights=mean[word], minlength=len(start)) / size + bias[0]

    def fit(weight: np.ndarray, steps: int) -> None:
        target = y[doc_of]
        for _ in range(steps):
            pull = weight * (sigmoid(logits()) - target) / weight.sum()
            by_word = np.bincount(word, weights=(pull / size)[run_of], minlength=len(rows)) / per_word
            by_bucket = np.bincount(bucket, weights=by_word[owner], minlength=settings.buckets)
            adam.step([np.outer(by_bucket, out).astype(np.float32) + settings.decay * vectors, (by_bucket @ vectors).astype(np.float32), np.array([pull.sum()], np.float32)])

    fit(1 / runs_in / class_size[y[doc_of]], settings.steps)
    for _ in range(settings.rounds):
        now = logits()
        top = np.zeros(len(start), dtype=bool)
        best = np.lexsort((-now, doc_of))
        top[best[np.unique(doc_of[best], return_index=True)[1]]] = True
        weight = np.where(y[doc_of] == 1, np.where(top, 1.0, 0.0), np.where(top, 0.5, 0.5 / runs_in)) / class_size[y[doc_of]]
        fit(weight, settings.steps)
    model = Model(vectors @ out, float(bias[0]), 1.0, 0.0, settings)
    x, share = model.largest(tokens), np.array([totals.get(c, 1) / class_size[c] for c in (0, 1)])[y]
    slope, shift = np.ones(1), np.zeros(1)
    calibration = Adam([slope, shift], 0.05)
    for _ in range(300):
        pull = share * (sigmoid(slope * x + shift) - y) / share.sum()
        calibration.step([np.array([(pull * x).sum()]) + 1e-4 * slope, np.array([pull.sum()])])
    model.slope, model.shift = float(slope[0]), float(shift[0])
    del tokens, owner, bucket, vectors, adam
    release()
    return model


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, held_out_fold: int = 0, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text of df.

    Learns from at most ROWS_PER_CLASS labelled rows and BYTES_PER_CLASS of each class outside the held-out fold; nothing but the text
    enters a score. A null or empty text scores as the bias; a null id counts as the empty text in the
    fold; rows with equal ids are scored apart; without labels of both classes the score is the share of label 1.
    Very long texts are scored over all their runs; an empty table gives an empty result. Other columns are not read.
    """
    rows, totals = training_rows(df, labels, label_col, id_col, text_col, held_out_fold, ROWS_PER_CLASS, BYTES_PER_CLASS)
    sample = sorted(rows.collect(), key=lambda r: (r.id, r.text or ""))  # bounded: ROWS_PER_CLASS and BYTES_PER_CLASS
    model = df.sparkSession.sparkContext.broadcast(train([r.text for r in sample], np.array([r.y for r in sample], dtype=np.int64), totals, settings))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                score = model.value.score(Tokens(*text_bytes(block.column(1))))
                held = crc_mod5(block.column(0).to_pylist()) == held_out_fold
                yield pa.record_batch([block.column(0), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
