"""Language-model scoring by deleted interpolation.

P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1), where the weights (l2, l1, l0) belong to the
bucket of c(v) by powers of two and are learned by expectation-maximisation: counts of one part of the training
documents (held in) give the probabilities of the other part's n-grams (held out).

The n-gram tables grow with the corpus and are never gathered: each block of texts asks for the counts of its own
distinct n-grams, dealt by ranges of their hashes; whoever has a range sums it over all blocks and answers each
block in the order it asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..lineage import cut, steady, width
from .kernels import U64, Tokens, blocks, crc_mod5, gaps, home_key, mix, narrow, pack, release, text_bytes, unpack

#: The mark that ends every text, and stands before its first word as context.
END = U64(0x243F6A8885A308D3)
#: Bytes of text in a block, and in the slices it is tokenised in.
BLOCK, SLICE = 16 << 20, 4 << 20
#: Positions that are scored at once.
CHUNK = 1 << 18
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ...
BUCKETS = 40
#: Bits of a bigram's hash; the chance that a bigram shares its hash with another stays below 2**-20 up to 2**36 bigrams.
BIGRAM_BITS = 56

SCHEMA_ASK = "key int, block string, kind int, body binary"
SCHEMA_SCORE = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_token double"


def _key(hashes: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """The range of a hash among `keys` equal ranges."""
    return ((hashes >> U64(bits - 32)) * U64(keys)) >> U64(32)


def _sequence(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted tokens (words, then one end per text), whether each is the first of its text, text lengths."""
    parts = [_slice_sequence(Tokens(*text_bytes(part.column(1)))) for part in blocks(block, "text", SLICE)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _by_frequency(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency ranks instead of indices (small numbers for common words), and the index of each rank."""
    order = np.argsort(-np.bincount(at, minlength=n), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(n)
    return rank[at], order


def _slice_sequence(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(tokens.hash) + tokens.n_docs
    sequence = np.full(n, END, dtype=U64)
    sequence[np.arange(len(tokens.hash)) + tokens.doc] = tokens.hash
    lengths = tokens.count + 1
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    return sequence, first, lengths


def _bigram_index(table: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigram hashes of a sequence of indices into `table`, and each position's index among them."""
    end = int(np.searchsorted(table, END))
    context = np.empty_like(at)
    context[1:] = at[:-1]
    context[first] = end
    pairs = mix(table[context] * U64(0xD1342543DE82EF95) + table[at] * U64(0x2545F4914F6CDD1D) + U64(1)) >> U64(64 - BIGRAM_BITS)
    return np.unique(pairs, return_inverse=True)


def _ask(keys: int, id_type: str, test_fold: int, deleted_fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                ids, folds = block.column(0), crc_mod5(block.column(0).to_pylist())
                sequence, first, lengths = _sequence(block)
                role = np.where(folds == test_fold, 2, np.where(folds == deleted_fold, 1, 0)).astype(np.uint8)
                roles = np.repeat(role, lengths)
                words, at = np.unique(sequence, return_inverse=True)
                pairs, pair_at = _bigram_index(words, at, first)
                name = f"{TaskContext.get().partitionId()}.{number}"
                number += 1
                parts = []
                for values, where, bits in ((words, at, 64), (pairs, pair_at, BIGRAM_BITS)):
                    held_in = np.bincount(where[roles == 0], minlength=len(values))
                    deleted = np.bincount(where[roles == 1], minlength=len(values))
                    edges = np.searchsorted(_key(values, bits, keys), np.arange(keys + 1))
                    parts.append((values, held_in, deleted, edges))
                rows = []
                for k in range(keys):
                    cut_ = [x[e[k] : e[k + 1]] for values, a, b, e in parts for x in (values, a, b)]
                    if len(cut_[0]) or len(cut_[3]):
                        rows.append((k, name, 0, pack(gaps(cut_[0]), narrow(cut_[1]), narrow(cut_[2]), gaps(cut_[3]), narrow(cut_[4]), narrow(cut_[5]))))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
                    out.write_batch(pa.record_batch([ids], names=["id"]))
                rows.append((home_key(name, keys), name, 1, pack(np.frombuffer(sink.getvalue(), np.uint8), role, narrow(lengths), *map(narrow, _by_frequency(at, len(words))))))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["key", "block", "kind", "body"]), schema=pa.schema([("key", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("body", pa.binary())]), preserve_index=False)

    return run


def _sum_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """All requests for one range of hashes: sums them and answers each; passes the blocks' documents on."""
    out = [(0, r.block, 1, r.body) for r in pdf.itertuples() if r.kind == 1]
    asks = [(r.block, unpack(r.body)) for r in pdf.itertuples() if r.kind == 0]
    if asks:
        answers, stat = [], None
        for base in (0, 3):
            values = np.concatenate([np.cumsum(a[base]) for _, a in asks])
            distinct, at = np.unique(values, return_inverse=True)
            held_in = np.bincount(at, weights=np.concatenate([a[base + 1] for _, a in asks]), minlength=len(distinct)).astype(np.uint64)
            deleted = np.bincount(at, weights=np.concatenate([a[base + 2] for _, a in asks]), minlength=len(distinct)).astype(np.uint64)
            if base == 0:
                stat = np.array([held_in.sum(), deleted.sum(), (held_in > 0).sum(), (held_in + deleted > 0).sum()], dtype=np.uint64)
            answers.append((np.cumsum([0, *(len(a[base]) for _, a in asks)]), held_in[at], deleted[at]))
        for i, (block, a) in enumerate(asks):
            (e1, in1, del1), (e2, in2, del2) = answers
            one, two = slice(e1[i], e1[i + 1]), slice(e2[i], e2[i + 1])
            out.append((int(pdf.key.iloc[0]), block, 0, pack(a[0], narrow(in1[one]), narrow(del1[one]), narrow(in2[two]), narrow(del2[two]))))
        out.append((int(pdf.key.iloc[0]), f"stat{pdf.key.iloc[0]}", 2, pack(stat)))
    return pd.DataFrame(out, columns=["key", "block", "kind", "body"])


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's documents and all answers to it, as one blob; statistics pass through."""
    if (pdf.kind == 2).all():
        return pdf[["key", "block", "kind", "body"]]
    release()
    ((ids, role, lengths, rank, order),) = [unpack(b) for b in pdf.body[pdf.kind == 1]]
    answers = [unpack(b) for b in pdf[pdf.kind == 0].sort_values("key").body]
    words = np.concatenate([np.cumsum(a[0]) for a in answers])
    in1, del1, in2, del2 = (np.concatenate([a[i] for a in answers]).astype(np.uint64) for i in range(1, 5))
    lengths = lengths.astype(np.int64)
    first = np.zeros(int(lengths.sum()), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    _, pair_at = _bigram_index(words, order.astype(np.int64)[rank], first)
    held = np.repeat(role == 1, lengths)
    end = np.flatnonzero(order == np.searchsorted(words, END))
    body = pack(ids, role, narrow(lengths), rank, narrow(end), narrow(in1[order]), narrow((in1 + del1)[order]), narrow(in2[pair_at[held]]), narrow((in2 + del2)[pair_at]))
    return pd.DataFrame([(0, pdf.block.iloc[0], 1, body)], columns=["key", "block", "kind", "body"])


class Block:
    """The resolved counts of a block, by position: of the word, its context and both, held in and in all training rows."""

    def __init__(self, body: bytes):
        ids, self.role, lengths, self.rank, self.end, self.in1, self.all1, self.in2, self.all2 = unpack(body)
        self.ids = pa.ipc.open_stream(pa.py_buffer(ids.tobytes())).read_all().column("id").combine_chunks()
        self.lengths = lengths.astype(np.int64)
        self.start = np.cumsum(self.lengths) - self.lengths

    def chunks(self) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
        """Documents, positions, words and contexts of runs of documents that hold about CHUNK positions."""
        i = 0
        while i < len(self.lengths):
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + CHUNK)))
            low, high = int(self.start[i]), int(self.start[j - 1] + self.lengths[j - 1])
            word = self.rank[low:high].astype(np.int64)
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[self.start[i:j] - low] = self.end[0]
            yield slice(i, j), slice(low, high), word, context
            i = j


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _cells(pdfs: Iterator[pd.DataFrame], n_in: int) -> Iterator[pd.DataFrame]:
    """Held-out positions summed by (bucket, eighth of an octave of c2/c, eighth of an octave of c1), with mean probabilities."""
    for pdf in pdfs:
        for body in pdf.body:
            b, seen = Block(body), 0
            for docs, _, word, context in b.chunks():
                held = np.repeat(b.role[docs] == 1, b.lengths[docs])
                two = b.in2[seen : seen + int(held.sum())].astype(np.float64)
                seen += len(two)
                ctx, one = b.in1[context[held]].astype(np.float64), b.in1[word[held]].astype(np.float64)
                p2, p1 = np.where(ctx > 0, two / np.maximum(ctx, 1), 0.0), one / max(n_in, 1)
                grid = lambda p: np.where(p > 0, np.round(8 * np.log2(np.where(p > 0, p, 1))).astype(np.int64) + 1000, 0)
                cell, at = np.unique((bucket(ctx) * 2000 + grid(p2)) * 2000 + grid(p1), return_inverse=True)
                total = lambda w, at=at, n=len(cell): np.bincount(at, weights=w, minlength=n)
                yield pd.DataFrame({"cell": cell, "n": total(np.ones(len(at))), "p2": total(p2), "p1": total(p1)})


def learn_weights(cells: pd.DataFrame, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (l2, l1, l0) of each bucket by expectation-maximisation over held-out cells.

    A bucket without held-out positions keeps the weights of the nearest lower one that has some; contexts
    that were never seen (bucket 0) have no bigram probabilities, so l2 is 0 there.
    """
    weights = np.zeros((BUCKETS, 3))
    weights[0] = 0, 0.9, 0.1
    for b in range(BUCKETS):
        own = cells[cells.cell // 4_000_000 == b]
        if not len(own):
            if b:
                weights[b] = weights[b - 1] if b > 1 else (0.1, 0.8, 0.1)
            continue
        n = own.n.to_numpy()
        p = np.stack([own.p2.to_numpy() / n, own.p1.to_numpy() / n, np.full(len(own), 1 / (vocabulary + 1))], axis=1)
        w = np.array([0.0 if b == 0 else 0.3, 0.6, 0.1])
        w /= w.sum()
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) + np.array([0.0 if b == 0 else 1e-3, 1e-3, 1e-3])
            w /= w.sum()
        weights[b] = w
    return weights


def _score(pdfs: Iterator[pd.DataFrame], weights: np.ndarray, tokens: int, vocabulary: int) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for body in pdf.body:
            b = Block(body)
            for docs, places, word, context in b.chunks():
                ctx, own, two = b.all1[context].astype(np.float64), b.all1[word].astype(np.float64), b.all2[places].astype(np.float64)
                level = bucket(ctx)
                p = weights[level, 0] * np.where(ctx > 0, two / np.maximum(ctx, 1), 0.0) + weights[level, 1] * own / max(tokens, 1) + weights[level, 2] / (vocabulary + 1)
                starts = b.start[docs] - places.start
                base = np.log10((own + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                score, lengths = np.add.reduceat(np.log10(p), starts), b.lengths[docs]
                yield pd.DataFrame(
                    {
                        "doc_id": b.ids[docs].to_pandas(types_mapper=pd.ArrowDtype),
                        "held_out": b.role[docs] == 2,
                        "n_tokens": lengths,
                        "n_known": np.add.reduceat((own > 0).astype(np.int64), starts),
                        "train_tokens": np.full(len(starts), tokens),
                        "base_score": np.add.reduceat(base, starts),
                        "score": score,
                        "bits_per_token": -score / lengths / np.log10(2),
                    }
                )


def score_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_fold: int = 1, deleted_fold: int = 4) -> DataFrame:
    """Scores every whole text by a bigram model learned from the rows whose crc32(id as text) mod 5 is not `test_fold`.

    Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z in lower case; each text ends with one
    end token, which is also the context of its first word. Training rows of `deleted_fold` are the held-out
    part for the weights; the scores use the counts of all training rows.

    A null or empty text is the end token alone; a null id counts as the empty text in the fold; rows with
    equal ids are separate texts; very long texts are one block of their own; without training rows all
    counts are 0 and the model is uniform; an empty table gives an empty result. Other columns are not read.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_token.
    """
    spark = df.sparkSession
    keys = 8 * width(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    asked = steady(docs).mapInArrow(_ask(keys, id_type, test_fold, deleted_fold), SCHEMA_ASK)
    answered = asked.groupBy("key").applyInPandas(_sum_range, SCHEMA_ASK)
    resolved = cut(answered.groupBy("block").applyInPandas(_resolve, SCHEMA_ASK))
    stats = np.zeros(4)
    for row in resolved.where("kind = 2").select("body").collect():  # four numbers for each hash range
        stats += unpack(row.body)[0]
    n_in, n_all, v_in, v_all = int(stats[0]), int(stats[0] + stats[1]), int(stats[2]), int(stats[3])
    bodies = resolved.where("kind = 1").select("body")
    cells = bodies.mapInPandas(lambda it: _cells(it, n_in), "cell long, n double, p2 double, p1 double")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).toPandas()  # a fixed grid
    weights = learn_weights(cells.sort_values("cell"), v_in)
    if not n_all:
        weights[:] = 0, 0, 1
    return bodies.mapInPandas(lambda it: _score(it, weights, n_all, v_all), SCHEMA_SCORE.format(id=id_type))
