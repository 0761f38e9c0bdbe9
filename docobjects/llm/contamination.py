"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's words. A randomised SVD over all passages of the corpus (one
product A'AG with a random G, summed over partitions) spans the latent space. Passages of documents and of items whose cosine
in that space is high are candidates; nothing else is. Items of 12 words and more are cut into passages of 16 words, shorter
ones into shorter passages, and so are the documents for them. Around a candidate, an item is verified by its longest
common subsequence with the text and by a check of its answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Tokens, blocks, narrow, release, text_bytes

#: Bytes of text in a block: small ones stay in a processor's cache.
BLOCK = 1 << 19
#: Items that are searched for in one pass over the documents.
MOST_ITEMS = 20_000
#: Up to so many cells, a table says which item holds which word; beyond, a sorted list.
TABLE_CELLS = 1 << 24
#: Words around candidates that are looked at in one go.
PLACES = 1 << 21
#: Passages of documents that are compared with the items' at once.
PASSAGES = 512
#: Words that are counted together for a first bound of what a stretch has in common with each item.
CHUNK = 8
#: Up to so many sums (of words by items) that bound is worked out.
SUMS = 1 << 22


@dataclass(frozen=True)
class Settings:
    words: int = 16  # of a passage
    stride: int = 8  # between passages of a document
    item_stride: int = 8  # between passages of an item
    dims: int = 64  # of the latent space
    counters: int = 1 << 18  # for word frequencies
    share: float = 0.45  # least part of a passage's length (TF-IDF) in the benchmark's words: no item's full vector is closer
    cosine: float = 0.55  # least cosine in the latent space
    covered: float = 0.75  # of an item's words in the common subsequence
    covered_with_answer: float = 0.6  # the same, if the item's answer is there too
    answer_words: int = 6
    seed: int = 3


# ASCII punctuation that is stripped from both ends of a word.
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}|*#&%$"]] = True


def stripped(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens without punctuation at their ends; of a word of marks alone the middle one stays."""
    tokens = Tokens(data, offsets)
    start, end = tokens.start.copy(), tokens.end.copy()
    for _ in range(3):
        start += _EDGE[tokens.data[np.minimum(start, len(data) - 1)]] & (end - start > 1) if len(start) else 0
        end -= _EDGE[tokens.data[end - 1]] & (end - start > 1) if len(end) else 0
    # Few words have more marks than that: where the marks end is told for all bytes at once.
    more = np.flatnonzero((end - start > 1) & (_EDGE[tokens.data[start]] | _EDGE[tokens.data[end - 1]])) if len(start) else np.zeros(0, np.int64)
    if len(more):
        inside = np.flatnonzero(~_EDGE[tokens.data])
        a, b = np.searchsorted(inside, start[more]), np.searchsorted(inside, end[more])
        some, middle = b > a, (start[more] + end[more]) // 2
        begin = np.where(some, inside[np.minimum(a, max(len(inside) - 1, 0))], middle) if len(inside) else middle
        stop = np.where(some, inside[np.maximum(b, 1) - 1] + 1, middle + 1) if len(inside) else middle + 1
        start[more], end[more] = begin, stop
    tokens.start, tokens.end = start, end
    return tokens


@dataclass
class Benchmark:
    """Items as word hashes, the vocabulary (sorted hashes), and where an item's answer stands."""

    ids: list
    items: list[np.ndarray]
    vocabulary: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Benchmark:
        column = pa.array([t for _, t in rows], pa.large_string())
        tokens = stripped(*text_bytes(column))
        items = [tokens.hash[i:j] for i, j in zip(tokens.first[:-1], tokens.first[1:], strict=True)]
        keep = [k for k, x in enumerate(items) if len(x)]
        vocabulary = np.unique(tokens.hash)
        # Words by the first 20 bits of their hash: where their slot begins in the sorted vocabulary.
        slots = np.append(np.searchsorted(vocabulary, np.arange(1 << 20, dtype=np.uint64) << U64(44)), len(vocabulary)).astype(np.int32)
        return cls([rows[k][0] for k in keep], [items[k] for k in keep], vocabulary, slots)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Index in the vocabulary, -1 for other words."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.vocabulary):
            return out
        slot = (hashes >> U64(44)).astype(np.int64)
        begin = self.slots[slot].astype(np.int64)
        size = self.slots[slot + 1] - begin
        left = np.flatnonzero(size > 0)
        step = 0
        while len(left):
            at = begin[left] + step
            hit = self.vocabulary[at] == hashes[left]
            out[left[hit]] = at[hit]
            step += 1
            left = left[~hit & (size[left] > step)]
        return out


def _counter(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    return (hashes >> U64(8) & U64(settings.counters - 1)).astype(np.int64)


def word_weights(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, float]:
    """Inverse frequencies of the word counters over all texts, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.counters, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                total += np.bincount(_counter(stripped(*text_bytes(block.column(0))).hash, settings), minlength=settings.counters)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["counter", "n"])

    rows = docs.mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # a fixed number of counters
    counts = np.zeros(settings.counters)
    counts[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    passages = max(counts.sum() / settings.words, 1.0)
    return np.log1p(passages / np.maximum(counts, 0.5)).astype(np.float32), passages


def _random_planes(n: int, settings: Settings) -> np.ndarray:
    return np.random.default_rng(settings.seed).normal(size=(n, settings.dims)).astype(np.float32)


def latent_space(docs: DataFrame, bench: Benchmark, idf: np.ndarray, settings: Settings) -> np.ndarray:
    """Right singular vectors (vocabulary x dims) of the TF-IDF matrix of all passages, by a randomised one-pass method.

    Partitions sum their parts of A'AG; the sums are rounded to a fixed grid, so their order does not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bench, idf))
    n, names = len(bench.vocabulary), [f"s{j}" for j in range(settings.dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, idf = shared.value
        own = idf[_counter(bench.vocabulary, settings)][:, None]
        planes = _random_planes(n, settings) * own
        total = np.zeros((n, settings.dims))
        for batch in batches:
            for block in blocks(batch, "text", BLOCK // 4):
                tokens = stripped(*text_bytes(block.column(0)))
                if not len(tokens.hash):
                    continue
                inside = np.arange(len(tokens.hash)) - tokens.first[:-1][tokens.doc]
                begins = np.flatnonzero(inside % settings.words == 0)
                passage = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(inside))))
                weight = idf[_counter(tokens.hash, settings)]
                length = np.sqrt(np.add.reduceat(weight * weight, begins))
                term = bench.lookup(tokens.hash)
                at = np.flatnonzero(term >= 0)
                if not len(at):
                    continue
                term, passage = term[at], passage[at]
                # A row of A is its words' weights over the passage's length: both scale rows, before and after the sums.
                starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                product = np.zeros((len(begins), settings.dims), dtype=np.float32)
                product[passage[starts]] = np.add.reduceat(planes[term], starts, axis=0) / (length[passage[starts]] ** 2)[:, None]
                order = np.argsort(narrow(term), kind="stable")
                term, passage = term[order], passage[order]
                starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                total[term[starts]] += np.add.reduceat(product[passage], starts, axis=0)
        total *= own
        seen = np.flatnonzero(np.abs(total).sum(axis=1))
        grid = np.round(total[seen] * (1 << 20)).astype(np.int64)
        yield pa.record_batch([pa.array(seen.astype(np.int32))] + [pa.array(grid[:, j]) for j in range(settings.dims)], names=["term", *names])

    sums = docs.mapInArrow(run, "term int, " + ", ".join(f"{c} long" for c in names))
    table = sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # one row per benchmark word
    product = np.zeros((n, settings.dims))
    product[table["term"].to_numpy()] = np.stack([table[c].to_numpy() for c in names], axis=1) / (1 << 20)
    planes = _random_planes(n, settings).astype(np.float64)
    core = planes.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    use = values > max(values.max(), 0) * 1e-10 if len(values) else np.zeros(0, bool)
    if not use.any():
        return np.zeros((n, 1), dtype=np.float32)
    half = product @ (vectors[:, use] / np.sqrt(values[use]))
    return np.linalg.svd(half, full_matrices=False)[0].astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Passages:
    """The passages of all items of about one length: the item of each, and unit vectors in the latent space."""

    words: int
    stride: int
    owner: np.ndarray
    vectors: np.ndarray


class Searcher:
    """Finds a block's contaminated documents."""

    def __init__(self, bench: Benchmark, idf: np.ndarray, space: np.ndarray, settings: Settings):
        self.bench, self.idf, self.space, self.settings = bench, idf, space, settings
        own = idf[_counter(bench.vocabulary, settings)]
        n = len(bench.vocabulary)
        # The last row is the zero vector, of any other word.
        self.scaled = np.zeros((n + 1, space.shape[1]), dtype=np.float32)
        self.scaled[:n] = space * own[:, None]
        self.size = np.array([len(x) for x in bench.items], dtype=np.int64)
        self.least = np.array([math.ceil(min(settings.covered, settings.covered_with_answer) * k) for k in self.size.tolist()], dtype=np.int64)
        self.item_words, self.times = np.unique(np.concatenate([k * n + bench.lookup(x) for k, x in enumerate(bench.items)]), return_counts=True)
        self.table = self.holds = None
        if n * len(bench.items) <= TABLE_CELLS:
            self.table = np.zeros(n * len(bench.items), dtype=np.int32)
            self.table[self.item_words] = self.times
            # A word that a stretch around a passage (of three times the item's length) is likely to hold more often than the
            # item does is counted as often as the item holds it, wherever; only the others are looked for.
            item, word = np.divmod(self.item_words, n)
            often = 3 * self.size[item] > self.times * settings.words * np.expm1(idf[_counter(bench.vocabulary[word], settings)].astype(np.float64))
            self.holds = np.zeros((n + 1, len(bench.items)), dtype=np.uint8)
            self.holds[word[~often], item[~often]] = 1
            self.least_others = self.least - np.bincount(item[often], weights=self.times[often], minlength=len(bench.items)).astype(np.int64)
        self.passages, words = [], settings.words
        above = np.iinfo(np.int64).max
        while words:
            # Items of at least three quarters of a passage belong to it; the rest to passages half as long.
            below = -(-3 * words // 4) if words > 1 else 1
            own = np.flatnonzero((self.size >= below) & (self.size < above))
            if len(own):
                self.passages.append(self._of_items(own, words))
            words, above = words // 2, below

    def _of_items(self, items: np.ndarray, words: int) -> Passages:
        s = self.settings
        item_stride = max(s.item_stride * words // s.words, 1)
        vectors, owner = [], []
        for k in items.tolist():
            x = self.bench.items[k]
            last = max(len(x) - words, 0)
            for i in sorted({*range(0, last + 1, item_stride), last}):
                term = np.unique(self.bench.lookup(x[i : i + words]))
                vectors.append(self.scaled[term].sum(axis=0))
                owner.append(k)
        unit = self._unit(np.array(vectors, dtype=np.float32).reshape(len(vectors), self.space.shape[1]))
        return Passages(words, max(s.stride * words // s.words, 1), np.array(owner), unit)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)

    @staticmethod
    def _cut(tokens: Tokens, words: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end words of all passages of the block's documents; the last passage of a document ends with it."""
        count = tokens.count
        last = np.maximum(count - words, 0)
        n = np.where(count > 0, -(-last // stride) + 1, 0)
        doc = np.repeat(np.arange(len(count)), n)
        k = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
        start = np.minimum(k * stride, last[doc]) + tokens.first[:-1][doc]
        return start, np.minimum(start + words, tokens.first[1:][doc])

    def candidates(self, tokens: Tokens, term: np.ndarray, own: Passages) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words of passages, items) whose cosine in the latent space is high, some passages at a time."""
        s, n = self.settings, len(self.bench.vocabulary)
        words = np.where(term >= 0, term, n).astype(np.min_scalar_type(n))
        start, end = self._cut(tokens, own.words, own.stride)
        weight = self.idf[_counter(tokens.hash, s)].astype(np.float64) ** 2
        whole = np.concatenate([[0], np.cumsum(weight)])
        inside = np.concatenate([[0], np.cumsum(np.where(term >= 0, weight, 0))])
        near = np.flatnonzero((inside[end] - inside[start] >= s.share**2 * (whole[end] - whole[start])) & (inside[end] > inside[start]))
        for low in range(0, len(near), PASSAGES):
            part = near[low : low + PASSAGES]
            at = start[part, None] + np.arange(own.words)
            held = words[np.minimum(at, len(words) - 1)]
            held[at >= end[part, None]] = n
            held.sort(axis=1)
            held[:, 1:][held[:, 1:] == held[:, :-1]] = n  # a word that repeats counts once
            close = self._unit(self.scaled[held].sum(axis=1)) @ own.vectors.T >= s.cosine
            i, k = np.divmod(np.flatnonzero(close), len(own.vectors))
            item = own.owner[k]
            new = np.ones(len(i), dtype=bool)  # an item's passages lie side by side
            new[1:] = (i[1:] != i[:-1]) | (item[1:] != item[:-1])
            yield start[part[i[new]]], item[new]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """(document, item, common words, answer found) for every verified pair."""
        tokens = stripped(data, offsets)
        if not len(tokens.hash) or not self.passages:
            return []
        term = self.bench.lookup(tokens.hash)
        pairs: dict[tuple[int, int], set[int]] = {}
        for own in self.passages:
            for place, item in self.candidates(tokens, term, own):
                for k in self._possible(tokens, term, place, item, own.words).tolist():
                    pairs.setdefault((int(tokens.doc[place[k]]), int(item[k])), set()).add(int(place[k]))
        out = []
        for (doc, item), places in sorted(pairs.items()):
            best = self._verify(tokens, doc, self.bench.items[item], sorted(places))
            if best:
                out.append((doc, item, *best))
        return out

    def _region(self, tokens: Tokens, place: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Around a passage, a stretch as long as the item on both sides, within the document."""
        doc = tokens.doc[place]
        return np.maximum(place - n, tokens.first[doc]), np.minimum(place + np.maximum(n, words) + n, tokens.first[doc + 1])

    def _possible(self, tokens: Tokens, term: np.ndarray, place: np.ndarray, item: np.ndarray, words: int) -> np.ndarray:
        """Candidates around which enough words of the item stand at all, as often as in the item: no more can be common."""
        near = self._bounded(tokens, term, place, item, words)
        kept = self._counted(tokens, term, place[near], item[near], words)
        return near[kept]

    def _bounded(self, tokens: Tokens, term: np.ndarray, place: np.ndarray, item: np.ndarray, words: int) -> np.ndarray:
        """Candidates around which, rounded up to whole chunks, enough words of the item can stand; all, where the sums would be many."""
        every = np.arange(len(place))
        if self.holds is None or not len(place):
            return every
        low, high = self._region(tokens, place, self.size[item], words)
        first = int(low.min()) // CHUNK
        low, high = low // CHUNK - first, -(-high // CHUNK) - first
        chunks, items = int(high.max()), self.holds.shape[1]
        if chunks * items > SUMS:
            return every
        own = np.full(chunks * CHUNK, len(self.bench.vocabulary))
        span = term[first * CHUNK : (first + chunks) * CHUNK]
        own[: len(span)][span >= 0] = span[span >= 0]
        held = np.zeros((chunks, items), dtype=np.uint8)
        for j in range(CHUNK):
            held += self.holds[own[j::CHUNK]]
        upto = np.zeros((chunks + 1, items), dtype=np.int32)
        np.cumsum(held, axis=0, out=upto[1:])
        return np.flatnonzero(upto[high, item] - upto[low, item] >= self.least_others[item])

    def _counted(self, tokens: Tokens, term: np.ndarray, place: np.ndarray, item: np.ndarray, words: int) -> np.ndarray:
        """Candidates around which enough words of the item stand, counted one by one."""
        low, high = self._region(tokens, place, self.size[item], words)
        known = term >= 0
        before = np.concatenate([[0], np.cumsum(known)])
        words_known = term[known].astype(np.int32 if self.table is not None else np.int64)
        low, high = before[low], before[high]
        open_ = np.flatnonzero(high - low >= self.least[item])
        low, size = low[open_], (high - low)[open_]
        code = (item[open_] * len(self.bench.vocabulary)).astype(words_known.dtype)
        upto, out, a = np.cumsum(size), [], 0
        while a < len(open_):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PLACES, side="right")))
            own = size[a:b]
            first = np.cumsum(own) - own
            at = np.repeat((low[a:b] - first).astype(np.int32), own) + np.arange(int(own.sum()), dtype=np.int32)
            times = self._times(words_known[at] + np.repeat(code[a:b], own))
            least = self.least[item[open_[a:b]]]
            enough = np.add.reduceat(times > 0, first, dtype=np.int32) >= least
            # Of these, no word counts more often than it stands in the item.
            flat = np.flatnonzero(np.repeat(enough, own) & (times > 0))
            owner = np.repeat(np.arange(b - a), own)[flat]
            _, where, count = np.unique(owner * len(self.bench.vocabulary) + words_known[at[flat]], return_index=True, return_counts=True)
            held = np.bincount(owner[where], weights=np.minimum(count, times[flat[where]]), minlength=b - a)
            out.append(open_[a:b][enough & (held >= least)])
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _times(self, codes: np.ndarray) -> np.ndarray:
        """How often a word stands in an item, by item x words + word."""
        if self.table is not None:
            return self.table[codes]
        at = np.minimum(np.searchsorted(self.item_words, codes), len(self.item_words) - 1)
        return np.where(self.item_words[at] == codes, self.times[at], 0)

    def _verify(self, tokens: Tokens, doc: int, words: np.ndarray, places: list[int]) -> tuple[int, bool] | None:
        s, first, last = self.settings, int(tokens.first[doc]), int(tokens.first[doc + 1])
        n, best = len(words), None
        least = min(s.covered, s.covered_with_answer) * n
        distinct, times = np.unique(words, return_counts=True)
        for i in range(0, len(places), 64):
            # Around a place, a stretch as long as the item on both sides.
            at = np.array(places[i : i + 64])
            low, high = np.maximum(at - n, first), np.minimum(at + max(n, s.words) + n, last)
            span = tokens.hash[low[0] : high[-1]]
            word = np.minimum(np.searchsorted(distinct, span), len(distinct) - 1)
            hit = np.flatnonzero(distinct[word] == span)
            # How often each word of the item stands in each stretch; no more of it than that can be common.
            inside = (hit >= (low - low[0])[:, None]) & (hit < (high - low[0])[:, None])
            held = inside.astype(np.float32) @ (word[hit][:, None] == np.arange(len(distinct))).astype(np.float32)
            for j in np.flatnonzero(np.minimum(held, times).sum(axis=1) >= least).tolist():
                region = tokens.hash[low[j] : high[j]]
                common = common_subsequence(words, region)
                if common < least:
                    continue
                tail = words[-min(s.answer_words, n) :]
                answer = common_subsequence(tail, region) >= 0.8 * len(tail)
                if common >= s.covered * n or answer and common >= s.covered_with_answer * n:
                    best = max(best or (0, False), (common, answer))
                    if best == (n, True):
                        return best
        return best


def _searchers(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, settings: Settings) -> Iterator[tuple[Benchmark, Searcher]]:
    """A searcher for each part of the benchmark of about MOST_ITEMS items."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    parts = max(1, -(-items.count() // MOST_ITEMS))
    texts = docs.select("text")
    idf, _ = word_weights(texts, settings)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about MOST_ITEMS
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        bench = Benchmark.of([(r.item_id, r.text) for r in rows])
        if bench.items:
            searcher = Searcher(bench, idf, latent_space(texts, bench, idf, settings), settings)
            release()
            yield bench, searcher


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item that stands in it, verbatim or paraphrased.

    doc_id, item_id, n_common (words of the longest common subsequence), item_words, coverage, answer (the item's last words
    are there too). A pair is reported if the subsequence covers `covered` of the item, or `covered_with_answer` and
    the answer. Every document is searched over its whole text.

    Null or empty texts and items give no rows; items or rows with equal ids are reported apart; an item with fewer
    words than a passage is looked for in shorter ones, down to a single word; very long texts are searched whole, as blocks of
    their own; empty tables give an empty result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    ddl = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, n_common long, item_words long, coverage double, answer boolean"
    out = None
    for _, searcher in _searchers(source, benchmark, item_col, item_text_col, settings):
        shared = docs.sparkSession.sparkContext.broadcast(searcher)
        arrow_id = _arrow_type(benchmark, item_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, arrow_id=arrow_id) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch, "text", BLOCK):
                    found = shared.value.hits(*text_bytes(block.column(1)))
                    if found:
                        bench = shared.value.bench
                        words = [len(bench.items[i]) for _, i, _, _ in found]
                        yield pa.record_batch(
                            [block.column(0).take(pa.array([d for d, *_ in found])), pa.array([bench.ids[i] for _, i, _, _ in found], arrow_id), pa.array([c for _, _, c, _ in found], pa.int64()), pa.array(words, pa.int64()), pa.array([c / w for (_, _, c, _), w in zip(found, words, strict=True)]), pa.array([a for *_, a in found])],
                            names=["doc_id", "item_id", "n_common", "item_words", "coverage", "answer"],
                        )

        rows = source.mapInArrow(run, ddl)
        out = rows if out is None else out.unionByName(rows)
    return docs.sparkSession.createDataFrame([], ddl) if out is None else out


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item stands.

    Null and empty texts stay; rows that repeat an id are decided apart, each by its text; an empty benchmark keeps all; columns
    of any name pass through.
    """
    out = docs
    for _, searcher in _searchers(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text_col, settings):
        shared = docs.sparkSession.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch, text_col, BLOCK):
                    column = block.column(block.schema.get_field_index(text_col))
                    clean = np.ones(block.num_rows, dtype=bool)
                    clean[[d for d, *_ in shared.value.hits(*text_bytes(column))]] = False
                    yield block.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
