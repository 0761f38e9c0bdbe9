"""Two tokenizers over the same texts: where their tokens end together, and which tokens stand for one another."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from .kernels import blocks, release

#: Where the vocabulary files of the two tokenizers lie, on every machine.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that are encoded at once, and characters after which a text is cut at the next safe place.
BLOCK, STRETCH = 1 << 20, 1 << 16
#: Most id pairs that every task holds; rarer ones are joined by a shuffle.
COMMON_PAIRS = 1 << 18
#: A single space between other characters: both tokenizers begin a token there.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how a byte-level tokenizer splits text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that merging by ranks takes long for, as its time grows with their square.
LONG_RUN = re.compile(r"\S{512}|\s{512}")


def byte_level_alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the others in order from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers, and the bytes and decimal ids of their tokens.

    Where the ids of a byte-level vocabulary are the ranks of its merges, the same merges are done by rank, which takes a fifth of the
    time; texts with long runs without a split are left to the tokenizer itself.
    """

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet, self.a_bytes = byte_level_alphabet(), [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        if b"" in self.a_bytes or b"" in self.b_bytes:
            raise ValueError("a token without bytes")
        if any(b" " in x.lstrip(b" ") for x in self.b_bytes):
            raise ValueError("a piece that goes on after a space")
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        # Decimal ids with what follows them inside of a group, and at the end of its tokens.
        text = lambda n, last: np.array([[f"{i}{c}" for i in range(n)] for c in (",", last)], object)
        self.a_text, self.b_text = text(len(self.a_bytes), "|"), text(len(self.b_bytes), ";")
        told = json.loads(self.a.to_str())
        vocabulary, merges, first = told["model"]["vocab"], told["model"]["merges"], told["pre_tokenizer"]
        ranked = all(vocabulary["".join(m)] == 256 + k for k, m in enumerate(merges)) and told["normalizer"] is None and first == first | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i < 256 + len(merges)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of both for texts without the space before them."""
        b = self.b.encode(texts, num_threads=1)
        if self.ranked is None:
            return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], b
        whole = lambda t: self.a.encode(" " + t, add_special_tokens=False).ids
        return [whole(t) if LONG_RUN.search(t) else self.ranked.encode_ordinary(" " + t) for t in texts], b


@lru_cache(maxsize=1)
def tokenizer_pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def stretches(text: str, most: int = STRETCH) -> list[str]:
    """text cut at safe spaces, which are left out, into parts of `most` characters and what follows up to such a space."""
    out, at = [], 0
    while len(text) - at > most and (hit := SAFE.search(text, at + most)):
        out.append(text[at : hit.start()])
        at = hit.end()
    return [*out, text[at:]]


def merged(pair: Pair, text: str, a: list[int], b: list[int]) -> tuple[str, np.ndarray] | None:
    """The groups of a text (and the space before it), written down, and the pairs that end its groups; None if the tokens do not spell it.

    The ends of both token lists increase, so a stable sort of the two, one after the other, is one merge, in which ends that both
    have stand side by side. Each token's place in the written groups follows from how many of the other's stand before it.
    """
    spelled = f" {text}".encode()
    if b"".join([pair.a_bytes[i] for i in a]) != spelled or b"".join([pair.b_bytes[i] for i in b]) != spelled:
        return None
    x, y = np.array(a), np.array(b)
    ends = np.concatenate([np.cumsum(pair.a_size[x]), np.cumsum(pair.b_size[y])])
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    shared = np.flatnonzero(ends[1:] == ends[:-1])
    i, j = order[shared], order[shared + 1] - len(x)
    a_last, b_last = np.zeros(len(x), int), np.zeros(len(y), int)
    a_last[i], b_last[j] = 1, 1
    written = np.empty(len(x) + len(y), object)
    written[np.arange(len(x)) + np.concatenate([[0], j + 1])[np.cumsum(a_last) - a_last]] = pair.a_text[a_last, x]
    written[np.arange(len(y)) + (i + 1)[np.cumsum(b_last) - b_last]] = pair.b_text[b_last, y]
    return "".join(written.tolist())[:-1], x[i] * len(pair.b_bytes) + y[j]


def _aligned(byte_path: str, piece_path: str):
    def one(pair: Pair, parts: list[str]) -> tuple:
        digest, n_a, n_b, ids = hashlib.sha256(), 0, 0, []
        for k, (text, a, b) in enumerate(zip(parts, *pair.encode(parts), strict=True)):
            found = merged(pair, text, a, b)
            if found is None:
                n_a, n_b, ids = 0, 0, []
                break
            digest.update(((";" if k else "") + found[0]).encode())
            n_a, n_b = n_a + len(a), n_b + len(b)
            ids.append(found[1])
        found, times = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]), return_counts=True)
        return n_a, n_b, int(times.sum()), digest.hexdigest() if len(times) else "", found, times.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(byte_path, piece_path)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                columns = list(zip(*(one(pair, stretches(t) if t else []) for t in block.column(1).to_pylist()), strict=True))
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32), np.concatenate(c)) for c in columns[4:]]
                yield pa.record_batch([block.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
        release()

    return run


def align_tokenizers(docs: DataFrame, byte_path: str = f"{FOLDER}/{BYTE_BPE}", piece_path: str = f"{FOLDER}/{PIECE_BPE}", id_col: str = "doc_id", text_col: str = "text", common_pairs: int = COMMON_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): how the tokens of a byte-level and a piece tokenizer lie over the texts of docs.

    A text is encoded with a space before it. Where a token of both ends, a group ends; the tokens that end there are linked, and
    since no token is without bytes that is one link a group. At a single space between other characters both tokenizers begin
    a token, so texts longer than STRETCH are encoded part by part and memory does not grow with them. Every document's distinct linked id pairs
    are written down with how often it holds them; their sums over all documents are joined back to them. At most `common_pairs`
    pairs, the most frequent, are held by every task, as nearly all links have them; links of rarer pairs go through a shuffle.

    Null and empty texts, and texts that either tokenizer's tokens do not spell, have no tokens. Rows that repeat an id, and null
    ids, are documents of their own. Empty tables give empty results. Other columns are not read.

    documents, one row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its
    second id), count_sum (sum over links of the corpus-wide counts of their pairs), groups_sha256. pairs: a_id, b_id, count, best.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = cut(source.mapInArrow(_aligned(byte_path, piece_path), ddl)).withColumn("row", F.monotonically_increasing_id())
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    n_pieces = tokenizer_pair(byte_path, piece_path).b.get_piece_size()
    counted = links.groupBy("pair").agg(F.sum("times").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.pmod("pair", F.lit(n_pieces))))  # a vocabulary's ids at most
    counts = cut(counted.select("pair", "count", (F.col("count") == highest).alias("best")))
    # How many pairs are how frequent, in steps of an eighth of a power of two.
    step = F.floor(8 * F.log2("count"))
    steps = sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step)
    total, least = 0, None
    for r in steps:
        if total + r["count"] > common_pairs:
            break
        total, least = total + r["count"], r.step
    common = counts.where(step >= least) if least is not None else counts.limit(0)
    flagged = links.join(F.broadcast(common), "pair", "left")
    sums = flagged.where("count is not null").select("row", "times", "count", "best")
    if total < sum(r["count"] for r in steps):
        rare = flagged.where("count is null").select("row", "pair", "times").join(counts.where(step < least) if least is not None else counts, "pair")
        sums = sums.unionByName(rare.select("row", "times", "count", "best"))
    sums = sums.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    documents = rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
    ids = [F.expr(f"cast(pair div {n_pieces} as int)").alias("a_id"), F.pmod("pair", F.lit(n_pieces)).cast("int").alias("b_id")]
    return documents, counts.select(*ids, "count", "best")
