import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from docobjects.llm import alignment, topk
from docobjects.llm.alignment import align_tokenizers, stretches, tokenizer_pair
from docobjects.llm.filters import audit_filters, failure_masks, survivors
from docobjects.llm.topk import nearest_vectors

from .brute import WORD

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def filter_corpus():
    rng = random.Random(5)
    prose = lambda k: " ".join(rng.choices(["alpha", "beta", "Gamma", "DELTA", "#tag", "ε", "one", "two", "three", "four"] + [f"w{i}" for i in range(150)], k=k))
    long = prose(40_000)  # some 200 kB
    texts = ["", None, " \t\n", "x", long, long, prose(300), prose(250), "same " * 300, "SHOUT " * 40, "a#b", "é" * 50, " ".join("abc"), "word word"]
    rows = [(i, t, rng.choice(["s1", "s2", "", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), rng.choice(["s1", "s1", "s2", "s3"])) for i in range(60)]
    rows += [(3, "x", "s1"), (3, "other words", "s2"), (None, "x", "s1"), (None, None, None), (50, "SHOUT " * 40, "s1"), (50, "SHOUT " * 40, "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows if rng.random() < 0.7] + [(None, 1, 1), (3, 1, 0), (3, 0, 1), (9999, 1, 1)]
    return rows, labels


def plain_audit(rows, labels, names="ABCDE"):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = collections.defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }
        parts[s or ""].append((fails, i in good, i in toxic))
    out, share = [], collections.Counter()
    for part, docs in parts.items():
        for order in itertools.permutations(names):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                rest = [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in docs)
                only = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                share[part, f] += len(gone)
                out.append((part, "".join(order), step, len(rest), len(gone), failing - len(gone), only, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
                left = rest
    return sorted((*r[:-1], share[r[0], r[-1]]) for r in out)


def test_filter_audit_equals_every_order_applied(spark):
    rows, labels = filter_corpus()
    docs = spark.createDataFrame([(*r, 1, "z", b"k") for r in rows], DOCS + ", n int, part string, key binary").repartition(3)
    known = spark.createDataFrame([(*r, 7, "m") for r in labels], LABELS + ", n int, mask string")
    got = audit_filters(docs, known)
    assert got.dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")] and {t for _, t in got.dtypes[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_filter_audit_of_empty_tables_and_without_labels(spark):
    rows, _ = filter_corpus()
    none = spark.createDataFrame([], LABELS)
    assert audit_filters(spark.createDataFrame([], DOCS), none).count() == 0
    assert sorted(map(tuple, audit_filters(spark.createDataFrame(rows, DOCS), none).collect())) == plain_audit(rows, [])


def test_zeta_transform_counts_subsets(spark):
    masks = [(m, m + 1, m % 2, m % 3) for m in range(8) if m != 5]
    cells = survivors(spark.createDataFrame([("p", *m) for m in masks], "part string, mask int, n long, good long, toxic long"), 3).first().cells
    for s in range(8):
        want = tuple(sum(m[k] for m in masks if not m[0] & s) for k in (1, 2, 3))
        assert tuple(cells[7 - s]) == want


def test_filter_masks_of_own_filters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "a", "s")], DOCS)
    masks = failure_masks(docs, spark.createDataFrame([], LABELS), {"X": F.length("text") > 1})
    assert sorted((r.mask, r.n) for r in masks.collect() if r.n) == [(0, 1), (1, 1), (2, 1)]
    with pytest.raises(ValueError):
        audit_filters(docs, docs, {"E": F.lit(True)})


def token_texts():
    rng = random.Random(9)
    words = ["the", "of", "naïve", "Übermut", "don't", "tokenisation", "1234", "3.14", "日本語", "Ελλάδα", "😀", "x", "II", "https://a.b/c?d=e", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "\t", "\n\n", "  ", "   x", "٠١٢"]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    texts = [prose(rng.randint(1, 60)) for _ in range(60)]
    texts += ["", None, " ", "  ", "\n", " leading", "trailing ", "▁ low line", "a▁b", "\x00 nul", "é combining", " hard space", "﻿mark", "tab\tand\r\nlines\n\n\n end"]
    texts += ["plain words and more of them " * 4000, prose(30_000), "x" * 300_000, "ab " * 3 + "é" * 70_000 + " c d"]
    return [(i, t) for i, t in enumerate(texts)] + [(0, "the of"), (None, "the of x"), (0, "the of")]


def plain_alignment(rows):
    pair = tokenizer_pair(f"{alignment.FOLDER}/{alignment.BYTE_BPE}", f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    told, count = [], collections.Counter()
    for i, text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        if not text or any(b"".join(t[x] for x in ids) != (" " + text).encode() for t, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
            told.append((i, [], [], []))
            continue
        groups, p, q, x, y = [], 0, 0, 0, 0
        ga, gb = [], []
        while p < len(a) or q < len(b):  # the one that is behind takes its next token
            if x <= y and p < len(a):
                x += len(pair.a_bytes[a[p]])
                ga.append(a[p])
                p += 1
            else:
                y += len(pair.b_bytes[b[q]])
                gb.append(b[q])
                q += 1
            if x == y:
                groups.append((ga, gb))
                ga, gb = [], []
        told.append((i, a, b, groups))
        count.update((g[0][-1], g[1][-1]) for g in groups)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, a, b, groups in told:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), {(a, b, n, n == best[b]) for (a, b), n in count.items()}


@pytest.mark.parametrize("common", [1 << 18, 40, 0])
def test_alignment_equals_whole_text_merge(spark, common):
    rows = token_texts()
    docs = spark.createDataFrame([(*r, 1, [2]) for r in rows], "doc_id long, text string, row int, pairs array<int>").repartition(4)
    documents, pairs = align_tokenizers(docs, common_pairs=common)
    want, counts = plain_alignment(rows)
    assert sorted(map(tuple, documents.collect()), key=str) == want
    assert {tuple(r) for r in pairs.collect()} == counts
    assert sum(r[1] == 0 for r in want) == 4  # "", null and the two texts with a low line, which stands for a space


def test_alignment_of_an_empty_table(spark):
    documents, pairs = align_tokenizers(spark.createDataFrame([], "doc_id long, text string"))
    assert documents.count() == 0 and pairs.count() == 0


def test_alphabet_spells_every_byte_once():
    assert sorted(alignment.byte_level_alphabet().values()) == list(range(256))


def test_stretches_are_cut_at_single_spaces():
    text = "one two 3  four\n five six"
    assert stretches(text, 3) == ["one", "two", "3  four\n five", "six"]
    assert " ".join(stretches(text, 5)) == text
    assert stretches("", 3) == [""]


def test_merging_by_ranks_equals_the_tokenizer():
    pair = tokenizer_pair(f"{alignment.FOLDER}/{alignment.BYTE_BPE}", f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    texts = [t for _, t in token_texts() if t]
    assert pair.ranked is not None
    assert pair.encode(texts)[0] == [pair.a.encode(" " + t, add_special_tokens=False).ids for t in texts]


def plain_topk(rows, every=50, k=5):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for i, v in usable:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3 * 50][1]) for i in range(150)]  # many copies of queries: ties at the highest scores
    rows += [(2000, None), (2050, [None] + [1.0] * 7), (2100, [math.nan] * 8), (2150, [math.inf] * 8), (None, [1.0] * 8), (2200, [0.0] * 8), (2250, [1.0, 2.0]), (2300, []), (-50, [-1.0] * 8), (7, rows[7][1]), (50, rows[50][1])]
    return rows


@pytest.mark.parametrize("block", [topk.QUERY_BYTES, 200])
def test_topk_equals_full_sort(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, row int, score double").repartition(5)
    got = nearest_vectors(df, query_bytes=block)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_topk(rows)


def test_topk_of_large_numbers_and_few_rows(spark):
    rows = [(0, [2.0**40, 1.0]), (50, [3.0**20, -(2.0**30)]), (100, [2.0**-9, 1.5]), (3, [1e-300, 2.0**35])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(a, b, c, max(min(s, topk.LIMIT), -topk.LIMIT)) for a, b, c, s in plain_topk(rows)]
    assert sorted(map(tuple, nearest_vectors(df).collect())) == want
    assert len(want) == 9
    assert nearest_vectors(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert nearest_vectors(one).count() == 0  # 256 * 1e308 is not finite


def test_topk_by_one_value_that_all_rows_share(spark):
    df = spark.range(2000).selectExpr("id as vec_id", "array(0.5f, 0.25f) as embedding").repartition(8)
    got = sorted(map(tuple, nearest_vectors(df, every=500).collect()))
    score = 128 * 128 + 64 * 64
    assert got == [(q, r, j, score) for q in (0, 500, 1000, 1500) for r, j in enumerate([x for x in range(6) if x != q][:5], 1)]


