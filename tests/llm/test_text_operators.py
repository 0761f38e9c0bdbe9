import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docobjects.llm import kernels, substrings
from docobjects.llm.components import connected_components
from docobjects.llm.jaccard import count_overlaps, jaccard_components, one_of_each_group
from docobjects.llm.licenses import scan_licenses
from docobjects.llm.lm import learn_weights, score_corpus
from docobjects.llm.mixing import capped_targets, cheapest_flow, mixed_sizes, repeat_documents
from docobjects.llm.sharding import shard_by_bytes
from docobjects.llm.substrings import remove_repeats, suffix_sort

from . import brute

DOCS = "doc_id long, text string, source string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 7))).strip() or "x" for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    shared = prose(40)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not rows:
            text = prose(rng.randint(0, 120))
        elif kind == 1:
            text = rng.choice(rows)[1]
        elif kind == 2:
            w = (rng.choice(rows)[1] or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = prose(rng.randint(1, 30)) + " " + shared + "\n" + prose(rng.randint(1, 200))
        elif kind == 4:
            text = (shared + "\t") * rng.randint(1, 3)
        else:
            text = rng.choice(["", None, "one Two", " \n ", prose(3), "É" * 150, "ab" * 200, prose(3000)])
        rows.append((i, text, rng.choice(["a", "b", "c", None])))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def empty(spark):
    return spark.createDataFrame([], DOCS)


def odd(spark):
    """Null ids and texts, repeated rows, and extra columns with clashing names."""
    rows = [(None, "same words here and there again", "x", 1, 2), (None, None, None, 1, 2), (3, "same words here and there again", "x", 3, 4), (3, "same words here and there again", "x", 3, 4), (3, "other", None, 5, 6)]
    return spark.createDataFrame(rows, DOCS + ", size int, component_id int")


def test_words_and_shingles_match_plain_python():
    rows = corpus(2)
    texts = [t for _, t, _ in rows]
    import pyarrow as pa

    tokens = kernels.Tokens(*kernels.text_bytes(pa.array(texts, pa.large_string())))
    assert [[tokens.word(int(i)).decode() for i in range(a, b)] for a, b in zip(tokens.first[:-1], tokens.first[1:])] == [brute.words(t) for t in texts]
    doc, value = kernels.shingles(tokens)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(brute.shingle_set(t)) for t in texts]
    assert len(set(value.tolist())) == len(set().union(*[brute.shingle_set(t) for t in texts]))


def test_pack_round_trip():
    arrays = [np.arange(1000, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int64), np.array([3, 2], np.uint8), np.array([0.5])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, kernels.unpack(kernels.pack(*arrays))))


def test_suffix_sort_matches_sorted_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 700)
    segment = np.sort(rng.integers(0, 5, 700))
    order, equal = suffix_sort(data, start, segment, 12)
    piece = lambda i: (segment[i], data[start[i] : start[i] + 12].tobytes(), i)
    assert order.tolist() == sorted(range(700), key=piece)
    assert equal.tolist() == [k > 0 and piece(order[k])[:2] == piece(order[k - 1])[:2] for k in range(700)]


def test_remove_repeats(docs, spark):
    rows, df = docs
    assert collected(remove_repeats(df)) == brute.repeats([(i, t) for i, t, _ in rows])
    assert remove_repeats(empty(spark)).collect() == []
    assert len(remove_repeats(odd(spark)).collect()) == 5


def test_equal_hashes_of_different_contexts_are_told_apart():
    """Contexts with one hash for all: only those whose bytes agree count as repeats."""
    data = np.frombuffer(b"abcdefgh" * 2 + b"abcdefgX" + b"abcdefgh" + b"abcdefgX", np.uint8)
    low = np.arange(0, 40, 8)
    gram, context = np.full(5, 7, np.uint64), np.full(5, 9, np.uint64)
    order, first, told = substrings.repeats_in_block(data, gram, context, low, low + 3, 5)
    assert {tuple(sorted(np.flatnonzero(told == c).tolist())) for c in np.unique(told)} == {(0, 1, 3), (2,), (4,)}
    assert sorted(order[first].tolist()) == [0, 2, 4]
    assert substrings.same_bytes(data, np.array([0, 0]), np.array([8, 16]), np.array([8, 8])).tolist() == [True, False]


def test_remove_repeats_in_texts_longer_than_a_slice(spark):
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    filler = lambda k: "".join(rng.choices("abcdefghijklmnop ", k=k))
    rows = [(1, filler(substrings.SLICE + 1000) + passage + filler(50) + passage, None), (2, passage + filler(300), None), (3, passage[:99], None)]
    assert collected(remove_repeats(spark.createDataFrame(rows, DOCS))) == brute.repeats([(i, t) for i, t, _ in rows])


def test_remove_repeats_with_hot_anchors(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=150))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=130)) + passage + "".join(rng.choices("abcdefgh ", k=130)), None) for i in range(substrings.HOT + 40)]
    assert collected(remove_repeats(spark.createDataFrame(rows, DOCS))) == brute.repeats([(i, t) for i, t, _ in rows])


def test_jaccard(docs, spark):
    rows, df = docs
    assert collected(jaccard_components(df)) == brute.jaccard([(i, t) for i, t, _ in rows])
    assert jaccard_components(empty(spark)).collect() == []
    got = sorted(jaccard_components(odd(spark)).collect(), key=str)
    assert len(got) == 5 and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 0, None), (None, 2, 3), (3, 2, 3), (3, 1, 3)}
    kept = one_of_each_group(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.jaccard([(i, t) for i, t, _ in rows])}) and kept.columns == df.columns


def near_copies(n, seed=9):
    rng = random.Random(seed)
    source = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(source)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w), None))
    return rows


@pytest.mark.parametrize("pairs", [0.5, 1e9])
def test_jaccard_by_stars_and_by_pairs(spark, monkeypatch, pairs):
    """All links come from partial overlaps that are summed per pair, whether stars or all pairs are verified."""
    from docobjects.llm import jaccard

    found = []

    def counted(pairs, parts):
        out = count_overlaps(pairs, parts)
        found.extend((r.na, r.nb, r.common) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(jaccard, "count_overlaps", counted)
    rows = near_copies(50)
    got = collected(jaccard_components(spark.createDataFrame(rows, DOCS)))
    assert got == brute.jaccard([(i, t) for i, t, _ in rows])
    linked = [x for x in found if 100 * x[2] >= 80 * (x[0] + x[1] - x[2])]
    sets = len({brute.shingle_set(t) for _, t, _ in rows})
    assert len(linked) >= sets - len({c for *_, c in got}) and (pairs > 1 or len(found) < 50 * 49 / 4)


def drifting_copies(n, seed=11):
    """Each copy is the one before with a word changed: neighbours link, far ones do not."""
    rng = random.Random(seed)
    w, rows = [f"w{rng.randrange(500)}" for _ in range(60)], []
    for i in range(n):
        w[rng.randrange(60)] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(w), None))
    return rows


def close_copies(n, seed=12):
    """A group of n / 8 texts with a word or two of 240 changed, all of which link, among pairs of copies."""
    rng = random.Random(seed)
    source, texts = [f"w{rng.randrange(500)}" for _ in range(240)], []
    for i in range(n // 8):
        w = list(source)
        for k in rng.sample(range(240), 1 + i % 2):
            w[k] = f"x{i}"
        texts.append(w)
    while len(texts) < n:
        w = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts += [w, [*w[:30], "y", *w[31:]]]
    return [(i, " ".join(w), None) for i, w in enumerate(texts[:n])]


@pytest.mark.parametrize("copies, n, most", [(close_copies, 240, 1.5), (drifting_copies, 160, 8)])
def test_jaccard_verifies_few_pairs_of_a_large_group(spark, monkeypatch, copies, n, most):
    from docobjects.llm import jaccard

    found, edges = [], []

    def counted(pairs, parts):
        found.append(pairs.count())
        return count_overlaps(pairs, parts)

    def components(links, *ends):
        edges.append(links.count())
        return connected_components(links, *ends)

    monkeypatch.setattr(jaccard, "count_overlaps", counted)
    monkeypatch.setattr(jaccard, "connected_components", components)
    rows = copies(n)
    assert collected(jaccard_components(spark.createDataFrame(rows, DOCS))) == brute.jaccard([(i, t) for i, t, _ in rows])
    assert sum(found) < most * n and max(edges) < most * n


def test_one_of_each_group_starts_few_jobs(spark):
    """Each job leaves plans, threads and compiled code in the driver, so their number is its memory."""
    rows = near_copies(50)
    spark.sparkContext.setJobGroup("few_jobs", "")
    try:
        kept = one_of_each_group(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.doc_id for r in kept) == sorted({c for *_, c in brute.jaccard([(i, t) for i, t, _ in rows])})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few_jobs")
    assert 10 < len(jobs) < 130


def test_overlaps_are_summed_over_fragments(spark):
    rng = random.Random(4)
    sets = [set(rng.sample(range(80), rng.randint(1, 40))) for _ in range(9)]
    parts = spark.createDataFrame([(c, f, [x for x in sorted(s) if x // 20 == f]) for c, s in enumerate(sets) for f in range(4)], "c long, f int, part array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4, 9)], "a long, b long")
    want = {(a, b): len(sets[a] & sets[b]) for a in range(4) for b in range(4, 9)}
    assert {(r.a, r.b): r.common for r in count_overlaps(pairs, parts).collect()} == want


def test_one_of_each_group_with_repeated_ids(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "ONE two three four five six")
    rows = [(1, a, 0), (3, a, 1), (3, b, 2), (5, a, 3), (5, b, 4), (6, None, 5), (6, None, 6), (None, "alone here and there now", 7), (None, "alone here and there now", 8), (None, a, 9), (1, c, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_id` int").withColumnRenamed("_id", "a.b").withColumn("_mark", F.lit(1)).withColumn("component_id", F.lit("x"))
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (3, b), (6, ""), (6, ""), (None, "alone here and there now")], key=str)
    assert sorted(map(str, one_of_each_group(df.repartition(5)).collect())) == sorted(map(str, kept.collect()))
    assert one_of_each_group(df.limit(0)).collect() == []


def test_language_model(docs, spark):
    rows, df = docs
    want = brute.base_scores([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r for r in score_corpus(df).collect()}
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in score_corpus(df.repartition(5)).collect()}
    assert all(again[i] == pytest.approx(r.score, rel=1e-6) for i, r in got.items())
    assert score_corpus(empty(spark)).collect() == []
    assert len(score_corpus(odd(spark)).collect()) == 5


def test_weights_follow_the_better_model():
    import pandas as pd

    cells = pd.DataFrame({"cell": [3 * 4_000_000 + 5, 3 * 4_000_000 + 6], "n": [90.0, 10.0], "p2": [45.0, 0.0], "p1": [0.9, 0.1]})
    w = learn_weights(cells, 1000)
    assert w[3].sum() == pytest.approx(1) and w[3][0] > 0.8 and w[0][0] == 0


def test_sharding(docs, spark):
    rows, df = docs
    got = sorted(shard_by_bytes(df, n_shards=7).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.size, r.text_crc32) for r in got] == [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows]
    total, before = sum(r.size for r in got), 0
    for r in got:
        assert r.shard == min((2 * before + r.size) * 7 // (2 * total), 6) and r.law == "bytes" and r.grown_shard is None
        before += r.size
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shard_by_bytes(empty(spark)).collect() == []
    ties = [r.slot for r in shard_by_bytes(odd(spark), n_shards=1).collect()]
    assert sorted(ties) == [0, 1, 2, 3, 4]


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(mixed_sizes(df).collect())
    assert got == sorted(mixed_sizes(df.repartition(7)).collect())
    assert [(r.doc_id, r.size) for r in got] == [(i, len(t.split())) for i, t, _ in rows]
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ["a", "b", "c", "d", None]}
    targets = capped_targets(sizes, dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1])), 1.5, 2)
    for s in sizes:
        own = [r for r, x in zip(got, rows) if x[2] == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(float(targets[s]))
        assert abs(sum(r.taken for r in own) - own[0].target) <= 30
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = {r.doc_id: r.taken for r in got}
    mixed = repeat_documents(df).groupBy("doc_id").count().collect()
    assert all(taken[r.doc_id] == r["count"] * len(rows[r.doc_id][1].split()) for r in mixed)
    assert mixed_sizes(empty(spark)).collect() == [] and len(mixed_sizes(odd(spark)).collect()) == 5


def test_mixing_repeated_rows_come_near_the_target(spark):
    rows = [(1, "a b c d e", "x")] * 200 + [(2, "f g", "y"), (3, "h i j", "y")] + [(None, "k l", None)] * 50
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixed_sizes(df)
    assert collected(got.select("doc_id", "taken").where("doc_id is not null")) == collected(mixed_sizes(df.repartition(3)).select("doc_id", "taken").where("doc_id is not null"))
    sums = {r.doc_id: r for r in got.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max("target").alias("target"), F.max("taken").alias("most")).collect()}
    assert abs(sums[1].taken - sums[1].target) <= 5 and sums[1].most <= 10
    assert abs(sums[None].taken - sums[None].target) <= 2
    mixed = repeat_documents(df.withColumns({c: F.lit(7) for c in ("col", "_p", "_mix", "_turn", "times", "a.b")}))
    assert mixed.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "col", "_p", "_mix", "_turn", "times", "a.b"]
    assert mixed.where("doc_id = 1").count() * 5 == sums[1].taken


def test_mixing_in_parts(spark, monkeypatch):
    from docobjects.llm import mixing

    monkeypatch.setattr(mixing, "MOST_PATTERNS", 4)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(5, 30)), sorted(rng.sample("abcde", rng.randint(1, 3)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    mix = mixing.mix_sources(df)
    assert {tuple(r.p) for r in mix.plan.collect()} == {tuple(x) for _, _, x in rows} and mix.plan.count() > 8
    taken = mix.apply(df, "m").selectExpr("m.times as n", "text").collect()
    assert len(taken) == 500 and not mix.small and sum(r.n * len(r.text.split()) for r in taken) > 0.8 * min(sum(mix.targets.values()), 2 * sum(len(t.split()) for _, t, _ in rows))


def test_flow_in_parts_costs_what_it_costs_at_once(spark):
    from docobjects.llm.flow import flow_in_parts

    rng = random.Random(21)
    chain = {(chr(97 + k), chr(98 + k)): 50 for k in range(6)} | {("a",): 400, ("g",): 1}
    tables = [(chain, [100, 50, 50, 50, 50, 50, 300])]
    for n, most in ((60, 3), (40, 4)):
        names = "abcdefgh"
        table = {tuple(sorted(rng.sample(names, rng.randint(1, most)))): rng.choice([0, 1, 3, 40, 500]) for _ in range(n)}
        tables.append((table | {(None,): 7}, [rng.choice([0, 5, 300, 2000]) for _ in range(8)] + [30]))
    for table, quota in tables:
        order = sorted({s for p in table for s in p}, key=lambda s: (s is None, s or ""))
        quota = quota[: len(order)]
        members = [[order.index(s) for s in p] for p in table]
        df = spark.createDataFrame([(list(p), w) for p, w in table.items()], "pattern array<string>, words long")
        for uses in (1, 2):
            whole = cheapest_flow(list(table.values()), members, quota, list(range(uses)))
            got = {tuple(r.p): r.sent for r in flow_in_parts(df.repartition(3), order, quota, uses, 5).collect()}
            assert got.keys() == table.keys() and all(0 <= got[p] <= uses * w for p, w in table.items())
            again = sum(max(0, sum(f.values()) - w) for f, w in zip(whole, table.values()))
            assert sum(got.values()) == sum(sum(f.values()) for f in whole)
            assert sum(max(0, got[p] - w) for p, w in table.items()) == again


def plain_flow(capacity, members, quota, costs):
    """Most words at least cost, by trying how many words each use of each pattern sends: a linear programme over tiny figures."""
    import itertools

    best = None
    shares = [list(itertools.product(range(c * len(costs) + 1), repeat=len(m))) for c, m in zip(capacity, members)]
    for choice in itertools.product(*shares):
        if any(sum(x) > c * len(costs) for x, c in zip(choice, capacity)):
            continue
        got = [0] * len(quota)
        for x, m in zip(choice, members):
            for words, s in zip(x, m):
                got[s] += words
        if any(g > q for g, q in zip(got, quota)):
            continue
        cost = sum(costs[k] * max(0, min(sum(x) - k * c, c)) for x, c in zip(choice, capacity) for k in range(len(costs)))
        best = min(best or (0, 0), (-sum(got), cost))
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(8)
    for _ in range(25):
        n = rng.randint(1, 3)
        capacity = [rng.randint(0, 3) for _ in range(n)]
        members = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in range(n)]
        quota = [rng.randint(0, 7) for _ in range(2)]
        flow = cheapest_flow(capacity, members, quota, [0, 1])
        sums = [sum(f.values()) for f in flow]
        assert all(0 <= x <= 2 * c for x, c in zip(sums, capacity)) and all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quota))
        assert (-sum(sums), sum(max(0, x - c) for x, c in zip(sums, capacity))) == plain_flow(capacity, members, quota, [0, 1])


def test_mixing_overlapping_sources(spark):
    flow = cheapest_flow([100, 50, 30], [[0], [0, 1], [1]], [120, 60], [0, 1])
    assert sum(f.get(0, 0) for f in flow) == 120 and sum(f.get(1, 0) for f in flow) == 60
    assert all(sum(f.values()) <= 2 * c for f, c in zip(flow, [100, 50, 30]))
    rows = [(i, "a b c", ["x", "y"] if i % 3 else ["x"]) for i in range(30)] + [(99, "a", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    assert len(mixed_sizes(df).collect()) == 31


def test_licenses(spark):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text", None),
        (2, "All rights reserved. Released under the MIT License!", None),
        (3, "This program is free software; all is well", None),
        (4, "no licence named here", None),
        (5, None, None),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nnonsense", None),
        (7, "RELEASED UNDER THE  MIT LICENSE\nReleased under the MIT License.", None),
    ]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: (r.n_known, r.licenses, r.verdict, r.unmatched) for i, r in got.items()} == {
        1: (1, "Apache-2.0", "single", 0),
        2: (2, "MIT,Proprietary", "multiple", 0),
        3: (1, "", "unknown", 1),
        4: (0, "", "none", 0),
        5: (0, "", "none", 0),
        6: (1, "", "unknown", 1),
        7: (2, "MIT", "single", 0),
    }
    assert scan_licenses(empty(spark)).collect() == [] and len(scan_licenses(odd(spark)).collect()) == 5
    plan = scan_licenses(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_licenses_any_gaps(spark):
    texts = ["All  rights reserved.", "Released into the public-domain.", "This program is free\tsoftware", "This program is free\u00a0software", "ALL-RIGHTS\t RESERVED!", "all rights, reserved"]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)).collect()}
    assert [(got[i].n_known, got[i].verdict) for i in range(6)] == [(1, "single"), (1, "single"), (1, "unknown"), (1, "unknown"), (1, "single"), (1, "single")]


def licence_texts():
    """Public licence texts, as they are wrapped in files."""
    mit = """The MIT License (MIT)

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
    names = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    return {mit: "MIT", gpl: "GPL-3.0-or-later", bsd: "BSD-2-Clause", bsd + names: "BSD-3-Clause", "x\nSPDX-License-Identifier: MIT\ny": "MIT", "title: nothing": ""}


def test_licenses_of_wrapped_texts(spark):
    texts = licence_texts()
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got[i].licenses for i in range(len(texts))] == list(texts.values()) and got[0].unmatched == 0 and got[1].unmatched == 0


def test_licenses_agree_with_sql(spark, tmp_path):
    """Known sentences between other words, in any case, spacing, punctuation and wrapping."""
    import duckdb

    from docobjects.llm.licenses import SENTENCES
    from docobjects.llm.oracles import OP6

    rng = random.Random(12)
    known = [s for variants in SENTENCES.values() for s in variants]
    rows = [(i, t, None) for i, t in enumerate([*licence_texts(), "", None, "\x01", ": : a:\n:b", "\r\n\r", "....x ... y", "all rights reserved\nall rights reserved"])]
    for i in range(len(rows), 400):
        text = ""
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(known).split(" ") if rng.random() < 0.7 else rng.choices(["other", "É", "a1", "the", "software"], k=rng.randint(1, 5))
            gap = rng.choice([[" "], [" ", "\n"], [" ", "  ", "\t", "\r\n"], ["-", ", ", " \n * "]])
            text += "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(gap) for w in words).rstrip("-, *") + rng.choice([". ", "\n", "\n\n", "; ", ": ", ":\n", " ", "!", "...\n", "\r\n#\r\n"])
        rows.append((i, text, None))
    df = spark.createDataFrame(rows, DOCS)
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.sql(OP6)
    got = scan_licenses(df).select(*want.columns)
    assert collected(got) == sorted(want.fetchall()) and got.where("n_known > 0").count() > 150
