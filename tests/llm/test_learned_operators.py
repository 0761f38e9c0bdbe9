import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from docobjects.llm.components import connected_components
from docobjects.llm.contamination import common_subsequence, contaminated, without_contaminated
from docobjects.llm.embeddings import near_duplicate_vectors
from docobjects.llm.quality import keep_good, score_quality
from docobjects.llm.toxicity import score_toxicity

from . import brute


def prose(rng, k, syllables="th on er in an re nd ti es or".split()):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(k))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    stems = ["blork", "zarg", "quim"]
    rows, labels = [], []
    for i in range(1600):
        words, toxic, good = prose(rng, rng.randint(5, 80)).split(), i % 4 == 0, i % 3 != 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(stems) + "".join(rng.choices("aeioust", k=3)))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, 7))
        labels.append((i, int(good), int(toxic)))
    rows += [(1600, "", 1), (1601, None, 1), (None, "text without id", 1), (5, "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels + [(None, 1, 1), (1650, None, None)], "doc_id long, quality int, toxic int")


def accuracy(rows, want):
    held = [r for r in rows if r.held_out and r.doc_id in want]
    return np.mean([r.predicted == want[r.doc_id] for r in held])


def test_toxicity_learns_subwords(labelled, spark):
    docs, labels = labelled
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == 1604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (brute.fold(r.doc_id) == 0) for r in rows)
    assert accuracy([r for r in rows if r.doc_id != 5], {i: int(i % 4 == 0) for i in range(1600)}) > 0.95
    assert score_toxicity(docs.limit(0), labels).collect() == []
    flat = score_toxicity(docs, labels.limit(0)).collect()
    assert len({r.score for r in flat}) == 1


def test_quality(labelled):
    docs, labels = labelled
    rows = score_quality(docs, labels).collect()
    assert len(rows) == 1604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert accuracy([r for r in rows if r.doc_id != 5], {i: int(i % 3 != 0) for i in range(1600)}) > 0.95
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)
    assert score_quality(docs.limit(0), labels).collect() == []


def test_contamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(14, 60), "qua vel mor sti lan gro pex dun".split())) for i in range(20)] + [(90, None), (91, "")]
    rows, planted = [], set()
    for d in range(300):
        words = prose(rng, rng.randint(0, 300)).split()
        if d % 10 == 0:
            k = rng.randrange(20)
            item = items[k][1].split()
            if d % 20 == 0:
                item = [w for j, w in enumerate(item) if j % 9 != 4]  # a paraphrase that drops words
            at = rng.randint(0, len(words))
            words[at:at] = item
            planted.add((d, k))
        rows.append((d, " ".join(words), 0))
    rows += [(400, None, 0), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coverage int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    # The same answer as a full comparison of every text with every item.
    full = {(d, i) for d, t, _ in rows for i, s in items if s and t and lcs(s.split(), t.split()) >= 0.85 * len(s.split())}
    assert full <= planted
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns and len(kept.collect()) == len(rows) - len({d for d, _ in planted})
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_contamination_paraphrased(spark):
    rng = random.Random(12)
    syllables = "qua vel mor sti lan gro pex dun".split()
    items = [(i, prose(rng, rng.randint(16, 50), syllables)) for i in range(12)]
    rare = (f"w{k}x" for k in itertools.count())
    rows, planted = [], set()
    for d in range(96):
        words, (k, item) = prose(rng, 150, syllables).split(), items[d % 12]
        item = item.split()
        if d % 4 == 0:  # a foreign word after each word
            item = [w for x in item for w in (x, next(rare))]
        elif d % 4 == 1:  # a fifth of the words replaced, foreign words between the others
            item = [w for j, x in enumerate(item) for w in (x if j % 5 != 2 else next(rare), *([next(rare)] if j % 2 else []))]
        elif d % 4 == 2:  # two fifths replaced, the answer stands
            item = [x if j % 5 not in (1, 3) or j >= len(item) - 6 else next(rare) for j, x in enumerate(item)]
        else:  # two halves apart
            item = item[: len(item) // 2] + [next(rare) for _ in item[::2]] + item[len(item) // 2 :]
        words[70:70] = item
        planted.add((d, k))
        rows.append((d, " ".join(words)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert planted <= {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}


def test_contamination_short_items(spark):
    rng = random.Random(13)
    syllables = "qua vel mor sti lan gro pex dun".split()
    items = [(n, " ".join(f"{w}{n}" for w in prose(rng, n, syllables).split())) for n in range(1, 16)]
    rows = [(n, " ".join([*prose(rng, 150, syllables).split(), item, *(f"w{n}x{k}" for k in range(150))])) for n, item in items]
    # The rarer words around the item outweigh it; short documents hold the item alone.
    rows += [(100 + n, " ".join([*(f"r{n}x{k}" for k in range(60)), item, *(f"s{n}x{k}" for k in range(60))])) for n, item in items]
    rows += [(200 + n, item) for n, item in items] + [(300, prose(rng, 400, syllables)), (301, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_common) for r in contaminated(docs, bench).collect()}
    assert found == {(d + n, n, n) for d in (0, 100, 200) for n, _ in items}
    assert {r.doc_id for r in without_contaminated(docs, bench).collect()} == {300, 301}


def test_contamination_repeated_words(spark):
    rng = random.Random(14)
    syllables = "qua vel mor sti lan gro pex dun".split()
    items = []
    for k in range(8):  # refrains and number sequences: 16 and more words, one to six distinct ones
        own = [f"n{k}{j}" for j in range(k % 6 + 1)]
        items.append((k, " ".join([*own, *(own[0] for _ in range(14)), *own])))
    rows, planted = [], set()
    for d in range(48):
        words, (k, item) = prose(rng, 120, syllables).split(), items[d % 8]
        copy = item.split()
        if d % 2:  # the distinct words but one replaced, the repeated one stands
            copy = [x if j == 0 or x == copy[0] else f"z{d}{j}" for j, x in enumerate(copy)]
        words[50:50] = copy
        if lcs(item.split(), copy) >= 0.75 * len(item.split()):
            planted.add((d, k))
        rows.append((d, " ".join(words)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(planted) > 24 and planted <= {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}


def test_contamination_candidates_come_from_the_cosine():
    """A closer cosine gives fewer candidates, none gives every passage with every item; copies are among the few."""
    from dataclasses import replace

    import pyarrow as pa

    from docobjects.llm import contamination as C
    from docobjects.llm.kernels import text_bytes

    rng = random.Random(15)
    syllables = "qua vel mor sti lan gro pex dun".split()
    items = [(i, prose(rng, 24, syllables)) for i in range(20)]
    texts = [prose(rng, 60, syllables) + " " + t + " " + prose(rng, 60, syllables) for _, t in items]
    bench, s = C.Benchmark.of(items), C.Settings()
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    tokens = C.stripped(data, offsets)
    term = bench.lookup(tokens.hash)
    idf = np.ones(s.counters, dtype=np.float32)
    # The exact singular vectors of the items' passages stand in for those of a corpus.
    rows = np.zeros((len(items), len(bench.vocabulary)))
    for k, x in enumerate(bench.items):
        rows[k, bench.lookup(x)] = 1
    space = np.linalg.svd(rows, full_matrices=False)[2].T.astype(np.float32)
    pairs = {}
    for cosine in (-2.0, 0.3, s.cosine):
        searcher = C.Searcher(bench, idf, space, replace(s, cosine=cosine))
        pairs[cosine] = {(int(tokens.doc[p]), int(k)) for place, item in searcher.candidates(tokens, term, searcher.passages[0]) for p, k in zip(place, item)}
    assert {(k, k) for k in range(20)} <= pairs[s.cosine] < pairs[0.3] < pairs[-2.0] == {(d, k) for d in range(20) for k in range(20)}
    off = C.Searcher(bench, idf, space, replace(s, cosine=2.0))
    assert off.hits(data, offsets) == [] and {(d, k) for d, k, *_ in C.Searcher(bench, idf, space, s).hits(data, offsets)} == {(k, k) for k in range(20)}


def plain_quality(texts, index, vectors, network, settings):
    """Scores text by text and word by word."""
    from docobjects.llm import kernels

    out = []
    for text in texts:
        import pyarrow as pa

        tokens = kernels.Tokens(*kernels.text_bytes(pa.array([text], pa.large_string())), lower=False)
        words = [int(h >> np.uint64(20)) % settings.words for h in tokens.hash]
        x = np.zeros(settings.features)
        if words:
            near = [sum((index[w].astype(float) for j, w in enumerate(words) if 0 < abs(i - j) <= settings.around), np.zeros(settings.dims)) for i in range(len(words))]
            fit = [float(near[i] @ vectors[w] / (np.linalg.norm(near[i]) + 1e-6)) for i, w in enumerate(words)]
            step = [0.0] + [float(vectors[a] @ vectors[b]) for a, b in itertools.pairwise(words)]
            mean = np.mean([vectors[w] for w in words], axis=0)
            x = np.array([*mean, np.linalg.norm(mean), np.log(len(words)), np.mean(fit), np.std(fit), np.mean(step), np.std(step)])
        out.append(float(network.score(x[None, :])[0]))
    return out


def test_quality_scores_equal_plain_ones(labelled):
    import pyarrow as pa

    from docobjects.llm import quality as Q

    docs, labels = labelled
    scorer = Q.learn(docs, labels, "doc_id", "text", "quality", 0, Q.Settings())
    texts = ["", None, "one", "Same Same Same", " ".join(prose(random.Random(1), 400).split()), "A b. C!! d\ne"]
    assert scorer(pa.array(texts, pa.large_string())) == pytest.approx(plain_quality(texts, scorer.index, scorer.vectors, scorer.network, Q.Settings()), abs=1e-4)


def test_quality_needs_its_word_vectors(labelled):
    docs, labels = labelled
    from docobjects.llm import quality as Q

    scorer = Q.learn(docs, labels, "doc_id", "text", "quality", 0, Q.Settings())
    want = {r.doc_id: r.quality for r in labels.where("quality is not null and doc_id is not null").collect()}
    rows = [r for r in docs.collect() if r.doc_id in want and r.doc_id != 5 and brute.fold(r.doc_id) == 0]
    import pyarrow as pa

    column = pa.array([r.text for r in rows], pa.large_string())
    y = np.array([want[r.doc_id] for r in rows])
    with_vectors = ((scorer(column) >= 0.3) == y).mean()
    scorer.vectors = np.zeros_like(scorer.vectors)
    assert with_vectors > 0.95 and ((scorer(column) >= 0.3) == y).mean() < 0.8


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert common_subsequence(np.array(a), np.array(b)) == lcs(a, b)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    root = brute.components(300, links)
    assert got == {i: root[i] for i in sorted({x for p in links if p[0] != p[1] for x in p})}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("edges, rounds", [(1000, False), (10, True)])
def test_components_in_one_task_take_no_rounds(spark, monkeypatch, edges, rounds):
    """Where a task has all edges it gives the components; where several share them, rounds give the same."""
    from docobjects.llm import components

    cuts = []
    monkeypatch.setattr(components, "EDGES", edges)
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: cuts.append(1) or cut(df))
    rng = random.Random(7)
    links = [(i + 1, i) for i in range(40)] + [(rng.randrange(60, 160), rng.randrange(60, 160)) for _ in range(60)] + [(200, 200 + i) for i in range(30)]
    rng.shuffle(links)
    got = sorted(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()))
    root = brute.components(300, links)
    assert got == [(i, root[i]) for i in sorted({x for p in links if p[0] != p[1] for x in p})]
    assert bool(cuts) == rounds


def test_embeddings(spark, monkeypatch):
    from docobjects.llm import embeddings

    monkeypatch.setattr(embeddings, "PART", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(scale=0.08, size=16) if i % 2 else rng.normal(size=16)
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 3) if i % 17 else None))
    rows += [(300 + i, rows[1][1], rows[1][2]) for i in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0, None] * 8, 1), (404, [], 1), (405, [1.0, 2.0], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    use = {i: np.float64(np.float32(v)) for i, v, k in rows if k is not None and i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(use), 2) if label[a] == label[b] and len(use[a]) == len(use[b]) and use[a] @ use[b] / np.linalg.norm(use[a]) / np.linalg.norm(use[b]) >= 0.98]
    root = brute.components(500, links)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert 0.98 * 2 * len(links) <= found <= 2 * len(links)
    for i, r in got.items():
        if i is not None:
            assert r.kept == (r.vec_id == r.component_id) and r.component_id >= (root[i] if i in use else i)
    assert near_duplicate_vectors(df.limit(0)).collect() == []


def test_embeddings_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    a, b = ([float(x) for x in np.float32(rng.normal(size=8))] for _ in range(2))
    near = [x * 3 for x in a[:-1]] + [a[-1] * 3.01]
    rows = [(1, a, 0, 1.0), (1, b, 0, 1.0), (2, a, 0, 1.0), (3, near, 0, None), (4, b, 1, 2.0), (5, b, None, 2.0), (2, a, 0, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key double").selectExpr("*", "label as uid", "key as id", "1 as slot")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect())
    # Id 1 holds two vectors: one is linked with the two copies under id 2 and with id 3, the other with nothing.
    assert got == [(1, 0, 1, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_sketches_keep_pairs_at_the_threshold():
    from docobjects.llm import embeddings as E

    rng = np.random.default_rng(3)
    for n in (100, 100_000, 10**9):
        bits, tables = E.plan_tables(n, 0.98)
        signs = max(bits * tables, E.LEAST_SIGNS)
        bound = E.sketch_bound(signs, 0.98)
        assert 0 < bound < signs / 4
        u = E._unit([x.tobytes() for x in rng.normal(size=(4000, 32))], np.float64)
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = 0.98 * u + math.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        planes = rng.normal(size=(32, signs))
        x, y = (E._signs([r.tobytes() for r in E.sketches(m, planes)], signs) for m in (u, v))
        assert ((x != y).sum(axis=1) <= bound).all()
        assert (E._words(x, bits, tables)[:, 0] == x[:, :bits] @ (1 << np.arange(bits))).all()
    assert E.sketch_bound(10, 1.0) == 0


def test_vectors_travel_only_to_partners(spark, monkeypatch):
    from docobjects.llm import embeddings as E

    rng = np.random.default_rng(4)
    lone = [(i, [float(x) for x in rng.normal(size=64)], 1) for i in range(2000)]
    twins = [(5000 + i, [x + 1e-4 for x in lone[i][1]], 1) for i in range(50)]
    seen = []
    cut = E.cut
    monkeypatch.setattr(E, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    got = near_duplicate_vectors(spark.createDataFrame(lone + twins, "vec_id long, embedding array<float>, label int"))
    assert sorted((r.vec_id, r.n_links) for r in got.where("n_links > 0").collect()) == sorted((i, 1) for j in range(50) for i in (j, 5000 + j))
    # A pair meets once, so each of its vectors is sent to one cell; chance partners by sketch are few.
    assert 100 <= next(x for x in seen if "cell" in x.columns).count() <= 120


def test_words_lose_all_marks_at_their_ends():
    from docobjects.llm import contamination as C
    from docobjects.llm.kernels import text_bytes

    marks = ".,;:!?\"'()[]{}|*#&%$"

    def plain(word):
        return word.strip(marks) or word[len(word) // 2]

    rng = random.Random(4)
    words = ["".join(rng.choice("ab" + marks * 2) for _ in range(rng.randint(1, 12))) for _ in range(800)] + ["." * 5000, "(" * 9 + "x", "y" + "!" * 9, "é" + "." * 7]
    for text in [words, ["....", "!?!?!"], ["plain"], []]:
        tokens = C.stripped(*text_bytes(pa.array([" ".join(text)], pa.large_string())))
        assert [bytes(tokens.data[i:j]).decode() for i, j in zip(tokens.start, tokens.end)] == [plain(w) for w in text]
