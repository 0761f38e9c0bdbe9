import collections
import random

import pytest

import corpus_pipeline
from docobjects.llm.mixing import mixed_sizes
from docobjects.llm.quality import score_quality

from . import brute


def prose(rng, k, syllables="th on er in an re nd ti es or".split()):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(k))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(rng, 30, "qua vel mor sti lan gro".split())) for i in range(5)]
    rows, labels, leaks = [], [], set()
    for i in range(500):
        text, good = prose(rng, rng.randint(8, 90)), i % 4 != 1
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 10 == 4:
            text = rng.choice(rows)[1]
        elif i % 10 == 6:
            w = prose(rng, 80).split()
            w[20:20] = rng.choice(items)[1].split()
            text = " ".join(w)
            leaks.add(i)
        rows.append((i, text, "en", f"src{rng.randrange(3)}", len(text)))
        labels.append((i, int(text.upper() != text), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, leaks


def test_stages(spark, folder, tmp_path):
    out, leaks = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs, kept = spark.read.parquet(f"{out}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, out)
        assert name == "sharding" or result.columns == docs.columns
        result.write.parquet(str(tmp_path / name))
        kept.append((name, docs, docs := spark.read.parquet(str(tmp_path / name))))
    stages = {name: (sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))) for name, a, b in kept}

    before, after = stages["quality"]
    good = {r.doc_id for r in score_quality(kept[0][1], spark.read.parquet(f"{out}/labels.parquet")).collect() if r.predicted}
    assert after == [r for r in before if r[0] in good] and 350 <= len(after) <= 400

    before, after = stages["near_duplicates"]
    components = {i: c for i, _, c in brute.jaccard([(r[0], r[1]) for r in before])}
    assert after == [r for r in before if components[r[0]] == r[0]] and len(after) < len(before)

    before, after = stages["decontamination"]
    left = {r[0] for r in before}
    copies = {r[0] for r in before if any(r[1] == t[1] for t in stages["quality"][0] if t[0] in leaks)}
    assert {r[0] for r in after} == left - leaks - copies and left & leaks

    before, after = stages["mixing"]
    times = collections.Counter(r[0] for r in after)
    taken = {r.doc_id: (r.taken, r.size) for r in mixed_sizes(kept[3][1]).collect()}
    assert all(times[i] * size == t for i, (t, size) in taken.items()) and set(after) <= set(before)

    before, after = stages["sharding"]
    assert len(after) == len(before) and {r[4] for r in after} <= set(range(24))
    load = collections.Counter()
    for r in after:
        load[r[4]] += r[1]
    assert max(load.values()) - min(load.values()) <= 2 * max(r[1] for r in after)


def test_run_is_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    again = corpus_pipeline.run(spark, folder[0]).collect()
    assert len(rows) > 300 and sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
