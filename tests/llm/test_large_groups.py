"""Near-dedup of groups whose texts are just short of similar: what leaves the tasks grows with the texts, and no link is lost."""

import random

import numpy as np

from lexiloom.llm import simhash


def sets_of(texts):
    return [np.unique(simhash.gram_hashes(t, 5)) for t in texts]


def test_a_group_short_of_similar_gives_no_table_of_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(220)], []
    for i in range(200):  # most pairs have a Jaccard of 0.7 to 0.8, some more
        own = base[:]
        for at in rng.sample(range(4, 216), 4 if i % 8 else 2):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    made, real = {}, simhash.written

    def counted(df, label):
        out = real(df, label)
        made[label] = made.get(label, []) + [out.count()]
        return out

    monkeypatch.setattr(simhash, "written", counted)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **simhash.SIMILAR).collect()}
    sets = sets_of(texts)
    close = [[len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for y in sets] for x in sets]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if close[i][j]) for i in range(len(texts))]
    wanted = {i for i in range(len(texts)) if root[i] == i}
    assert 1 < len(wanted) and kept == wanted
    # all pairs would be 19,900; each of the 30 tables may give less than a pair for each text
    assert max(made["links"]) < len(texts) and sum(made["candidates"]) < 15 * len(texts)


def test_shared_elements_by_bits_are_those_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 150, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(0, 150), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    wanted = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)]
    assert simhash.shared_counts(sets, a, b).tolist() == wanted
    assert simhash.shared_counts(sets, a[:3], b[:3]).tolist() == wanted[:3]
    monkeypatch.setattr(simhash, "CELLS", 30)
    assert simhash.shared_counts(sets, a, b).tolist() == wanted


def test_dealt_out_block_values_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for i in range(60):
        own = base[:]
        for at in rng.sample(range(4, 196), 4 if i % 3 else 2):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    find = lambda: {r.doc_id for r in simhash.one_of_each(docs, **simhash.SIMILAR).collect()}
    whole = find()
    for name, small in (("HELD_SETS", 5), ("SPLIT_SETS", 7), ("PAIRS", 50)):
        monkeypatch.setattr(simhash, name, small)
    assert find() == whole and 1 < len(whole) < 60
