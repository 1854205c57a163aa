"""Cross-tokenizer alignment, source divergence and the multi-index: against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import alignment, divergence, multiindex, queries

A_FILE, B_FILE = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
BAG = [" ", "  ", "\n", "\t", "the", "Thorreou", "é", "ê", "'s", "'", " 12", "3", "!!", "▁", "<|endoftext|>", "<s>", "<0x41>", "日本語", "\U0001f600", " ", " ", "᠎", "\x85", "\x1c", "​", "\x00", "ʰ", "ⅷ", "²", "́", "a", "b", "ENC", "İ", "﻿", "कि"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())


def plain_groups(own, text):
    """n_a, n_b, n_groups, n_links, groups and link counts, from whole texts and byte offsets."""
    nothing = (0, 0, 0, 0, "", collections.Counter())
    if not text:
        return nothing
    sides = []
    for ids, names in ((own.a.model.encode(" " + text, add_special_tokens=False).ids, own.a.bytes), (own.b.model.encode(text), own.b.bytes)):
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return nothing
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(names[i])))
            at = spans[-1][2]
        sides.append(spans)
    groups, last = [], 0
    for cut in sorted({s[2] for s in sides[0]} & {s[2] for s in sides[1]}):
        groups.append("|".join(",".join(str(i) for i, x, _ in own_side if last <= x < cut) for own_side in sides))
        last = cut
    found = collections.Counter((i, j) for i, x, y in sides[0] for j, u, v in sides[1] if x < v and u < y)
    return len(sides[0]), len(sides[1]), len(groups), sum(found.values()), ";".join(groups), found


def own_groups(own, texts):
    numbers, groups, text, codes, times = own.texts(texts)
    pairs = [collections.Counter() for _ in texts]
    for t, c, n in zip(text.tolist(), codes.tolist(), times.tolist(), strict=True):
        pairs[t][c // own.size_b, c % own.size_b] = n
    return [(*numbers[i].tolist(), groups[i], pairs[i]) for i in range(len(texts))]


def test_alignment_of_pieces_equals_that_of_whole_texts(aligner, monkeypatch):
    rng = random.Random(2)
    for held in (alignment.HELD, 200, 0):
        monkeypatch.setattr(alignment, "HELD", held)
        for _ in range(200):
            texts = ["".join(rng.choice(BAG) for _ in range(rng.randint(0, 14))) for _ in range(3)]
            assert own_groups(aligner, texts) == [plain_groups(aligner, t) for t in texts], texts
    aligner.forget()


def test_alignment_of_a_very_long_text(aligner):
    words = [f"word{i % 977}" for i in range(8_000)]
    whole, part = own_groups(aligner, [" ".join(words), "x" * 50_000]), own_groups(aligner, words)
    assert whole[0][:5] == (*(sum(p[k] for p in part) for k in range(4)), ";".join(p[4] for p in part))
    total = collections.Counter()
    for p in part:
        total.update(p[5])
    assert whole[0][5] == total
    assert whole[1][3] == whole[1][0] + whole[1][1] - whole[1][2]
    aligner.forget()


def test_union_find():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = int(rng.integers(1, 40)), int(rng.integers(0, 50))
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        least = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                least[a] = least[b] = min(least[a], least[b])
        assert alignment.components(n, u, v).tolist() == least


def plain_alignment(own, texts):
    each = [plain_groups(own, t) for t in texts]
    total = sum((e[5] for e in each), collections.Counter())
    most = collections.defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(*e[:4], sum(n for p, n in e[5].items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in e[5].items()), hashlib.sha256(e[4].encode()).hexdigest() if e[4] else "") for e in each]


@pytest.mark.parametrize("most_pairs", [alignment.PAIRS, 0])
def test_alignment(spark, data, aligner, most_pairs):
    given = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").filter("n_chars < 700").orderBy("doc_id").limit(12).collect()]
    texts = [*given, None, "", " ", "the", "the", "▁", "\n", " ".join(f"word{i % 97}" for i in range(150)), "x" * 900, "日本語" * 50]
    rows = [(i if i % 7 else None, t, "old", "x") for i, t in enumerate(texts)] + [(2, texts[2], "old", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, row string")
    out = alignment.align(docs.repartition(3), A_FILE, B_FILE, keep_groups=True, most_pairs=most_pairs)
    assert out.columns == ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"]
    wanted = collections.Counter((r[0], *w) for r, w in zip(rows, plain_alignment(aligner, [r[1] for r in rows]), strict=True))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(r[c] for c in names) for r in out.collect()) == wanted
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in out.collect())
    assert alignment.align(docs.limit(0), A_FILE, B_FILE).count() == 0


def plain_audit(rows, least, k):
    docs = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        held = collections.Counter(w for d, ws in zip(docs, words, strict=True) if d[0] == lang for w in set(ws))
        terms = sorted(w for w, n in held.items() if n >= least)
        counts = {s: collections.Counter() for a, s, _ in docs if a == lang}
        for d, ws in zip(docs, words, strict=True):
            if d[0] == lang:
                counts[d[1]].update(w for w in ws if held[w] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(terms)) for t in terms}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in counts if o != s]
            best = [(f(p[s][t], q[t]), t) for t in terms if counts[s][t] and p[s][t] > q[t]]
            for part, own in (("pair", pairs), ("term", best)):
                own.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(own[: len(own) if part == "pair" else k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("tile", "rows_"), [(64, 100_000), (2, 7)])
def test_divergence(spark, monkeypatch, tile, rows_):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "ROWS", rows_)
    monkeypatch.setattr(divergence, "CHUNK", 5000)
    rng = random.Random(4)
    bag = [*("ABCdefgh"), "Éa", "éa", "_", "x1y", "naïve", "日本", "\U0001f600", "zz-yy", "\u0080", *(f"t{c}" for c in "abcdefghijklmnop")]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None]), " ".join(rng.choices(bag, weights=[30 // (i + 1) + 1 for i in range(len(bag))], k=rng.randint(0, 40)))) for _ in range(260)]
    rows += [("en", "s1", None), ("en", "", ""), ("xx", "a", "few words"), ("xx", "b", None), ("xx", "b", "!!"), ("yy", "alone", "a " * 4000)] + rows[:5] * 2 + [("yy", "alone", "a b")] * 11
    docs = spark.createDataFrame([(*r, "v", 1) for r in rows], "lang string, source string, text string, value string, rank int")
    out = divergence.audit(docs.repartition(5), k=4)
    assert sorted(map(tuple, out.collect())) == plain_audit(rows, 10, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [256, 0])
def test_radix_select(spark, few):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([0, 1, 5, 5, 300, 70_000, 70_001, 2**31 - 1]), w) for w in {"".join(rng.choices("aAéz日", k=rng.randint(1, 6))) for _ in range(900)}] + [("c", 3, "")]
    out = divergence.leaders(spark.createDataFrame(rows, "g string, v long, w string").repartition(4), ["g"], "v", "w", 40, few=few)
    wanted = []
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:40]
        wanted += [(*r, i) for i, r in enumerate(own, 1)]
    assert sorted(map(tuple, out.select("g", "v", "w", "rank").collect())) == sorted(wanted)


def plain_nearest(rows, asks, k):
    good = [(i, vid, np.array(v, dtype=float)) for i, (vid, v) in enumerate(rows) if vid is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dim = max(len(v) for _, _, v in good)
    good = [(i, vid, np.pad(v, (0, dim - len(v)))) for i, vid, v in good]
    return {i: sorted((float(np.sqrt(((v - o) ** 2).sum())), w) for j, w, o in good if j != i)[:k] for i, vid, v in good if vid % asks == 0}


def test_multiindex_walks_cells_in_order():
    rng = np.random.default_rng(3)
    codes = multiindex.Codes(rng.normal(size=(300, 7)), 8)
    x = rng.normal(size=(5, 7))
    near = codes.halves(x)
    for i in range(5):
        walk = list(codes.walk([near[0][i], near[1][i]]))
        assert len({c for c, _ in walk}) == 64 and [d for _, d in walk] == sorted(d for _, d in walk)


@pytest.mark.parametrize("small", [False, True])
def test_multiindex(spark, data, monkeypatch, small):
    if small:
        for name, value in (("CELL", 8), ("SHARD", 16), ("VISITS", 3), ("BLOCK", 50)):
            monkeypatch.setattr(multiindex, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) + 3 * (i % 4)]) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)] + [rows[20], rows[20], (None, [1.0] * 6), (7000, None), (7010, [1.0, None]), (7020, [float("nan")] * 6), (7030, [float("inf")]), (7040, [0.0] * 6), (7050, []), (7060, [1.0, 2.0]), (7070, [-0.0, 1.0])]
    given = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, label int, row int, score double")
    out = [tuple(r) for r in multiindex.nearest(given.repartition(3), F.col("vec_id") % 10 == 0, 5).collect()]
    wanted = plain_nearest(rows, 10, 5)
    assert collections.Counter(r[0] for r in out) == collections.Counter(rows[i][0] for i, own in wanted.items() for _ in own)
    exact = collections.Counter((rows[i][0], round(d, 9), v) for i, own in wanted.items() for d, v in own)
    found = collections.Counter((q, round(s, 9), v) for q, _, v, s in out)
    assert sum((exact & found).values()) >= 0.9 * sum(exact.values())
    hot = [r for r in out if r[0] == 20]
    assert len(hot) == 3 * 5 and all(s == 0 for *_, s in hot) and {v for _, _, v, _ in hot} <= {20, 1000, 1001, 1002}
    assert all(r[1] == 1 or any(o[0] == r[0] and o[1] == r[1] - 1 and (o[3], o[2]) <= (r[3], r[2]) for o in out) for r in out)
    assert multiindex.nearest(given.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0
    assert multiindex.nearest(given.filter("vec_id in (20, 21)"), F.col("vec_id") % 10 == 0, 5).filter("query_id = 20 and vec_id = 21").count() == 3


def test_multiindex_finds_nine_in_ten_of_given_vectors(spark, data):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    wanted = plain_nearest(rows, 100, 10)
    out = collections.defaultdict(set)
    for r in queries.op13_multiindex(spark, data).collect():
        out[r["query_id"]].add(r["vec_id"])
    hits = [len(out[rows[i][0]] & {v for _, v in own}) / len(own) for i, own in wanted.items()]
    assert hits and sum(hits) / len(hits) >= 0.9
