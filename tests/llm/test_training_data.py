"""The ten operators and the pipeline: against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import decontamination, graph, licences, linechunks, mixing, mtree, passages, quality, queries, sharding, simhash, urls
from lexiloom.llm.shared import DOCUMENT_COLUMNS

ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, fingerprint string, size string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
NEAR = " ".join(f"alpha{i}" for i in range(300))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows and columns with clashing names."""
    texts = [None, "", " \t\n", "one", LONG, LONG, NEAR, NEAR + " omega", "a\nb\nc\nd\ne\nf\ng\nh", "a\nb\nc\nd\ne\nf\ng\nh", "é" * 300, "All rights reserved. \U0001f600"]
    rows = [(i, t, "en", ["s", None, "t"][i % 3], None, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, NEAR, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, "another text of row three", None, "s", 1, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def spread(df):
    return df.repartition(3)


def test_sharding(spark, data, odd, none):
    out = sharding.shard(spread(odd), 3).toPandas()
    assert len(out) == odd.count() and set(out["law"]) == {"bytes"}
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert out.groupby(out["text"].fillna("\0"))["shard"].nunique().max() == 1
    assert (out["size"] == [8 + len((t or "").encode()) for t in out["text"]]).all()
    assert all(c == zlib.crc32(t.encode()) for c, t in zip(out["text_crc32"], out["text"]) if t is not None)
    assert sharding.shard(none, 3).count() == 0
    sums = queries.op1_sharding(spark, data).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(sums) == 24 and sums.max() < 1.5 * sums.mean()


def test_packing():
    rng = random.Random(3)
    for _ in range(30):
        sizes, n = [rng.randint(1, 60) for _ in range(rng.randint(60, 200))], rng.randint(1, 9)
        sums = [0] * n
        for s, b in zip(sizes, sharding.pack(sizes, n), strict=True):
            sums[b] += s
        assert max(sums) - min(sums) <= max(2, 0.03 * sum(sizes) / n)
    assert sharding.pack([100, 1, 1, 1, 1], 3).count(0) == 1
    tree, held = sharding.CapacityTree(), []
    for i in range(300):
        tree.add(room := rng.randint(0, 50), i)
        held.append((room, i))
        want = rng.randint(0, 60)
        fits = [x for x in held if x[0] >= want]
        found = tree.take_tightest(want)
        assert found == (min(fits) if fits else None)
        if found:
            held.remove(found)


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def plain_statistics(own, text):
    """Longest run that ends at each word and stands in some template, by looking it up in all of them."""
    words = licences.words_of(text)
    known = [licences.words_of(t) for t in [*licences.PHRASES, *(t for _, t in licences.TEMPLATES)]]
    runs = {tuple(w[i:j]) for w in known for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    return [max((n for n in range(i + 2) if not n or tuple(words[i + 1 - n : i + 1]) in runs)) for i in range(len(words))]


def scanned_statistics(own, text):
    m, out, s, run = own.machine, [], 0, 0
    for w in licences.words_of(text):
        w = own.ids.get(w, -1)
        while s and w not in m.next[s]:
            s = m.link[s]
            run = m.length[s]
        s, run = (m.next[s][w], run + 1) if w in m.next[s] else (0, 0)
        out.append(run)
    return out


def test_licences(spark, data, odd, none):
    rng, own = random.Random(1), licences.Scanner()
    bag = "cc by general public license all rights reserved the gnu x bär".split()
    for _ in range(500):
        text = " ".join(rng.choice(bag) for _ in range(rng.randint(0, 30)))
        assert own.report(text)[:5] == plain_base(text)
    out = queries.op2_licences(spark, data).toPandas()
    given = spark.read.parquet(f"{data}/documents.parquet").toPandas().set_index("doc_id")["text"]
    for r in out.itertuples():
        n, places, _, _, labels = plain_base(given[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, places, labels) and 0 <= r.score <= 1
    assert own.report(licences.TEMPLATES[0][1][30:])[5] == "mit"
    twice = own.report(f"{licences.TEMPLATES[0][1]} and some other words between them {licences.TEMPLATES[0][1]}")
    n = len(licences.words_of(licences.TEMPLATES[0][1]))
    assert twice[7] == [f"0-{n - 1}:mit", f"{n + 6}-{2 * n + 5}:mit"] and twice[6] == 1.0
    assert plain_statistics(own, twice_text := f"x {licences.TEMPLATES[5][1]} permission is hereby granted, free of charge, to you") == scanned_statistics(own, twice_text)
    found = licences.scan_licences(spread(odd)).toPandas()
    assert len(found) == odd.count() and found[found["text"].isna()]["n_words"].eq(0).all()
    assert licences.scan_licences(none).count() == 0


def plain_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, odd, none, monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))]
        text = [rng.choice("abcdxyz") if rng.random() < 0.12 else c for c in item]
        text = [rng.choice("abcij") for _ in range(rng.randint(0, 15))] + text + [rng.choice("abcij") for _ in range(rng.randint(0, 15))]
        own = decontamination.Matcher([(1, " ".join(item))], 0.8)
        found, edits = list(own.leaks(" ".join(text))), plain_edits(item, text)
        assert bool(found) == (edits <= own.items[0].budget) and (not found or found[0][1] == edits)
    items = spark.createDataFrame([(1, "Alpha5, alpha6 alpha7! alpha8 beta alpha10 alpha11"), (2, None), (3, ""), (4, "text of Row"), (None, "a b c d e f g h")], "item_id long, text string")
    run = lambda **size: {(r.doc_id, r.item_id, r.edits) for r in decontamination.find_leaks(spread(odd), items, **size).collect()}
    wanted = {(6, 1, 1), (7, 1, 1), (None, 1, 1), (8, None, 0), (9, None, 0), (3, 4, 0)}
    assert run() == wanted and run(block_bytes=20) == wanted
    for size in ({}, {"block_bytes": 20}):
        kept = decontamination.decontaminate(odd, items, **size)
        assert kept.columns == odd.columns and kept.count() == odd.count() - 8
        assert decontamination.find_leaks(none, items, **size).count() == 0
    assert decontamination.find_leaks(odd, items.limit(0)).count() == 0


def test_decontamination_of_short_and_unspaced_items(spark):
    """Items of a few words, and of scripts without spaces, are found; long items too, in both ways of search."""
    long = [f"w{i}" for i in range(3000)]
    near = [w if i % 7 else "x" for i, w in enumerate(long)]
    items = spark.createDataFrame([(1, "What is two plus"), (2, "今日は天気がいいので散歩に行きましょうか"), (3, "ภาษาไทยไม่มีช่องว่าง"), (4, " ".join(long))], "item_id long, text string")
    texts = ["So: what is two plus two?", "前文。今日は天気がよいので散歩に行きましょうか。後文", "ก่อน ภาษาไทยไม่มีช่องว่าง หลัง", "lead " + " ".join(near) + " tail", "what two is plus", "今日は寒い", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    assert found == {(0, 1), (1, 2), (2, 3), (3, 4)}
    rows = lambda **size: sorted(map(tuple, decontamination.find_leaks(docs, items, **size).collect()))
    assert rows() == rows(block_bytes=0)


def test_quality(spark, odd, none):
    small = "/root/testdata/sf0.01"
    out = queries.op4_quality(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    test = out[out["held_out"]]
    good, bad = test[test["quality"] == 1]["score"].to_numpy(), test[test["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (out["predicted"] == (out["score"] >= 0.7)).all()
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, 1), (4, None), (None, 1), (99, 1), (5, 7)], "doc_id long, quality int")
    rated = quality.score(spread(odd), labels).toPandas()
    assert len(rated) == odd.count() and rated["score"].between(0, 1).all()
    assert quality.score(none, labels).count() == 0
    assert quality.score(odd, labels.limit(0)).filter("score < 1").count() == 0


def plain_repeats(texts):
    """For each text, the lines inside pairs of lines that stand earlier, in an earlier text or in the same one."""
    seen, out = set(), []
    for text in texts:
        lines, gone = text.split("\n") if text else [], set()
        for i, pair in enumerate(itertools.pairwise(lines)):
            if pair in seen:
                gone |= {i, i + 1}
            seen.add(pair)
        out.append(gone)
    return out


def held_to_all_pairs(docs, least):
    """Nothing but lines of repeated pairs goes, and of these at least the share ``least``; whole copies go whole."""
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    out = {r.doc_id: r for r in linechunks.remove_repeated_lines(spread(docs)).collect()}
    want = went = 0
    texts = set()
    for r, gone in zip(rows, plain_repeats([r.text for r in rows]), strict=True):
        lines, found = (r.text or "").split("\n"), out[r.doc_id]
        rest = iter(found.text.split("\n") if found.n_removed < len(lines) else [])
        kept = next(rest, None)
        for i, line in enumerate(lines):
            if i not in gone:
                # a greedy walk: what may not go must be met in order
                while kept is not None and kept != line:
                    kept = next(rest, None)
                assert kept == line
                kept = next(rest, None)
        assert found.n_removed <= len(gone)
        want, went = want + len(gone), went + found.n_removed
        if r.text in texts and len(lines) > 1:
            assert found.n_removed == len(lines)
        texts.add(r.text)
    assert want > 0 and went >= least * want, (want, went)


def test_line_chunks(spark, data, odd, none):
    held_to_all_pairs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.98)
    found = linechunks.remove_repeated_lines(spread(odd)).toPandas()
    assert len(found) == odd.count() and found[found["doc_id"] == 9]["n_removed"].item() == 8 and found[found["doc_id"] == 8]["n_removed"].item() == 0
    assert linechunks.remove_repeated_lines(none).count() == 0
    same = spark.createDataFrame([(0, "x\nx\nx\nx"), (1, "x\nx"), (2, "x"), (3, "y\nx")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linechunks.remove_repeated_lines(same).collect()) == [(0, "x"), (1, ""), (2, "x"), (3, "y\nx")]


def test_line_chunks_do_not_shift():
    rng = random.Random(8)
    hashes = [rng.getrandbits(64) for _ in range(300)]
    for window in (1, 2, 3):
        inner = set(linechunks.chunks(hashes, window)) - {(0, 2), (298, 2)}
        moved = {(first - 7, n) for first, n in linechunks.chunks([rng.getrandbits(64) for _ in range(7)] + hashes, window)}
        assert inner <= moved and all(n > window for _, n in inner)
        assert {i for first, n in inner for i in range(first, first + n)} >= set(range(2, 298))
    assert linechunks.chunks([]) == linechunks.chunks([1]) == [] and linechunks.chunks([1, 2]) == [(0, 2)]
    # lines that differ in every bit: only a line of its own kind closes a chunk
    zero, ones = 0, next(h for h in iter(lambda: rng.getrandbits(64), None) if linechunks.rolled([h], 1)[0] == (1 << linechunks.BITS) - 1)
    assert set(linechunks.chunks([zero, ones, ones, ones, zero])) == {(0, 5), (0, 2), (1, 2), (2, 2), (3, 2)}


def test_line_chunks_against_all_repeated_runs(spark):
    """Runs of two lines and more that stand in an earlier text too, between other lines, go whole but for a few; other lines never go."""
    rng = random.Random(12)
    line = lambda: f"l{rng.randrange(10**9)}"
    sizes = [2, 3, 4, 6, 10] * 60
    runs = [[line() for _ in range(n)] for n in sizes]
    texts = [[*(line() for _ in range(5)), *run, *(line() for _ in range(5))] for run in runs for _ in range(2)]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in linechunks.remove_repeated_lines(docs).collect()}
    share = {n: 0.0 for n in sizes}
    for i, (n, run) in enumerate(zip(sizes, runs, strict=True)):
        assert out[2 * i].n_removed == 0 and out[2 * i + 1].n_removed <= n
        assert set(texts[2 * i + 1]) - set(out[2 * i + 1].text.split("\n")) <= set(run)
        share[n] += out[2 * i + 1].n_removed / n / 60
    assert share[2] > 0.9 and min(share[n] for n in (3, 4, 6, 10)) > 0.99, share


def plain_passages(texts):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        rest = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), gone.count(1), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(rest).hexdigest()))
    return out


def fields(rows):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def test_passages(spark, odd, none, monkeypatch):
    rng = random.Random(9)
    pool = ["".join(rng.choice("ab cé") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    texts = ["".join(rng.choice(pool)[rng.randint(0, 50) :] for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["x" * 700, "y" + "x" * 300, "xy" * 200, "yx" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = plain_passages(texts)
    run = lambda: fields(passages.remove_repeats(docs.repartition(4)).orderBy("doc_id").collect())
    assert run() == wanted
    monkeypatch.setattr(passages, "CROWD", 1)
    assert run() == wanted
    monkeypatch.setattr(passages, "SLICE", 150)
    assert run() == wanted
    found = passages.remove_repeats(spread(odd), keep_text=True).toPandas()
    assert len(found) == odd.count() and passages.remove_repeats(none).count() == 0
    assert sorted(found[found["doc_id"] == 6]["n_removed"])[0] == 0 and sorted(found[found["doc_id"] == 6]["n_removed"])[1:] == [len(NEAR)] * 2
    assert found[found["doc_id"] == 5]["n_removed"].item() == len(LONG)


def test_passages_of_equal_rows(spark):
    """Of wholly equal rows, which share doc_id and text or lack a doc_id, one keeps its bytes."""
    rng = random.Random(10)
    own = ["".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(3)]
    rows = [(1, own[0]), (1, own[0]), (2, own[1]), (2, own[1]), (2, own[1]), (None, own[2]), (None, own[2]), (3, own[0] + own[2])]
    found = passages.remove_repeats(spread(spark.createDataFrame(rows, "doc_id long, text string")), keep_text=True).collect()
    kept = sorted((r.doc_id or 9, r.n_removed, bytes(r.kept).decode()) for r in found)
    assert kept == sorted([(1, 0, own[0]), (1, 500, ""), (2, 0, own[1]), (2, 500, ""), (2, 500, ""), (3, 500, own[2]), (9, 500, ""), (9, 500, "")])


def test_mtree(spark, none, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(mtree, "LEAF", 8)
    monkeypatch.setattr(mtree, "TREE_ROWS", 64)
    monkeypatch.setattr(mtree, "BLOCK", 4)
    vectors = rng.normal(size=(300, 6)).round(1) * rng.uniform(0.1, 3, size=(300, 1))
    vectors[250:] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf"), 1.0]), (None, [1.0]), (304, []), (305, [2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = mtree.top_k(table, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    known = {i: np.floor(256 * np.pad(np.float32(v).astype(float), (0, 6 - len(v)))).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q in sorted(i for i in known if i % 20 == 0):
        best = sorted(((-int(known[q] @ v), i) for i, v in known.items() if i != q))[:5]
        wanted += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert [tuple(r) for r in out] == wanted
    assert mtree.top_k(table.limit(0), F.lit(True), 5).count() == 0
    assert mtree.top_k(table.filter("vec_id < 3"), F.lit(True), 5).count() == 6
    # rows that share the query's id are candidates; only its own row is none
    again = spark.createDataFrame([(50, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, mtree.top_k(again, F.col("vec_id") == 50, 1).collect())) == [(50, 1, 50, 5 << 16)] * 2


def test_trees_out_of_reach_are_left_out(spark, monkeypatch):
    """With vectors in far clusters, most (tree, block) pairs are no work units, and all best rows are found."""
    monkeypatch.setattr(mtree, "TREE_ROWS", 64)
    monkeypatch.setattr(mtree, "LEAF", 8)
    rng = np.random.default_rng(8)
    centres = np.eye(16) * 20
    vectors = np.repeat(centres, 60, axis=0) + rng.normal(size=(960, 16)) * 0.05
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    seen = []
    real = mtree.units
    monkeypatch.setattr(mtree, "units", lambda roots, blocks, *x: seen.append((roots.count(), blocks.count(), (u := real(roots, blocks, *x)).count())) or u)
    out = mtree.top_k(table, F.col("vec_id") % 20 == 0, 5).collect()
    assert len(out) == 48 * 5 and all(r.vec_id // 60 == r.query_id // 60 for r in out)
    trees, blocks, pairs = seen[0]
    assert trees >= 16 and pairs < 0.5 * trees * blocks


def plain_rules(rows, support=0.01, confidence=0.8):
    """The rules from all sets of up to LONGEST classes of frequent tokens, counted one by one."""
    n = len(rows)
    of = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            of.setdefault(t, set()).add(i)
    classes = {}
    for t in sorted(t for t, held in of.items() if len(held) >= support * n):
        classes.setdefault(frozenset(of[t]), []).append(t)
    found = {}
    for size in range(urls.LONGEST + 1):
        for own in itertools.combinations(sorted(classes, key=lambda h: classes[h][0]), size):
            held = set(range(n)).intersection(*own)
            for verdict in {v for _, v in rows}:
                both = sum(rows[i][1] == verdict for i in held)
                if own and both >= support * n and both / len(held) >= confidence:
                    found[frozenset(classes[h][0] for h in own), verdict] = (both / len(held), both / n)
    kept = []
    for (tokens, verdict), (sure, share) in found.items():
        shorter = [c for (t, v), (c, _) in found.items() if v == verdict and t < tokens]
        if not any(c >= sure for c in shorter):
            whole = frozenset(x for t in tokens for own in classes.values() if own[0] == t for x in own)
            kept.append((whole, verdict, sure, share))
    return sorted(kept, key=lambda r: (-r[2], -r[3], len(r[0]), r[1], sorted(r[0])))


def test_url_rules_of_many_common_keys(spark):
    """Thirty keys, each in most urls: the frequent sets of any length are too many to list, those of up to LONGEST aren't."""
    rng = random.Random(17)
    rows = []
    for _ in range(1000):
        keys = [f"k{i:02}" for i in range(30) if rng.random() < 0.7]
        block = {"k03", "k17"} <= set(keys) and rng.random() < 0.95 or "k29" not in keys and rng.random() < 0.7
        rows.append(("http://a.net/?" + "&".join(f"{k}=1" for k in keys), "block" if block else "allow"))
    marked = spark.createDataFrame(rows, "url string, verdict string").select(urls.url_tokens(F.col("url")).alias("tokens"), "verdict")
    begin = time.monotonic()
    rules = urls.mine_rules(marked)
    assert time.monotonic() - begin < 120
    assert len(rules) > 10 and rules == plain_rules([(r.tokens, r.verdict) for r in marked.collect()])


def test_url_rules_by_level_and_by_growth(spark):
    rng = random.Random(5)
    for share in (0.1, 0.6):
        rows = [([f"t{i}" for i in range(7) if rng.random() < 0.6] + ["all"], rng.choice(["allow", "block", "block", None]) if rng.random() < share else "block") for _ in range(150)]
        marked = spark.createDataFrame(rows, "tokens array<string>, verdict string")
        grown = urls.mine_rules(marked, 0.03, 0.6)
        assert grown == urls.mine_rules(marked, 0.03, 0.6, most=0) == plain_rules([r for r in rows if r[1]], 0.03, 0.6)
    assert urls.mine_rules(marked.filter("verdict is null"), most=0) == []
    assert urls.mine_rules(spark.createDataFrame([([], "allow"), (["a"], "block")], "tokens array<string>, verdict string"), 0.9, most=0) == []


def test_urls(spark):
    given = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://m.example.org/en/2", "ftp://x.com/fr/", "http://com/de/1", "http://org", "nothing", None, "http://org?x", "http://notorg/", "a://b.net/p/1?k=1&z=2#t", ""]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(given)] + [(0, given[0], "x"), (None, None, None)], "page_id long, url string, host string")
    out = urls.judge(pages, queries.URL_RULES).toPandas().sort_values("page_id", kind="stable")
    by = {r.page_id: (r.host, r.path, r.rule) for r in out.itertuples()}
    assert by[0] == ("a.example.org", "/es/x", "example.org/es/") and by[1][2] == "example.org/en/1" and by[2][2] == "org/"
    assert by[3][2] == "com/fr/" and by[4] == ("com", "/de/1", "com/de/") and by[5][:2] == ("org", "") and by[6][:2] == ("", "") and by[8][:2] == ("org", "") and by[9][2] is None
    assert len(out) == 14 and set(out["verdict"]) <= {"allow", "block"}
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0
    labelled = spark.createDataFrame([(f"http://s{i % 7}.{'bad' if i % 2 else 'good'}.net/p/{i}", "block" if i % 2 else "allow") for i in range(60)], "url string, verdict string")
    marked = labelled.select(urls.url_tokens(F.col("url")).alias("tokens"), "verdict")
    rules = urls.mine_rules(marked)
    assert rules == plain_rules([(r.tokens, r.verdict) for r in marked.collect()])
    assert rules[0][2] == 1.0 and {frozenset(["domain=bad.net", "host1=bad"]), frozenset(["domain=good.net", "host1=good"])} <= {r[0] for r in rules}
    deep = spark.createDataFrame([(f"http://a.b{i % 5}.c.net/x/y/z{'q' if i % 2 else 'r'}?k=1&l=2&m{'n' if i % 3 else 'o'}=3", "block" if i % 2 and i % 3 else "allow") for i in range(90)], "url string, verdict string")
    assert any({"step2=zq", "key=mn"} <= r[0] and r[1] == "block" and r[2] == 1.0 for r in urls.mine_rules(deep.select(urls.url_tokens(F.col("url")).alias("tokens"), "verdict")))
    tokens = [["domain=bad.net", "host1=bad", "host2=s1"], ["host2=s2"], ["domain=good.net", "host1=good"]]
    fired = {tuple(r.known): r.decided for r in urls.fire(spark.createDataFrame([(t,) for t in tokens], "known array<string>"), rules).collect()}
    for t in tokens:
        plain = next((v for own, v, _, _ in rules if own <= set(t)), None)
        assert fired.get(tuple(t)) == plain


def test_simhash(spark, odd, none, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 3)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5))) & (2**64 - 1) for b in base for _ in range(6)] + [base[0] ^ k for k in range(64)]
    codes = sorted(set(c % 2**64 for c in codes))
    prints = spark.createDataFrame([(c.to_bytes(8, "big"),) for c in codes], "fingerprint binary").repartition(3)
    roots = {r.node: r.root for r in simhash.linked(prints, 1, 5, 4, 4).collect()}
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {c: int(roots.get(f"{c:016x}", f"{c:016x}"), 16) for c in codes} == {c: find(c) for c in codes}
    out = simhash.near_duplicates(spread(odd)).toPandas()
    assert len(out) == odd.count() and set(out[out["fingerprint"] == "0" * 16]["component_id"]) == {0}
    hashes = [xxhash.xxh64_intdigest(" ".join(f"alpha{j}" for j in range(i, i + 4)), seed=42) for i in range(297)]
    plain = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 297)
    assert set(out[out["doc_id"] == 6]["fingerprint"]) == {f"{plain:016x}"}
    assert set(out[out["doc_id"].isin([4, 5])]["component_id"]) == {4}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(spread(odd), **simhash.SIMILAR)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 3, 4, 6, 8, 10, 11}
    assert simhash.one_of_each(none, **simhash.SIMILAR).count() == 0


def test_near_duplicates_by_jaccard(spark):
    """Pairs link from a Jaccard of 0.8 on and not below, repeated lines or not: against the sets of five-word shingles."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for i in range(240):
        own = [word() for _ in range(200)]
        other = own[:]
        for at in rng.sample(range(4, 196), 1 + i % 9):
            other[at] = word()
        texts += [" ".join(own), " ".join(other)]
    line = " ".join(word() for _ in range(8))
    texts += [" ".join([line] * 40 + [word() for _ in range(60)]) for _ in range(6)]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    close = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    pairs = [close(grams(a), grams(b)) for a, b in zip(texts[:480:2], texts[1:480:2], strict=True)]
    assert 60 < sum(pairs) < 180
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **simhash.SIMILAR).collect()}
    wrong = [i for i, p in enumerate(pairs) if not p and not {2 * i, 2 * i + 1} <= kept]
    missed = [i for i, p in enumerate(pairs) if p and 2 * i + 1 in kept]
    assert not wrong and len(missed) <= 0.01 * sum(pairs) and set(range(480, 486)) <= kept


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, odd, none):
    sized = spread(odd).drop("size").withColumn("size", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    out = mixing.mix(sized).toPandas()
    assert len(out) == odd.count() and (out["taken"] <= 2 * out["size"]).all()
    by = out.groupby(out["source"].fillna("\0"))
    assert (abs(by["taken"].sum() - by["target"].first()) <= 1).all() and by["target"].sum().gt(0).all()
    assert by["target"].first().sum() == pytest.approx(1.5 * out["size"].sum())
    again = mixing.mix(sized.repartition(2)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert out[order].sort_values(order).to_numpy().tolist().__repr__() == again[order].sort_values(order).to_numpy().tolist().__repr__()
    assert mixing.mix(none.withColumn("size", F.lit(1).cast("long"))).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_pipeline_stages(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("extra", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "source mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == list(DOCUMENT_COLUMNS)
        assert stage(spark, docs.limit(0), small).count() == 0
    final = corpus_pipeline.run(spark, small).toPandas()
    rated = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{small}/labels.parquet")).filter("predicted = 1").collect()}
    leaks = {r.doc_id for r in decontamination.find_leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert len(final) and set(final["doc_id"]) <= rated - leaks
    assert all(sorted(g) == list(range(len(g))) for _, g in final.groupby("shard")["slot"])


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, each with the result its stage names."""
    small = "/root/testdata/sf0.001"
    given = sorted(str(tuple(r)) for r in odd.select(*DOCUMENT_COLUMNS).collect())
    stages = dict(corpus_pipeline.STAGES)
    ran = {name: stages[name](spark, spread(odd), small) for name in stages}
    rows = {name: sorted(str(tuple(r)) for r in ran[name].select(*DOCUMENT_COLUMNS).collect()) for name in stages}
    assert all(ran[name].columns == list(DOCUMENT_COLUMNS) for name in list(stages)[:-1])
    assert all(set(found) <= set(given) for found in rows.values())
    # texts without words are one group, as are copies and near copies; the least doc_id stays
    kept = ran["simhash near-dedup"].select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 3, 4, 6, 8, 10, 11]
    assert rows["benchmark decontamination"] == rows["sharding"] == given
