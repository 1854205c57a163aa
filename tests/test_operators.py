"""Literal cases of the segmentation operators."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import pairs
from lexiloom.functions.separator import Separator
from lexiloom.operators import baseline, dibs, evaluate, folding, prepare, puddle, sampling, statistics, syllables, tp
from lexiloom.plans import catalog


@pytest.fixture
def lines(spark):
    return lambda texts: spark.createDataFrame([(0, i, x) for i, x in enumerate(texts)], "doc_id long, line_no int, text string")


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "line_no").collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_separator_rules(spark):
    with pytest.raises(ValueError):
        Separator("a", "a", "b")
    own = Separator("p", "s", "w")
    assert value(spark, own.strip(F.lit("ps w p"))) == ""
    assert value(spark, own.remove(F.lit("..p.s.p.w"))) == "....."
    assert value(spark, own.remove(F.lit("wss p"))) == " "
    nested = Separator("_", ";", " ").tokenize(F.lit("j_uː_ n_oʊ_ dʒ_ʌ_s_;t_ "))
    assert value(spark, nested) == [[["j", "uː"]], [["n", "oʊ"]], [["dʒ", "ʌ", "s"], ["t"]]]
    assert own.upper_levels("phone") == ["syllable", "word"] and str(Separator("_", None, " ")) == '(phone: "_", word: " ")'
    assert list(own.iterate("pair")) == [("phone", "p"), ("syllable", "s"), ("word", "w")]
    for bad in ("a+", "\\[ab\\]", "x|y"):
        with pytest.raises(ValueError, match="illegal"):
            Separator(bad, "b", "c")
    with pytest.raises(ValueError, match="undefined"):
        Separator("_", None, " ").upper_levels("syllable")
    with pytest.raises(ValueError):
        own.iterate("other")
    assert value(spark, Separator("_", None, " ").split(F.lit("a_b c_ "), "word")) == ["ab", "c", ""]


def test_prepare_and_gold(lines):
    tagged = lines(["s ow ;esyll ;eword ax m p ;esyll ey sh ;esyll ax n t ;esyll ;eword", " \t"])
    assert texts(prepare.prepare(tagged)) == ["s ow ax m p ey sh ax n t"]
    assert texts(prepare.prepare(tagged, unit="syllable")) == ["sow axmp eysh axnt"]
    assert texts(prepare.gold(tagged)) == ["sow axmpeyshaxnt"]


@pytest.mark.parametrize("bad", ["", "   ", "s ow ;esyll ;eword ax", "a ;eword b ;esyll ;eword", " a ;esyll ;eword", "a! ;esyll ;eword"])
def test_bad_utterances(lines, bad):
    assert prepare.validate(lines([bad])).first().error
    assert prepare.prepare(lines([bad]), tolerant=True).count() == 0
    if bad.strip():
        with pytest.raises(Exception, match="line 1"):
            prepare.prepare(lines([bad])).collect()


@pytest.mark.parametrize("threshold, dependency, expected", [("absolute", "ftp", "hhaxl owwerl d"), ("relative", "ftp", "hhaxl owwerld"), ("absolute", "btp", "hhax lowwer ld"), ("relative", "btp", "hhax lowwer ld")])
def test_tp(lines, threshold, dependency, expected):
    assert texts(tp.segment(lines(["hh ax l ow w er l d"]), threshold=threshold, dependency=dependency)) == [expected]


def test_tp_edges_and_unseen(lines):
    hello, unseen = lines(["hh ax l ow w er l d"]), lines(["g uh d m ao r n ax ng"])
    assert texts(tp.segment(lines(["waed yuw waant naw", "buwp"]))) == ["waedyuwwaantnaw", "buwp"]
    assert texts(tp.segment(unseen, hello, "absolute")) == ["g uh d m ao r n ax ng"]
    assert texts(tp.segment(unseen, hello, "relative")) == ["guhdmaornaxng"]


def test_large_models_are_joined(lines, monkeypatch):
    from lexiloom.functions import pairs

    given = lines(["hh ax l ow w er l d", "hh ax", "d"])
    expected = texts(tp.segment(given))
    monkeypatch.setattr(pairs, "MAP_PAIRS", 1)
    assert texts(tp.segment(given)) == expected


def test_dibs(lines):
    tagged = lines(["a b ;eword c ;eword", "a b ;eword d ;eword"])
    counts = dibs.summary(tagged, Separator(" ", None, ";eword"))["counts"].first()
    assert (counts.nlines, counts.nwords, counts.nphones) == (2, 4, 6)
    model = dibs.fit(dibs.summary(tagged, Separator(" ", None, ";eword")), "gold")
    assert texts(dibs.apply(lines(["a b c", "x y"]), model)) == ["ab c", "x y"]


def test_evaluate(lines):
    found = evaluate.evaluate(lines(["the dog bites thedog"]), lines(["the dog bites the dog"]), lines(["th e d o g b i te s th e d o g"]))
    assert found["token_fscore"] == pytest.approx(2 / 3) and found["type_fscore"] == pytest.approx(0.857142857)
    assert found["boundary_all_fscore"] == pytest.approx(10 / 11) and found["boundary_noedge_recall"] == 0.75
    assert found["adjusted_rand_index"] == pytest.approx(0.7845303867403315)
    assert evaluate.evaluate(lines(["a b"]), lines(["ab"]))["boundary_noedge_recall"] is None
    with pytest.raises(Exception, match="letters differ"):
        evaluate.evaluate(lines(["ab"]), lines(["ac"]))
    summary = {(r.category, r.word) for r in evaluate.error_summary(lines(["ba by goin ghom e"]), lines(["baby going home"])).collect()}
    assert summary == {("over", "baby"), ("mis", "going"), ("mis", "home")}


def test_folds(lines):
    rows = folding.fold(lines(list("1234")), 3).collect()
    order = [[r.text for r in sorted(rows, key=lambda r: (r.turn, r._ord)) if r.fold == f] for f in range(3)]
    assert order == [list("1234"), list("3412"), list("2341")]
    assert texts(folding.unfold(folding.fold(lines(list("1234")), 3), 3)) == list("1234")
    with pytest.raises(ValueError):
        folding.fold(lines(["a"]), 2)


def test_baseline(lines):
    given = lines(["h e l l o"])
    assert texts(baseline.segment(given, 0.0)) == ["hello"] and texts(baseline.segment(given, 1.0)) == ["h e l l o "]
    with pytest.raises(ValueError):
        baseline.segment(given, 1)


def test_statistics(lines):
    tagged = lines(["a b ;eword c ;eword"] * 6)
    own = Separator(" ", None, ";eword")
    assert statistics.describe_tokens(statistics.tokens(tagged, "word", own)).first().asDict() == {"tokens": 12, "types": 2, "hapaxes": 0}
    assert statistics.moving_ratio(statistics.tokens(tagged, "word", own)).first().mattr == pytest.approx(0.2)
    assert statistics.moving_ratio(statistics.tokens(lines(["a ;eword"]), "word", own)).first().mattr is None
    assert [r.token for r in statistics.most_common(statistics.tokens(tagged, "word", own), 1).collect()] == ["ab"]


def test_syllables(lines):
    own = Separator(";", "_", " ")
    onsets, vowels = "p b t d k g n m l r s x 9 j tr br".split(), list("aeiou")
    assert texts(syllables.syllabify(lines(["no se kae", "esta tata", "mira"]), onsets, vowels, own)) == ["no_ se_ ka_e_ ", "es_ta_ ta_ta_ ", "mi_ra_ "]
    errors = [r.error for r in syllables.syllabify(lines(["brla"]), onsets, vowels, own, tolerant=False).select("error").collect()]
    assert errors == ['onset not found in "brla"']
    assert syllables.syllabify(lines(["prt", "?a", "pa"]), onsets, vowels, own, tolerant=True).count() == 1
    phones = lines(["n;o; s;e; k;a;e; ", "e;s;t;a; ", "no se"])
    assert texts(syllables.syllabify(phones, onsets, vowels, own)) == ["n;o;_ s;e;_ k;a;_e;_ ", "e;s;_t;a;_ ", "no_ se_ "]
    assert texts(syllables.syllabify(phones, onsets, vowels, own, strip=True)) == ["n;o s;e k;a_e", "e;s_t;a", "no se"]
    assert syllables.syllabify(lines(["es;ta; ", "est;a; "]), onsets, vowels, own, tolerant=True).select("text").first().text == "es;_ta;_ "
    assert "cut a phone" in syllables.syllabify(lines(["est;a; "]), onsets, vowels, own).select("error").first().error


def test_puddle_learns_and_freezes(lines):
    given = lines(["l o o k", "l o o k a t", "a t l o o k a t"])
    out = texts(puddle.segment_online(given))
    assert [x.replace(" ", "") for x in out] == ["look", "lookat", "atlookat"]
    model = puddle.train(given)
    assert {r.item for r in model.filter("kind = 'word'").collect()} >= {"look", "lookat"}
    assert [x.replace(" ", "") for x in texts(puddle.apply(given, model))] == ["look", "lookat", "atlookat"]


def test_samples_and_vote(lines, spark):
    given = lines(["a b a b a b", "a b c a b c"])
    drawn = sampling.samples(given, sweeps=5, keep=3)
    assert drawn.count() == 6
    assert [x.replace(" ", "") for x in texts(sampling.vote(drawn))] == ["ababab", "abcabc"]
    rows = [(0, 0, 0, s, t) for s, t in enumerate(["ab c", "a bc", "a bc"])] + [(0, 1, 0, 0, "x y"), (0, 1, 0, 1, "xy")]
    votes = sampling.vote(spark.createDataFrame(rows, "doc_id long, line_no int, run int, sample int, text string"))
    assert texts(votes) == ["a bc", "x y"]


def test_puddle_models_of_known_words(spark, lines):
    words = spark.createDataFrame([(["h", "e", "y"],), (["h", "e", "y"],), (["a"],), ([],), (None,), (["d", "oo", "r"],)], "units array<string>")
    model = {(r.kind, r.item): r.n for r in puddle.known(words).collect()}
    assert model == {("word", "hey"): 2, ("word", "a"): 1, ("word", "door"): 1, ("begin", "he"): 2, ("begin", "doo"): 1, ("end", "ey"): 2, ("end", "oor"): 1}
    one = {(r.kind, r.item) for r in puddle.known(words, 1).collect()}
    assert {("begin", "h"), ("begin", "d"), ("end", "y"), ("end", "r")} == {k for k in one if k[0] != "word"}
    assert puddle.known(words.limit(0)).count() == 0
    given = lines(["h e y d oo r", "d oo r h e y a", "x h e y h e y", "a"])
    assert texts(puddle.apply(given, puddle.known(words))) == ["hey door", "door heya", "xheyhey", "a"]
    taught = puddle.Learner()
    for units in ("hey", "hey", "a"):
        taught.learn(list(units), 0, len(units) - 1)
    assert {(k, i, n) for k, i, n in taught.rows()} == {(k, i, n) for (k, i), n in model.items() if "oo" not in i}


def plain_puddle(lines, window=2, frequency=False):
    """The learner word for word on lists: literal slices, restart after each match."""
    words, begins, ends, out = {}, set(), set(), []

    def emit(units, i, j, into):
        word = "".join(units[i : j + 1])
        words[word] = words.get(word, 0) + 1
        if j > i:
            begins.add("".join(units[i : i + window]))
            ends.add("".join(units[j + 1 - window : j + 1]))
        into.append(word)

    for line in lines:
        units, into = line.split(), []
        while units:
            for i, j in ((i, j) for i in range(len(units)) for j in range(i, len(units))):
                if "".join(units[i : j + 1]) not in words:
                    continue
                k = max((k for k in range(j, len(units)) if "".join(units[i : k + 1]) in words), key=lambda k: (words["".join(units[i : k + 1])], k)) if frequency else j
                if (i == 0 or "".join(units[i - window : i]) in ends) and "".join(units[k + 1 : k + 1 + window]) in begins:
                    if i:
                        emit(units, 0, i - 1, into)
                    emit(units, i, k, into)
                    units = units[k + 1 :]
                    break
            else:
                emit(units, 0, len(units) - 1, into)
                units = []
        out.append(" ".join(into))
    return out


@pytest.mark.parametrize("window, frequency", [(2, False), (3, True)])
def test_puddle_against_a_plain_learner(spark, data, lines, window, frequency):
    from lexiloom.plans import catalog

    given = catalog.prepared_of(spark, data).filter("doc_id < 15").orderBy("doc_id", "line_no").select("doc_id", "line_no", "text")
    rows = given.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.doc_id, []).append(r.text)
    wanted = [x for own in groups.values() for x in plain_puddle(own, window, frequency)]
    found = puddle.segment_online(given, window=window, by_frequency=frequency)
    assert texts(found) == wanted and any(" " in x for x in wanted)
    few = lines([r.text for r in rows[:12]])
    folds = [[*range(12 - 4 * f, 12), *range(12 - 4 * f)] for f in range(3)]
    order = [dict(zip(f, plain_puddle([rows[i].text for i in f], window, frequency), strict=True)) for f in folds]
    assert texts(puddle.segment(few, window=window, by_frequency=frequency, nfolds=3)) == [order[2 - i // 4][i] for i in range(12)]


def test_large_puddle_models_are_joined(lines, monkeypatch):
    train, test = lines(["a b c", "a b", "c d", "a b c d", "d c"]), lines(["a b c d", "c d a b", "x a b", "d"])
    model = puddle.train(train)
    wanted = texts(puddle.apply(test, model))
    monkeypatch.setattr(puddle, "MODEL_ROWS", 1)
    assert texts(puddle.apply(test, model)) == wanted


def test_restaurants():
    import random

    from lexiloom.operators import dpseg

    rng, letters = random.Random(1), dpseg.Letters(3)
    own = dpseg.Restaurant(0.3, 2.0, letters)
    words = [tuple(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(200)]
    for w in words:
        own.insert(w, rng)
    assert own.total == 200 and own.m == sum(map(len, own.tables.values())) and letters.total == sum(len(w) + 1 for w, t in own.tables.items() for _ in t)
    w = words[0]
    assert own.prob(w) == pytest.approx((own.n[w] - 0.3 * len(own.tables[w])) / 202 + (0.3 * own.m + 2) / 202 * letters.prob(w))
    rng.shuffle(words)
    for w in words:
        own.erase(w, rng)
    assert own.total == own.m == letters.total == 0 and not own.tables
    seated = dpseg.Restaurant(0.3, 2.0, dpseg.Letters(3))
    before = 0.0
    import math

    for w in words[:50]:  # the seating's probability is the product of its steps
        tables = [*seated.tables.get(w, ())]
        n, m = seated.total, seated.m
        seated.insert(w, rng)
        new = len(seated.tables[w]) > len(tables)
        grown = [x for x, y in zip(tables, seated.tables[w], strict=False) if x != y]
        before += math.log((0.3 * m + 2) / (n + 2) if new else (grown[0] - 0.3) / (n + 2))
    assert seated.log_prob() == pytest.approx(before)


def test_draws_of_utterances_against_all_splits():
    import itertools

    from lexiloom.operators import dpseg

    line = list("abcab")
    chain = dpseg.Chain([list("abab"), list("cab"), line], dpseg.Options(estimator="tree", init_pboundary=0.5), 3)
    chain.leave(2)
    n, more = chain.words.total, (chain.words.total - chain.seen + 1) / (chain.words.total + 2)
    weight = {}
    for cuts in itertools.product((False, True), repeat=4):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), 5]
        own = [tuple(line[x:y]) for x, y in zip(at, at[1:], strict=False)]
        p = more ** (len(own) - 1)
        for w in own:
            p *= chain.words.prob(w)
        weight[cuts] = p
    chain.draw(2, 1.0, best=True)
    assert weight[tuple(chain.cuts[2])] == pytest.approx(max(weight.values()))
    seen = {c: 0 for c in weight}
    for _ in range(4000):
        chain.draw(2, 1.0, best=False)
        seen[tuple(chain.cuts[2])] += 1
    total = sum(weight.values())
    assert all(abs(seen[c] / 4000 - weight[c] / total) < 0.04 for c in weight) and n == chain.words.total


@pytest.mark.parametrize("options", [{}, {"ngram": 2}, {"estimator": "tree"}, {"estimator": "viterbi"}, {"estimator": "tree", "online": True}, {"estimator": "decayed", "online": True, "ngram": 2}, {"hypersamp_ratio": 0.1, "a1": 0.2, "anneal_sweeps": 5, "anneal_start": 5.0}, {"estimator": "viterbi", "online": True, "forget": "tokens", "memory": 9}])
def test_dpseg_chains(options):
    from lexiloom.operators import dpseg

    given = ["a b c d", "a b", "c d", "c d a b", "b", "a b c d a b"] * 4
    own = dpseg.Options(sweeps=12, init_pboundary=0.3, **options)
    chain = dpseg.Chain([x.split() for x in given], own, 5)
    trace = chain.run()
    assert ["".join("".join(w) for w in chain.split(i)) for i in range(len(given))] == [x.replace(" ", "") for x in given]
    if not own.forget:
        assert chain.words.total == (sum(len(chain.split(i)) for i in range(len(given))) if own.ngram == 1 else sum(r.m for r in chain.after.values()))
    assert len(trace) == (1 if own.online else 12) and all(x[2] == x[2] for x in trace)


def test_dpseg_folds(lines):
    from lexiloom.operators import dpseg

    given = ["a b c d", "a b", "c d", "c d a b", "a b c d a b", "d c"] * 3
    found = dpseg.segment(lines(given), 3, dpseg.Options(sweeps=30, init_pboundary=0.3))
    assert [x.replace(" ", "") for x in texts(found)] == [x.replace(" ", "") for x in given]
    assert dpseg.traces(lines(given), 3, dpseg.Options(sweeps=2)).count() == 6


def test_dibs_dispatch_and_fold_boundaries(lines):
    tagged = lines(["a b ;eword c ;eword", "a b ;eword d ;eword"])
    own = prepare.prepare(tagged)
    trained = dibs.summary(tagged)
    for kind in dibs.KINDS:
        assert texts(dibs.segment(own, trained, kind)) == texts(dibs.apply(own, dibs.fit(trained, kind)))
    for bad in ({"type": "other"}, {"pwb": 2.0}, {"threshold": -0.1}):
        with pytest.raises(ValueError):
            dibs.segment(own, trained, **bad)
    four = lines(["1", "2", "3", "4"])
    rows = folding.fold(four, 2, [0, 3]).orderBy("fold", "turn", "line_no").collect()
    assert [r.text for r in rows] == ["1", "2", "3", "4", "4", "1", "2", "3"]
    assert texts(folding.unfold(folding.fold(four, 2, [0, 3]), 2)) == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        folding.fold(four, 2, [1, 3])


def test_the_text_of_a_corpus_is_computed_once(spark, data, capsys):
    catalog.prepared_of(spark, data).explain()
    assert capsys.readouterr().out.count("translate(") == 1


@pytest.mark.parametrize("threshold", ["relative", "absolute"])
def test_small_and_large_pair_models_cut_alike(lines, monkeypatch, threshold):
    own = lines(["a b c a b é", "x", "a b x c", "b c a b c"])
    model = tp.fit(own)
    small = texts(tp.apply(own, model, threshold))
    monkeypatch.setattr(pairs, "MAP_PAIRS", 0)
    assert texts(tp.apply(own, model, threshold)) == small


def test_dibs_counts_of_plain_texts_are_those_of_any(lines, monkeypatch):
    own = lines(["a b ;eword c ;esyll d ;eword", ";eword a ;eword ;eword b a;eword", " ;eword", "é a ;eword b ;eword", "x ;eword", "   "])
    seen = lambda: {k: sorted(map(tuple, v.collect()), key=str) for k, v in dibs.summary(own).items() if k != "units"}
    assert dibs.plain_separators(Separator(), "phone")
    plain = seen()
    monkeypatch.setattr(dibs, "plain_separators", lambda separator, level: False)
    assert seen() == plain
