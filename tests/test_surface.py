"""Command line, jobs, sources and sinks, transcripts, SQL functions and the streaming learner."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiloom import cli, jobs
from lexiloom.functions import sql
from lexiloom.operators import puddle
from lexiloom.sources import chat, corpus

TAGGED = ["hh ax l ow ;esyll ;eword w er l d ;esyll ;eword", "w er l d ;esyll ;eword hh ax l ow ;esyll ;eword", "hh ax l ow ;esyll ;eword", "ax l ;esyll ;eword w er l d ;esyll ;eword", "l ow ;esyll ;eword hh ax ;esyll ;eword"]


def written_lines(path):
    return [x for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]


def test_commands(spark, tmp_path):
    (tmp_path / "tagged").write_text("\n".join(TAGGED) + "\n")
    at = lambda name: str(tmp_path / name)
    assert cli.main(["prep", at("prepared"), at("tagged"), "-g", at("gold")]) == 0
    assert written_lines(at("prepared"))[0] == "hh ax l ow w er l d" and written_lines(at("gold"))[0] == "hhaxlow werld"
    assert cli.main(["stats", at("stats"), at("tagged"), "--json"]) == 0 and json.loads("\n".join(written_lines(at("stats"))))["corpus"]["nutts"] == 5
    for name, more in (("tp", ["-t", "absolute"]), ("dibs", ["-T", at("tagged"), "-t", "gold"]), ("puddle", ["-f", "2"]), ("baseline", ["-P", "1.0"])):
        assert cli.main([name, at(name), at("prepared"), *more]) == 0
        assert [x.replace(" ", "") for x in written_lines(at(name))] == [x.replace(" ", "") for x in written_lines(at("prepared"))]
    assert cli.main(["eval", at("scores"), at("dibs"), at("gold"), "-r", at("prepared"), "-s", at("errors")]) == 0
    assert [x.split("\t")[0] for x in written_lines(at("scores"))][0] == "token_precision" and len(written_lines(at("scores"))) == 13
    assert set(json.loads("\n".join(written_lines(at("errors"))))) == {"correct", "over", "under", "mis"}
    assert cli.main(["tp", at("nowhere"), at("missing")]) == 1
    for name in ("prep", "gold", "syll", "stats", *cli.SEGMENTERS, "eval", "jobs"):
        with pytest.raises(SystemExit) as end:
            cli.main([name, "--help"])
        assert end.value.code == 0


def test_jobs(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(TAGGED) + "\n")
    t = tmp_path / "t.txt"
    text = f"# comment\ntp {t} phone -p' ' -s';esyll' -w';eword' segment-tp -v -t absolute -d ftp\ndb {t},{t} syllable -p' ' -s';esyll' -w';eword' segment-dibs -u syllable\n"
    found = jobs.run_jobs(spark, text, cli.job_segmenters(), str(tmp_path / "out"))
    assert set(found) == {"tp", "db"} and all(0 <= v <= 1 for own in found.values() for v in own.scores.values() if v is not None)
    assert written_lines(tmp_path / "out/tp/gold.txt")[0] == "hhaxlow werld"
    summary = json.loads("\n".join(written_lines(tmp_path / "out/tp/summary.json")))
    assert list(summary) == ["correct", "over", "under", "mis"] and all(list(own.values()) == sorted(own.values(), reverse=True) for own in summary.values())
    for bad in (f"a {t} word -p' ' segment-tp", f"a {t} phone -p' ' segment-other", f"a {t}x phone -p' ' segment-tp", text + text):
        with pytest.raises(ValueError):
            jobs.read_jobs(bad, set(cli.SEGMENTERS), jobs.there(spark))


def test_jobs_overlap_and_a_failed_one_leaves_the_others(spark, tmp_path):
    (tmp_path / "good.txt").write_text("\n".join(TAGGED) + "\n")
    (tmp_path / "bad.txt").write_text("no word separator here\n")
    line = lambda name, of: f"{name} {tmp_path / of} phone -p' ' -s';esyll' -w';eword' segment-tp"
    found = jobs.run_jobs(spark, "\n".join([line("one", "good.txt"), line("two", "bad.txt"), line("three", "good.txt")]), cli.job_segmenters(), str(tmp_path / "out"), at_once=3)
    assert found["two"].scores is None and "word separator" in str(found["two"].error)
    assert found["one"].scores == found["three"].scores and found["one"].error is None
    assert max(o.began for o in found.values()) < min(found[n].ended for n in ("one", "three"))
    assert written_lines(tmp_path / "out/two/error.txt") and written_lines(tmp_path / "out/three/gold.txt")[0] == "hhaxlow werld"


def test_standard_streams_and_dibs_on_its_own_input(spark, tmp_path, capsys, monkeypatch):
    import io

    (tmp_path / "tagged").write_text("\n".join(TAGGED) + "\n")
    assert cli.main(["dibs", str(tmp_path / "own"), str(tmp_path / "tagged"), "-t", "gold"]) == 0
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(("\n".join(TAGGED) + "\n").encode())))
    assert cli.main(["dibs", "-", "-", "-t", "gold"]) == 0
    assert capsys.readouterr().out.splitlines() == written_lines(tmp_path / "own") and len(written_lines(tmp_path / "own")) == 5


def test_transcripts(spark):
    lines = ["*MOT: hello [= noise] (y)ou &um xxx there_is .", "*CHI: no .", "%com: x", "*FAT: 0 .", "*MOT: look@o at the dog@s:spa cow@sing !"]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, text string")
    found = [r.text for r in chat.cleaned(chat.select_speakers(rows)).orderBy("line_no").collect()]
    assert found == ["hello you there is", "look at the dog cow"]  # colons are gone before the rule on switched words can meet one
    say = lambda text, language: spark.range(1).select(chat.phonologised(F.lit(text), language).alias("v")).first().v
    assert say("Chico y perro que huye", "raspanish") == "Tiko i peRo ke uSe" and say("Ñache'", "qom") == "NaCeQ"
    with pytest.raises(ValueError):
        chat.phonologised(F.lit(""), "other")


def test_sql_functions(spark):
    assert "word_rows" in sql.register(spark)
    spark.createDataFrame([(0, TAGGED[0])], "id long, t string").createOrReplaceTempView("tagged_rows")
    row = spark.sql("SELECT prepare_phones(t) p, prepare_syllables(t) s, gold_words(t) g FROM tagged_rows").first()
    assert tuple(row) == ("hh ax l ow w er l d", "hhaxlow werld", "hhaxlow werld")
    assert [tuple(r) for r in spark.sql("SELECT pos, word FROM word_rows('a  b c') ORDER BY pos").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    row = spark.sql("SELECT prepare_text('a_b_;c_;|', '_', ';', '|', 'syllable') s, prepare_text('a b;c|', ' ', NULL, '|', 'phone') p, gold_text('a_b_;c_;|d_;|', '_', ';', '|') g").first()
    assert tuple(row) == ("a_b_ c_", "a b;c", "abc d")
    rows = spark.sql("SELECT * FROM token_rows('a b /c /|d /|', ' ', '/', '|') ORDER BY 1, 2, 3").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c"), (1, 0, 0, "d")]
    rows = spark.sql("SELECT * FROM syllable_rows('banta eka', array('b', 'n', 't', 'k'), array('a', 'e')) ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "ban"), (0, 1, "ta"), (1, 0, "e"), (1, 1, "ka")]
    with pytest.raises(Exception, match="no syllables"):
        spark.sql("SELECT * FROM syllable_rows('brt', array('b'), array('a'))").collect()
    rows = spark.sql("SELECT * FROM best_words('a b c d', map('ab', 9L, 'cd', 9L)) ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [(0, "ab"), (1, "cd")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "o.conf").write_text("# chain\nngram = 2\nsamples-per-utt = 7\n--online = true\nestimator=decayed\n")
    from lexiloom.operators.dpseg import Options

    assert Options(**corpus.read_options(spark, str(tmp_path / "o.conf"), Options())) == Options(ngram=2, samples_per_utt=7, online=True, estimator="decayed")
    lines = spark.createDataFrame([(0, 0, "the dog"), (0, 1, "a")], "doc_id long, line_no int, text string")
    assert [r.text for r in corpus.read_gold_spaced(lines).orderBy("line_no").collect()] == ["t h e d o g", "a"]
    with pytest.raises(Exception, match="ends with a space"):
        corpus.read_gold_spaced(lines.withColumn("text", F.lit("a "))).collect()
    (tmp_path / "parses").write_text("a b\nc\n\na b\nc d\n\na\n")
    assert sorted(map(tuple, corpus.read_parses(spark, str(tmp_path / "parses")).collect())) == [(0, 0, "a b"), (0, 1, "c"), (1, 0, "a b"), (1, 1, "c d")]
    rows, table = corpus.encoded_units(lines.withColumn("text", F.lit("hh ax hh")))
    assert {len(r.text) for r in rows.collect()} == {3} and table.count() == 2
    pairs = spark.createDataFrame([("a", "b", 1, 2), ("c", "d", 4, 0)], "a string, b string, internal long, spanning long")
    assert [r.value for r in corpus.diphone_lines(pairs).collect()] == ["4 c d", "3 a b"]
    assert corpus.raw_lines({"words": {"tokens": 3}}) == ["words tokens 3"]


@pytest.mark.parametrize("memory", [0, 3])
def test_streaming_learner(spark, tmp_path, memory):
    from lexiloom.streaming.learner import PROVIDER, segment_stream

    rows = [(d, i, t) for d in (1, 2) for i, t in enumerate(["a b", "c d", "a b c d", "c d a b", "b a b", "e f g", "h i", "a b e f g", "c d"])]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == k], "doc_id long, line_no int, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    given = spark.readStream.schema("doc_id long, line_no int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.conf.unset(PROVIDER)
    with pytest.raises(ValueError, match="RocksDB"):
        segment_stream(given)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = segment_stream(given, memory=memory).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
    finally:
        spark.conf.unset(PROVIDER)
    found = {(r.doc_id, r.line_no): r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {m: {(r.doc_id, r.line_no): r.text for r in puddle.segment_online(spark.createDataFrame(rows, "doc_id long, line_no int, text string"), memory=m).collect()} for m in (0, 3)}
    assert found == whole[memory] and whole[0] != whole[3]
