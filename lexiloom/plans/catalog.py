"""Named queries over the driver's tables: lines of prose are gold utterances, their letters phones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import computed
from ..functions.separator import Separator
from ..functions import sql as sql_functions
from ..operators import adaptor, baseline, dibs, dpseg, evaluate, folding, frozen, grammars, prepare, puddle, sampling, statistics, syllables, tp
from ..sources import chat, corpus, text
from .oracle import oracle_sql  # noqa: F401

SEP = Separator(phone=" ", syllable=";esyll", word=";eword")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer files than there are cores is dealt out, so that a small file does not keep one core busy."""
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if out.rdd.getNumPartitions() < cores else out


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived_corpus(table(spark, sf_dir, "documents"))


def tagged_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tagged(gold_of(spark, sf_dir), SEP)


def prepared_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare(tagged_of(spark, sf_dir), SEP)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.numbered_lines(table(spark, sf_dir, "documents")).withColumnRenamed("line", "text")
    return prepare.validate(lines, SEP).groupBy("error").agg(F.count("*").alias("n"))


def statistic(level: str) -> Query:
    return lambda spark, d: statistics.describe_tokens(statistics.tokens(tagged_of(spark, d), level, SEP))


def tp_table(dependency: str) -> Query:
    return lambda spark, d: rounded(tp.fit(prepared_of(spark, d), dependency), "score")


def tp_segment(threshold: str, dependency: str) -> Query:
    return lambda spark, d: tp.segment(prepared_of(spark, d), threshold=threshold, dependency=dependency)


def tp_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.segment(prepare.prepare(corpus.tagged(items_of(spark, sf_dir), SEP), SEP), train=prepared_of(spark, sf_dir))


def dibs_model(kind: str) -> Query:
    return lambda spark, d: dibs.fit(dibs.summary(tagged_of(spark, d), SEP), kind)


def dibs_segment(kind: str) -> Query:
    return lambda spark, d: dibs.apply(prepared_of(spark, d), dibs_model(kind)(spark, d))


def with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared utterances with their gold text beside them, so that scoring joins nothing."""
    return prepare.prepare(tagged_of(spark, sf_dir).withColumn("gold", prepare.gold_text(F.col("text"), SEP)), SEP)


def evaluated(segment: Callable[[SparkSession, str, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: rounded(evaluate.scores(segment(spark, d, with_gold(spark, d))), "precision", "recall", "fscore")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as text files, read back in many tasks and numbered over all files."""
    path = text.scratch(spark, "corpus")
    corpus.write_utterances(gold_of(spark, sf_dir), path)
    return text.read_lines(spark, path, "corpus").select("line_no", "text")


def parse_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of three samples of the corpus (words, letters, nothing apart, by a rule) and one that was stopped, read back and put to the vote."""
    gold = gold_of(spark, sf_dir)
    n, whole, letters = F.col("doc_id") + F.col("line_no"), F.replace("text", F.lit(" "), F.lit("")), prepare.squeezed(F.regexp_replace(F.replace("text", F.lit(" "), F.lit("")), "(.)", "$1 "))
    kinds = [F.when(n % 3 == 0, whole).otherwise(F.col("text")), F.when(n % 5 == 0, letters).otherwise(F.col("text")), F.when(n % 2 == 0, whole).otherwise(F.col("text")), F.when(F.col("doc_id") % 2 == 0, letters)]
    last, end = spark.createDataFrame([(True, 0, 0, "")], "end boolean, doc_id long, line_no int, text string"), F.col("end")
    own = F.when(end, F.array(*[F.lit("")] * 3)).otherwise(F.array(*kinds))  # an empty line ends each but the stopped one
    rows = gold.select(F.lit(False).alias("end"), "doc_id", "line_no", "text").unionByName(last).repartitionByRange("end", "doc_id", "line_no").sortWithinPartitions("end", "doc_id", "line_no")
    path = text.scratch(spark, "parses")
    # a sample is a folder of files in order, and runs on over their ends, so that no task writes a whole one
    with text.passing(spark, writers=len(kinds)):
        rows.select(F.posexplode(own).alias("sample", "text")).filter("text is not null").write.partitionBy("sample").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    parses = text.read_parses(spark, path, among="corpus")
    return sampling.vote_in_place(parses)


def stimuli_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of training utterances and pairs of a word and its reverse, read by its sections; each pair is decided by the lexicon of the training part."""
    gold, words = gold_of(spark, sf_dir), frozen.lexicon(items_of(spark, sf_dir)).select("word")
    pairs = words.filter(F.reverse("word") != F.col("word")).select(F.concat_ws("\t", "word", F.reverse("word")).alias("text"))
    part = lambda df, k: df.select(F.lit(k).alias("part"), "doc_id", "line_no", "text")
    marks = spark.createDataFrame([(0, 0, 0, "Training"), (2, 0, 0, "Test")], "part int, doc_id long, line_no int, text string")
    path = text.scratch(spark, "stimuli")
    rows = part(gold, 1).unionByName(part(pairs.withColumns({"doc_id": F.lit(0).cast("long"), "line_no": F.lit(0)}), 3)).unionByName(marks)
    rows.orderBy("part", "doc_id", "line_no", "text").select("text").write.text(path)
    stimuli = text.read_stimuli(spark, path)
    costs = frozen.Costs(frozen.lexicon(stimuli.filter("section = 'training'")))
    return rounded(frozen.forced_choice(stimuli.filter("section = 'test'"), costs).select("text", "other", "choice"), "choice")


def frozen_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the best split under the lexicon of the benchmark items."""
    return frozen.viterbi(prepared_of(spark, sf_dir), frozen.Costs(frozen.lexicon(items_of(spark, sf_dir))))


def fold_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of five blocks that each begin with an utterance as long as the first of the corpus, or longer."""
    rows = prepared_of(spark, sf_dir)
    first = rows.agg(F.min_by(F.size(prepare.units_of(F.col("text"))), F.struct("doc_id", "line_no"))).first()[0]
    return folding.fold_starts(rows, 5, first)


ONSETS, VOWELS = list("bcdfghjklmnpqrstvwxyz"), list("aeiou")


def spoken(spark: SparkSession, sf_dir: str, phones: bool = False) -> DataFrame:
    """Gold words that single consonants and vowels can begin; with ``phones``, their letters apart by semicolons."""
    fit = F.ltrim(F.regexp_replace(F.concat(F.lit(" "), "text"), " (?![^aeiou ]?[aeiou])[^ ]+", ""))
    rows = computed(gold_of(spark, sf_dir), ["doc_id", "line_no"], text=fit).filter("text <> ''")
    apart = F.replace(F.concat(F.array_join(F.split("text", ""), ";"), F.lit(";")), F.lit(" ;"), F.lit(" "))
    return rows.withColumn("text", apart) if phones else rows


def syllabified(separator: Separator, phones: bool = False, **options) -> Query:
    return lambda s, d: syllables.syllabify(spoken(s, d, phones), ONSETS, VOWELS, separator, **options).select("doc_id", "line_no", "text")


def tagged_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged utterances of all three levels: letters are phones, syllables by maximal onsets."""
    own = Separator(phone=";", syllable="/", word=" ")
    text_ = F.replace(F.replace(F.replace("text", F.lit(" "), F.lit(";eword ")), F.lit("/"), F.lit(";esyll ")), F.lit(";"), F.lit(" "))
    tags = F.replace(F.replace(text_, F.lit(" eword"), F.lit(" ;eword")), F.lit(" esyll"), F.lit(" ;esyll"))
    rows = text.kept(syllables.syllabify(spoken(spark, sf_dir, phones=True), ONSETS, VOWELS, own).select("doc_id", "line_no", "text"), "syllabified")
    return rows.select("doc_id", "line_no", prepare.squeezed(tags).alias("text"))


def nested_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, syllables and phones of each utterance by the nested arrays of all levels."""
    rows = computed(tagged_syllables(spark, sf_dir), ["doc_id", "line_no"], t=SEP.tokenize(F.col("text")))
    full = lambda x: F.filter(x, lambda y: F.size(y) > 0)
    return rows.select("doc_id", "line_no", F.size("t").alias("words"), F.size(F.flatten("t")).alias("syllables"), F.size(F.flatten(F.flatten("t"))).alias("phones"), F.array_join(F.transform(full("t"), lambda w: F.array_join(F.flatten(w), "")), " ").alias("text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as main tiers of transcripts: a star, three letters of the role, marks as transcribers make them."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "role", F.regexp_replace("text", r"[\n\t]", " ").alias("text"))
    marked = F.concat(F.lit("*"), F.upper(F.rpad("role", 3, "X")), F.lit(": "), F.col("text"), F.when(F.col("line_no") % 3 == 0, " [= noise] xxx &uh there_is look@o dog@s:spa cow@sing (y)ou .").otherwise(" ."))
    return rows.filter("text is not null").select("doc_id", "line_no", marked.alias("text"))


def chat_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.cleaned(chat.select_speakers(transcripts(spark, sf_dir)))


def chat_phonologised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_cleaned(spark, sf_dir).withColumn("text", chat.phonologised(F.col("text"), "raspanish"))


def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones by their place in syllables, by the SQL table function."""
    sql_functions.register(spark)
    tagged_syllables(spark, sf_dir).createOrReplaceTempView("lexiloom_tagged")
    rows = "SELECT p.phone_no, p.phone FROM lexiloom_tagged t, LATERAL token_rows(t.text, ' ', ';esyll', ';eword') p"
    return spark.sql(f"SELECT phone_no, phone, count(*) AS n FROM ({rows}) GROUP BY phone_no, phone")


def sql_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared and gold texts by SQL functions whose separators are arguments."""
    sql_functions.register(spark)
    tagged_syllables(spark, sf_dir).createOrReplaceTempView("lexiloom_tagged")
    own = "' ', ';esyll', ';eword'"
    return spark.sql(f"SELECT doc_id, line_no, prepare_text(text, {own}, 'phone') AS phones, prepare_text(text, {own}, 'syllable') AS syllables, gold_text(text, {own}) AS gold FROM lexiloom_tagged")


def sql_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables and their counts by the table function."""
    sql_functions.register(spark)
    spoken(spark, sf_dir).createOrReplaceTempView("lexiloom_spoken")
    letters = lambda own: "array(" + ", ".join(f"'{x}'" for x in own) + ")"
    return spark.sql(f"SELECT s.syllable, count(*) AS n FROM lexiloom_spoken t, LATERAL syllable_rows(t.text, {letters(ONSETS)}, {letters(VOWELS)}) s GROUP BY s.syllable")


def sql_best_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, counted, by an SQL function of best splits under the 100 most frequent words of the benchmark."""
    known = frozen.lexicon(items_of(spark, sf_dir)).orderBy(F.desc("n"), "word").limit(100).collect()
    sql_functions.register_lexicon(spark, "lexiloom_best", {r["word"]: r["n"] for r in known})
    prepared_of(spark, sf_dir).createOrReplaceTempView("lexiloom_prepared")
    return spark.sql("SELECT word, count(*) AS n FROM (SELECT explode(split(lexiloom_best(text), ' ')) AS word FROM lexiloom_prepared) WHERE word <> '' GROUP BY word")


def beside_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared utterances with the text they were made of beside them, as ``gold``."""
    return prepare.prepare(corpus.tagged(gold_of(spark, sf_dir).withColumn("gold", F.col("text")), SEP), SEP)


def conserved(segmented: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Whether each utterance still has its letters, in order; without ``gold``, those of its own column ``gold``, so that nothing is joined."""
    if gold is None:
        own, given = (F.replace(c, F.lit(" "), F.lit("")) for c in ("text", "gold"))
        return segmented.select("doc_id", "line_no", F.coalesce(own == given, F.lit(False)).alias("conserved"))
    letters = lambda df, to: df.select("doc_id", "line_no", F.replace("text", F.lit(" "), F.lit("")).alias(to))
    both = letters(segmented, "own").join(letters(gold, "given"), ["doc_id", "line_no"], "full")
    return both.select("doc_id", "line_no", F.coalesce(F.col("own") == F.col("given"), F.lit(False)).alias("conserved"))


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived_corpus(table(spark, sf_dir, "benchmark"), key="item_id")


def puddle_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model from the benchmark items, frozen, over all documents."""
    model = puddle.train(prepare.prepare(corpus.tagged(items_of(spark, sf_dir), SEP), SEP))
    return conserved(puddle.apply(beside_gold(spark, sf_dir), model))


def puddle_known(by_frequency: bool) -> Query:
    """All documents, cut by the learner whose frozen model is the words of the benchmark items."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = items_of(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
        model = puddle.known(words.select(F.split("word", "").alias("units")))
        return puddle.apply(prepared_of(spark, sf_dir), model, by_frequency=by_frequency)

    return query


def sampled_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each benchmark item."""
    items = items_of(spark, sf_dir)
    drawn = sampling.samples(prepare.prepare(corpus.tagged(items, SEP), SEP), sweeps=20, keep=5)
    return conserved(sampling.vote(drawn), items)


def adaptor_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over the benchmark items, words being remembered runs of letters."""
    items = items_of(spark, sf_dir)
    prepared = prepare.prepare(corpus.tagged(items, SEP), SEP)
    rules = grammars.parsed(grammars.generated(prepared.select(F.explode(F.split("text", " ")).alias("unit"))))
    return conserved(adaptor.segment(prepared, rules, nruns=2, options=adaptor.Options(sweeps=2)), items)


def unfold_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folding.unfold(folding.fold(gold_of(spark, sf_dir), 5), 5).select("doc_id", "line_no", "text")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "corpus_utterances": gold_of,
        "prepare_phone": prepared_of,
        "gold_words": lambda s, d: prepare.gold(tagged_of(s, d), SEP),
        "validate_errors": validate_errors,
        "unigram_topk": lambda s, d: statistics.most_common(statistics.tokens(tagged_of(s, d), "word", SEP), 100),
        "describe_words": statistic("word"),
        "describe_phones": statistic("phone"),
        "describe_utterances": lambda s, d: statistics.describe_utterances(tagged_of(s, d), SEP),
        "describe_all": lambda s, d: rounded(statistics.report(tagged_syllables(s, d), SEP), "value"),
        "mattr": lambda s, d: rounded(statistics.moving_ratio(tagged_of(s, d).select("doc_id", "line_no", SEP.tokenize(F.col("text"), "word", keep_boundaries=False).alias("tokens"))), "mattr"),
        "entropy": lambda s, d: rounded(statistics.entropy(tagged_of(s, d), SEP), "entropy"),
        "unit_counts": lambda s, d: tp.unit_counts(prepared_of(s, d)),
        "bigram_counts": lambda s, d: tp.bigram_counts(prepared_of(s, d)),
        "tp_train_test": tp_train_test,
        "dibs_counts": lambda s, d: dibs.summary(tagged_of(s, d), SEP)["counts"],
        "dibs_diphones": lambda s, d: dibs.summary(tagged_of(s, d), SEP)["diphones"],
        "evaluate_tp": evaluated(lambda s, d, rows: tp.segment(rows)),
        "evaluate_dibs": evaluated(lambda s, d, rows: dibs.apply(rows, dibs_model("phrasal")(s, d))),
        "ari_tp": lambda s, d: rounded(evaluate.adjusted_rand_index(tp.segment(with_gold(s, d))), "adjusted_rand_index"),
        "ari_units_tp": lambda s, d: rounded(evaluate.adjusted_rand_index(tp.segment(beside_gold(s, d), units="units"), units="units"), "adjusted_rand_index"),
        "error_summary_tp": lambda s, d: evaluate.error_summary(tp.segment(with_gold(s, d))),
        "error_summary_lines": lambda s, d: corpus.summary_lines(evaluate.error_summary(tp.segment(with_gold(s, d)))),
        "fold_assignment": lambda s, d: folding.fold(gold_of(s, d), 5).select("doc_id", "line_no", "block", "fold", "turn"),
        "unfold_roundtrip": unfold_roundtrip,
        "baseline_none": lambda s, d: baseline.segment(prepared_of(s, d), 0.0),
        "baseline_all": lambda s, d: baseline.segment(prepared_of(s, d), 1.0),
        "baseline_random": lambda s, d: conserved(baseline.segment(beside_gold(s, d), 0.5)),
        "puddle_online": lambda s, d: conserved(puddle.segment_online(beside_gold(s, d))),
        "puddle_frozen": puddle_frozen,
        "puddle_known": puddle_known(by_frequency=False),
        "puddle_known_frequency": puddle_known(by_frequency=True),
        "sampled_vote": sampled_vote,
        "puddle_online_text": lambda s, d: puddle.segment_online(prepared_of(s, d)),
        "puddle_folds_text": lambda s, d: puddle.segment(prepare.prepare(corpus.tagged(items_of(s, d), SEP), SEP), nfolds=5),
        "dpseg_folds": lambda s, d: conserved(dpseg.segment(prepare.prepare(corpus.tagged(items_of(s, d), SEP), SEP), 5, dpseg.Options(sweeps=10, init_pboundary=0.3)), items_of(s, d)),
        "adaptor_vote": adaptor_vote,
        "oracle_probability": lambda s, d: rounded(baseline.word_share(tagged_of(s, d), SEP), "probability"),
        "text_lines": text_lines,
        "parse_vote": parse_vote,
        "stimuli_choice": stimuli_choice,
        "frozen_viterbi": frozen_viterbi,
        "fold_repair": fold_repair,
        "syllabify": syllabified(Separator(phone=";", syllable="_", word=" ")),
        "syllabify_stripped": syllabified(Separator(phone=";", syllable="_", word=" "), strip=True),
        "syllabify_phones": syllabified(Separator(phone=";", syllable="_", word=" "), phones=True),
        "syllabify_phones_stripped": syllabified(Separator(phone=";", syllable="_", word=" "), phones=True, strip=True),
        "prepare_syllable": lambda s, d: prepare.prepare(tagged_syllables(s, d), SEP, "syllable"),
        "describe_syllables": lambda s, d: statistics.describe_tokens(statistics.tokens(tagged_syllables(s, d), "syllable", SEP)),
        "nested_tokens": nested_tokens,
        "chat_cleaned": chat_cleaned,
        "chat_phonologised": chat_phonologised,
        "sql_tokens": sql_tokens,
        "sql_prepared": sql_prepared,
        "sql_syllables": sql_syllables,
        "sql_best_words": sql_best_words,
        "diphone_dump": lambda s, d: corpus.diphone_lines(dibs.summary(tagged_of(s, d), SEP)["diphones"]),
    }
    for dependency in ("ftp", "btp", "mi"):
        out[f"tp_table_{dependency}"] = tp_table(dependency)
        for threshold in ("relative", "absolute"):
            out[f"tp_{threshold}_{dependency}"] = tp_segment(threshold, dependency)
    for kind in ("gold", "phrasal", "lexical"):
        out[f"dibs_model_{kind}"] = lambda s, d, k=kind: rounded(dibs_model(k)(s, d), "score")
        out[f"dibs_{kind}"] = dibs_segment(kind)
    return out
