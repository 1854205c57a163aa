"""Corpus statistics over tokens of words, syllables and phones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import computed
from ..functions.separator import Separator
from .prepare import dense_order

KEY = ["doc_id", "line_no"]


def texts(tagged: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and text of the non-empty utterances; filters and tokens would otherwise compute the text for each of its uses."""
    return computed(tagged, keep, text=F.col("text")).filter(F.trim("text") != "")


def tokens(tagged: DataFrame, level: str = "word", separator: Separator = Separator()) -> DataFrame:
    """(doc_id, line_no, pos, token) of the non-empty utterances."""
    rows = texts(tagged, KEY)
    return rows.select(*KEY, F.posexplode(separator.tokenize(F.col("text"), level, keep_boundaries=False)).alias("pos", "token"))


def most_common(tokens_: DataFrame, n: int | None = None) -> DataFrame:
    """(token, n), the most frequent first, ties by first appearance."""
    counted = tokens_.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "pos")).alias("_at"))
    ordered = counted.orderBy(F.desc("n"), "_at")
    return (ordered if n is None else ordered.limit(n)).select("token", "n")


def describe_tokens(tokens_: DataFrame) -> DataFrame:
    """One row: tokens, types, hapaxes."""
    counted = tokens_.groupBy("token").agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapaxes"))


def unigrams(tokens_: DataFrame) -> DataFrame:
    """(token, n, share)."""
    total = tokens_.agg(F.count("*")).scalar()
    return tokens_.groupBy("token").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def describe_utterances(tagged: DataFrame, separator: Separator = Separator()) -> DataFrame:
    """One row: nutts, nutts_single_word."""
    size = F.size(separator.tokenize(F.col("text"), "word", keep_boundaries=False))
    rows = texts(tagged, []).select(size.alias("n"))
    return rows.agg(F.count("*").alias("nutts"), F.count_if(F.col("n") == 1).alias("nutts_single_word"))


def moving_ratio(words: DataFrame, size: int = 10, bucket: int = 20_000) -> DataFrame:
    """One row, mattr: mean share of distinct tokens over windows of ``size`` tokens in corpus order; the last full window is left out, null without a window.

    ``words`` is (doc_id, line_no, pos, token), or utterances with their array ``tokens``. One row an utterance is moved, not one a token:
    ranges of ``bucket`` utterances are handled apart, and each utterance is handed the first tokens of the ``size`` after it, which
    its windows can't pass.
    """
    if "tokens" not in words.columns:
        words = words.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t")).select(*KEY, F.col("t.token").alias("tokens"))
    placed = dense_order(words.filter(F.size("tokens") > 0), KEY).select("_ord", "tokens")
    own = F.floor(F.col("_ord") / bucket)
    both = F.when((F.col("_ord") % bucket < size) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.withColumn("_b", F.explode(both)).withColumn("_head", F.slice("tokens", 1, size))
    after = Window.partitionBy("_b").orderBy("_ord")
    ahead = F.flatten(F.array_compact(F.array(*[F.lead("_head", k).over(after) for k in range(1, size + 1)])))
    rows = dealt.withColumn("_ahead", F.slice(ahead, 1, size)).filter(F.col("_b") == own)
    # the windows that another token follows
    rows = rows.select(F.concat("tokens", "_ahead").alias("t"), F.least(F.size("tokens"), F.size("tokens") + F.size("_ahead") - size).alias("n")).filter("n > 0")
    different = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.size(F.array_distinct(F.slice("t", i, size))))
    sums = rows.select("n", F.aggregate(different, F.lit(0).cast("long"), lambda s, x: s + x).alias("d"))
    return sums.agg(F.try_divide(F.sum("d"), F.lit(float(size)) * F.sum("n")).alias("mattr"))


def entropy(tagged: DataFrame, separator: Separator = Separator()) -> DataFrame:
    """One row: minus the sum over word tokens of p log2 p, by the number of phones less one."""
    if separator.phone is None:
        raise KeyError("entropy needs a phone separator")
    phones = tokens(tagged, "phone", separator).agg(F.count("*")).scalar()
    bits = unigrams(tokens(tagged, "word", separator)).agg(F.sum(F.col("n") * F.col("share") * F.log2("share")).alias("s"))
    return bits.select(F.try_divide(-F.col("s"), phones - 1).alias("entropy"))


def report(tagged: DataFrame, separator: Separator = Separator()) -> DataFrame:
    """(level, name, value): all statistics of a corpus but the moving ratio, by one scan and one shuffle.

    Each utterance gives a row for each of its tokens of each level, and one for itself; they are counted by (level, token) and
    the counts added up by level. value is a double; entropy is null for fewer than two phones.
    """
    rows = texts(tagged, [])
    levels = list(reversed(separator.levels()))
    own = {level: separator.tokenize(F.col("text"), level, keep_boundaries=False) for level in levels}
    rows = rows.select(*[own[level].alias(level) for level in levels])
    tagged_ = lambda level: F.transform(level, lambda t: F.struct(F.lit(level).alias("level"), t.alias("token")))
    single = F.array(F.struct(F.lit("utterance").alias("level"), F.when(F.size("word") == 1, "single").otherwise("other").alias("token"))) if "word" in own else F.array()
    counts = rows.select(F.inline(F.concat(single, *[tagged_(level) for level in levels]))).groupBy("level", "token").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    sums = counts.groupBy("level").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapaxes"), F.sum(n * n * F.log2(n)).alias("bits"), F.sum(n * n).alias("squares"), F.sum(F.when(F.col("token") == "single", F.col("n")).otherwise(0)).alias("single"))
    named = lambda level, **values: F.when(F.col("level") == level, F.array(*[F.struct(F.lit(f"{level}s").alias("level"), F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()]))
    parts = [named(level, tokens=F.col("tokens"), types=F.col("types"), hapaxes=F.col("hapaxes")) for level in levels]
    parts.append(named("utterance", nutts=F.col("tokens"), nutts_single_word=F.col("single")))
    out = sums.select(F.inline(F.coalesce(*parts))).withColumn("level", F.when(F.col("level") == "utterances", "corpus").otherwise(F.col("level")))
    if separator.phone and separator.word:
        of = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c)))
        words, phones = sums.select("level", "tokens", "bits", "squares"), F.col("phones") - 1
        whole = words.agg(of("word", "tokens").alias("words"), of("word", "bits").alias("bits"), of("word", "squares").alias("squares"), of("phone", "tokens").alias("phones"))
        bits = (F.log2("words") * F.col("squares") - F.col("bits")) / F.col("words")
        out = out.unionByName(whole.filter("words is not null").select(F.lit("corpus").alias("level"), F.lit("entropy").alias("name"), F.try_divide(bits, phones.cast("double")).alias("value")))
    return out


def describe(tagged: DataFrame, separator: Separator = Separator()) -> dict:
    """Nested report: corpus, words, syllables, phones. Two passes over the corpus: counts, and the moving ratio, which needs the order."""
    counts = report(tagged, separator).collect()  # a few rows
    found = {(r["level"], r["name"]): r["value"] for r in counts}
    whole = lambda level, name: int(found.get((level, name), 0))
    first = {name: whole("corpus", name) for name in ("nutts", "nutts_single_word")}
    words = tagged.filter(F.trim("text") != "").select(*KEY, separator.tokenize(F.col("text"), "word", keep_boundaries=False).alias("tokens"))
    first["mattr"] = moving_ratio(words).first()["mattr"]
    if separator.phone:
        first["entropy"] = found.get(("corpus", "entropy"))
    out = {"corpus": first}
    for level in reversed(separator.levels()):
        out[f"{level}s"] = {name: whole(f"{level}s", name) for name in ("tokens", "types", "hapaxes")}
        if not out[f"{level}s"]["tokens"]:
            raise ValueError(f"no {level} in the corpus")
    return out
