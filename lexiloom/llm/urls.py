"""URL filters from hand-written host/path rules and mined association rules.

A url's tokens (scheme, every host label by its place from the right, every path segment by its place, extension, every query key) and
its label make a transaction. Tokens that are frequent among the labelled urls and always come together count as one, named by the
first of them. Spark's FP-growth finds the frequent sets of these; rules of at most ``LONGEST`` tokens towards a label are kept by support
and confidence, less those that a shorter rule already says as surely. Frequent tokens are at most the mean number of tokens by the
support, whatever the corpus holds.

FP-growth has no bound on a set's length, so its sets may double with every common token. Each frequent set stands in a share ``support`` of the
transactions, so there are at most the transactions' subsets by that share. Where this sum is over ``MOST_SETS``, the same rules are found level by level: sets of
one size grow by one later token inside the distinct transactions that hold them. Sets that lead to one label alone are not grown, as no rule
over them can be surer.

Rules match through an inverted index, token to rules: urls are first reduced to the distinct sets of tokens that occur
in rules at all, a set fires a rule when all of the rule's tokens are found, and its surest rule decides.
"""

from __future__ import annotations

import itertools
import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_join, free_names, written

#: Tokens (those that always come together are one) that a rule may name.
LONGEST = 4
#: Frequent sets that FP-growth may be asked for, at most.
MOST_SETS = 1 << 18
SUPPORT = 0.01
CONFIDENCE = 0.8
DEFAULT = "allow"
LABEL = "verdict="


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the host); empty without ``://`` and for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.regexp_extract(after, r"^[^?#]*", 0), after


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]], give) -> Column:
    """``give(verdict, rule)`` of the longest (verdict, rule) that fits, null if none: a rule is host plus path and holds for subdomains."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.lit(give(verdict, rule))) if out is None else out.when(fits, F.lit(give(verdict, rule)))
    return F.lit(None).cast("string") if out is None else out


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url; digits inside segments count as one class."""
    host, path, after = url_parts(url)
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    named = lambda name: lambda x, i: F.concat(F.lit(name), i.cast("string"), F.lit("="), x)
    domain = F.when(F.size(labels) >= 2, F.concat(F.lit("domain="), labels[1], F.lit("."), labels[0]))
    steps = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(after, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    single = F.array(
        F.when(scheme != "", F.concat(F.lit("scheme="), lower_ascii(scheme))),
        domain,
        F.when(ending != "", F.concat(F.lit("ending="), lower_ascii(ending))),
        F.when(after.contains("#"), F.lit("fragment")),
    )
    many = F.concat(F.transform(labels, named("host")), F.transform(steps, named("step")), F.transform(keys, lambda x: F.concat(F.lit("key="), x)))
    return F.array_distinct(F.concat(F.array_compact(single), many))


def together(tokens: DataFrame, least: float) -> tuple[list[str], dict[str, list[str]]]:
    """(frequent tokens, classes): of ``tokens`` (tokens) those in ``least`` rows or more, and by their first member those that always come together.

    Tokens of a class have equal counts, also as pairs. Only frequent ones pair up, and only equal counts come to the driver.
    """
    counts = written(tokens.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "token-counts")
    count_of = {r["t"]: r["n"] for r in counts.collect()}
    frequent = sorted(count_of)
    known = F.array_sort(F.array_intersect("tokens", F.array(*[F.lit(t) for t in frequent]) if frequent else F.array().cast("array<string>")))
    pairs = tokens.select(known.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    pairs = pairs.select("n", F.explode(F.transform("k", lambda x, i: F.struct(x.alias("a"), F.slice("k", i + 2, F.size("k")).alias("later")))).alias("p"))
    pairs = pairs.select("n", "p.a", F.explode("p.later").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    side = lambda at: counts.select(F.col("t").alias(at), F.col("n").alias(f"n_{at}"))
    equal = bounded_join(bounded_join(pairs, side("a"), ["a"], "inner"), side("b"), ["b"], "inner").filter("n = n_a and n = n_b").select("a", "b").collect()
    lead = {}
    for a, b in sorted((r["a"], r["b"]) for r in equal):
        lead[b] = min(lead.get(b, a), lead.get(a, a))
    classes: dict[str, list[str]] = {}
    for t in frequent:
        classes.setdefault(lead.get(t, t), []).append(t)
    return frequent, classes


def grown(rows: DataFrame, support: float, confidence: float) -> DataFrame:
    """(tokens, verdict, confidence, support) of ``rows`` (own, verdict), by FP-growth."""
    items = rows.select(F.concat("own", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    towards = F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)) & (F.size("antecedent") <= LONGEST)
    verdict = F.substring(F.col("consequent")[0], len(LABEL) + 1, 1 << 30)
    return model.associationRules.filter(towards).select(F.col("antecedent").alias("tokens"), verdict.alias("verdict"), "confidence", "support")


def levelled(rows: DataFrame, n: int, support: float, confidence: float) -> DataFrame:
    """The same rules of ``rows`` (own, verdict), level by level up to ``LONGEST`` tokens.

    A level has (tokens, after, w) for each set that stands in a distinct transaction: the tokens after the set's last, and the counts by verdict.
    Support goes by the counts of one verdict, the highest of which must reach it for a set to be grown.
    """
    least = math.ceil(support * n)
    by_verdict = rows.groupBy(F.array_sort("own").alias("own"), "verdict").agg(F.count("*").alias("n"))
    # few rows become many, so they are spread by a number that adaptive execution keeps
    by_verdict = by_verdict.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = by_verdict.select(F.array().cast("array<string>").alias("tokens"), F.col("own").alias("after"), "verdict", "n")
    found = None
    for size in range(1, LONGEST + 1):
        step = F.explode(F.transform("after", lambda x, i: F.struct(x.alias("t"), F.slice("after", i + 2, F.size("after")).alias("after"))))
        level = level.select("tokens", step.alias("s"), "verdict", "n").select(F.concat("tokens", F.array("s.t")).alias("tokens"), "s.after", "verdict", "n")
        counts = level.groupBy("tokens", "verdict").agg(F.sum("n").alias("both"))
        whole = counts.groupBy("tokens").agg(F.sum("both").alias("all"), F.max("both").alias("most"), F.collect_list(F.struct("verdict", "both")).alias("of"))
        whole = written(whole.filter(F.col("most") >= least), f"url-sets-{size}")
        rules = whole.select("tokens", "all", F.explode("of").alias("v")).select("tokens", "v.verdict", (F.col("v.both") / F.col("all")).alias("confidence"), F.col("v.both").alias("both"))
        rules = rules.filter((F.col("both") >= least) & (F.col("confidence") >= confidence)).select("tokens", "verdict", "confidence", (F.col("both") / F.lit(n)).alias("support"))
        found = rules if found is None else found.unionByName(rules)
        if size < LONGEST:
            level = written(bounded_join(level.filter(F.size("after") > 0), whole.filter("all > most").select("tokens"), ["tokens"], "left_semi"), f"url-level-{size}")
    return found


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST_SETS) -> list[tuple[frozenset, str, float, float]]:
    """(tokens, verdict, confidence, support) from (tokens, verdict) rows, the surest first."""
    rows = written(labelled.filter("verdict is not null").select("tokens", "verdict"), "labelled-urls")
    if not (n := rows.count()):
        return []
    _, classes = together(rows, support * n)
    leads = F.array(*[F.lit(t) for t in classes]) if classes else F.array().cast("array<string>")
    rows = rows.select(F.array_intersect("tokens", leads).alias("own"), "verdict")
    # subsets of each transaction and its label, by the least transactions of a frequent set
    sets = rows.agg(F.sum(F.pow(F.lit(2.0), F.size("own") + 1))).first()[0] / max(1.0, support * n)
    mined = grown(rows, support, confidence) if sets <= most else levelled(rows, n, support, confidence)
    found = [(frozenset(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in mined.collect()]
    found.sort(key=lambda r: (len(r[0]), -r[2], r[1], sorted(r[0])))
    kept: dict[tuple[frozenset, str], float] = {}
    out = []
    for tokens, verdict, sure, share in found:
        parts = (frozenset(own) for size in range(1, len(tokens)) for own in itertools.combinations(tokens, size))
        said = max((kept.get((own, verdict), 0.0) for own in parts), default=0.0)
        if sure > said:
            kept[tokens, verdict] = sure
            out.append((frozenset(t for lead in tokens for t in classes[lead]), verdict, sure, share))
    return sorted(out, key=lambda r: (-r[2], -r[3], len(r[0]), r[1], sorted(r[0])))


def fire(sets: DataFrame, rules: list[tuple[frozenset, str, float, float]]) -> DataFrame:
    """(known, decided): the verdict of the surest rule all of whose tokens are in the array ``known``."""
    index = [(t, n, len(tokens), verdict) for n, (tokens, verdict, _, _) in enumerate(rules) for t in sorted(tokens)]
    kind = T.StructType([T.StructField("token", T.StringType()), T.StructField("rule_no", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("decided", T.StringType())])
    postings = sets.sparkSession.createDataFrame(index, kind)
    hits = sets.select("known", F.explode("known").alias("token")).join(F.broadcast(postings), "token")
    whole = hits.groupBy("known", "rule_no", "need", "decided").agg(F.count("*").alias("n")).filter("n = need")
    return whole.groupBy("known").agg(F.min_by("decided", "rule_no").alias("decided"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """``pages`` (url, anything else) plus host, path, rule and verdict.

    The longest (verdict, rule) of ``rules`` that fits decides; else the surest mined rule, else ``default``. The labels are
    ``labelled`` (url, verdict), by default the pages that the given rules decide. Null urls and those without ``://`` have an empty
    host and path and get the verdict of their (few) tokens. Null ids and repeated rows pass through; rules that tie in confidence go by support, then
    the shorter one, then the verdict. A very long url has as many tokens as parts. An empty table gives an empty result. Input columns
    named like results are replaced, all others stay.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    given, tokens, known, said = free_names(pages, "_given", "_tokens", "_known", "_mined")
    host, path, _ = url_parts(F.col("url"))
    seen = pages.withColumn("host", host).withColumn("path", path)
    seen = seen.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules, lambda v, r: r))
    seen = seen.withColumn(given, rule_column(F.col("host"), F.col("path"), rules, lambda v, r: v)).withColumn(tokens, url_tokens(F.col("url")))
    seen = written(seen, "urls")
    if labelled is None:
        labelled = seen.select(F.col(tokens).alias("tokens"), F.col(given).alias("verdict"))
    else:
        labelled = labelled.select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    mined = mine_rules(labelled, support, confidence)
    if not mined:
        return seen.withColumn("verdict", F.coalesce(given, F.lit(default))).drop(given, tokens)
    used = sorted({t for own, *_ in mined for t in own})
    seen = seen.withColumn(known, F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(t) for t in used])))).drop(tokens)
    decided = fire(seen.select(F.col(known).alias("known")).distinct(), mined).select(F.col("known").alias(known), F.col("decided").alias(said))
    out = bounded_join(seen, written(decided, "url-sets"), [known])
    return out.withColumn("verdict", F.coalesce(given, said, F.lit(default))).drop(given, said, known)
