"""Command line: ``lexiloom prep|gold|syll|stats|baseline|tp|dibs|puddle|dpseg|eval|jobs``. Inputs and outputs are text files that Spark reads and writes."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from . import jobs
from .functions.separator import Separator
from .operators import baseline, dibs, dpseg, evaluate, prepare, puddle, statistics, syllables, tp
from .sources import corpus, text

SEGMENTERS = ("baseline", "tp", "dibs", "puddle", "dpseg")


def add_options(command: argparse.ArgumentParser, name: str) -> None:
    add = command.add_argument
    if name == "baseline":
        add("-P", "--probability", type=float, default=0.5)
        add("-r", "--random-seed", type=int, default=0)
        add("-o", "--oracle", help="tagged text that the probability is taken from")
    elif name == "tp":
        add("-t", "--threshold", choices=("absolute", "relative"), default="relative")
        add("-d", "--dependency", choices=("ftp", "btp", "mi"), default="ftp")
    elif name == "dibs":
        add("-t", "--type", choices=dibs.KINDS, default="phrasal")
        add("-a", "--threshold", type=float, default=0.5)
        add("-b", "--pboundary", type=float)
        add("-u", "--unit", choices=("phone", "syllable"), default="phone")
    elif name == "puddle":
        add("-w", "--window", type=int, default=2)
        add("-F", "--by-frequency", action="store_true")
    elif name == "dpseg":
        for option, value in dpseg.Options().__dict__.items():
            kind = {"type": type(value)} if not isinstance(value, bool) else {"action": "store_true"}
            add("--" + option.replace("_", "-"), default=value, **kind)
        add("-c", "--config", help="file of lines option = value, under options that are given here")
    if name in ("puddle", "dpseg"):
        add("-f", "--nfolds", type=int, default=5)
    if name in ("tp", "dibs", "puddle"):
        add("-T", "--train-file", help="text to learn from, tagged for dibs, else prepared")


def segmented(name: str, args: argparse.Namespace, given: DataFrame, train: DataFrame | None, separator: Separator) -> DataFrame:
    """``given``, prepared, by the segmenter of that name and its options; dibs learns from a tagged text."""
    if name == "baseline":
        if args.oracle:
            return baseline.segment_oracle(given, corpus.read_lines(given.sparkSession, args.oracle), separator, seed=args.random_seed)
        return baseline.segment(given, args.probability, args.random_seed)
    if name == "tp":
        return tp.segment(given, train, args.threshold, args.dependency)
    if name == "dibs":
        if train is None:  # the given text is tagged, then, and what is learned from it segments it
            train, given = given, prepare.prepare(given, separator, args.unit)
        return dibs.segment(given, dibs.summary(train, separator, args.unit), args.type, args.threshold, args.pboundary)
    if name == "puddle":
        return puddle.segment(given, train, args.window, args.by_frequency, args.nfolds)
    own = {k: getattr(args, k) for k in dpseg.Options().__dict__}
    if args.config:
        own = corpus.read_options(given.sparkSession, args.config, dpseg.Options()) | {k: v for k, v in own.items() if v != getattr(dpseg.Options(), k)}
    return dpseg.segment(given, args.nfolds, dpseg.Options(**own))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, separators: bool = False, output: bool = True) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=text)
        one.add_argument("-v", "--verbose", action="count", default=0)
        one.add_argument("-q", "--quiet", action="store_true")
        if output:
            one.add_argument("output", help="folder of text files to write")
        if separators:
            for level, value in Separator().iterate("pair"):
                one.add_argument(f"-{level[0]}", f"--{level}-separator", default=value)
        return one

    one = command("prep", "prepared units of a tagged text", separators=True)
    one.add_argument("input")
    one.add_argument("-u", "--unit", choices=("phone", "syllable"), default="phone")
    one.add_argument("-t", "--tolerant", action="store_true", help="leave invalid utterances out")
    one.add_argument("-P", "--punctuation", action="store_true", help="allow punctuation")
    one.add_argument("-g", "--gold", help="folder for the gold text of the same utterances")
    command("gold", "gold words of a tagged text", separators=True).add_argument("input")
    one = command("syll", "syllables by maximal onsets", separators=True)
    for name in ("onsets", "vowels", "input"):
        one.add_argument(name)
    for flag, name in (("-S", "--strip"), ("-t", "--tolerant"), ("-f", "--filling-vowel")):
        one.add_argument(flag, name, action="store_true")
    one = command("stats", "statistics of a tagged text", separators=True)
    one.add_argument("input")
    one.add_argument("--json", action="store_true")
    for name in SEGMENTERS:
        one = command(name, f"segment a prepared text with {name}", separators=name in ("dibs", "baseline"))
        one.add_argument("input", help="prepared text; for dibs without a text to learn from a tagged one" if name == "dibs" else "prepared text")
        add_options(one, name)
    one = command("eval", "scores of a segmented against a gold text")
    one.add_argument("text")
    one.add_argument("gold")
    one.add_argument("-r", "--rand-index", metavar="PREPARED", help="prepared text, for the adjusted Rand index")
    one.add_argument("-s", "--summary", help="folder for the error summary")
    command("jobs", "run a file of jobs").add_argument("input")
    return out


def separator_of(args: argparse.Namespace) -> Separator:
    return Separator(*[getattr(args, f"{level}_separator", value) for level, value in Separator().iterate("pair")])


def job_segmenters() -> dict:
    """For each segmenter a function of (prepared, tagged train text or null, tagged test text, job)."""

    def of(name: str):
        def run(given: DataFrame, train: DataFrame | None, tagged: DataFrame, job: jobs.Job) -> DataFrame:
            one = argparse.ArgumentParser(prog=f"{job.name}: {name}")
            one.add_argument("-v", "--verbose", action="count")
            add_options(one, name)
            args = one.parse_args(job.options)
            if name == "dibs":
                return segmented(name, args, given, tagged if train is None else train, job.separator)
            return segmented(name, args, given, None if train is None else prepare.prepare(train, job.separator, job.unit), job.separator)

        return run

    return {name: of(name) for name in SEGMENTERS}


def taken_in(spark: SparkSession, path: str, given=None) -> str:
    """``path``, or for "-" that of a file in the shared folder to which the standard input was copied, a block at a time."""
    if path != "-":
        return path
    own = text.scratch(spark, "stdin") + ".txt"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    with_end = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    source = given or sys.stdin.buffer
    try:
        while block := source.read(1 << 20):
            with_end.write(block)
    finally:
        with_end.close()
    return own


def given_out(spark: SparkSession, path: str) -> None:
    """Print the text files of a folder in the order of their names, a partition at a time."""
    for row in text.read_lines(spark, path, "corpus").orderBy("line_no").select("text").toLocalIterator():
        print(row["text"])


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """A command; with "-" as its output, what it writes is printed."""
    if getattr(args, "output", None) == "-" and args.command != "jobs":
        args.output = text.scratch(spark, "stdout")
        run(spark, args)
        given_out(spark, args.output)
        return
    read = lambda path: corpus.read_lines(spark, taken_in(spark, path))
    separator = separator_of(args)
    if args.command == "prep":
        tagged = read(args.input)
        own = prepare.prepare(tagged, separator, args.unit, not args.punctuation, args.tolerant)
        if args.gold:
            corpus.write_prepared(tagged, own, separator, args.output, args.gold)
        else:
            corpus.write_utterances(own, args.output)
    elif args.command == "gold":
        corpus.write_utterances(prepare.gold(read(args.input), separator), args.output)
    elif args.command == "syll":
        lists = [corpus.read_items(spark, p) for p in (args.onsets, args.vowels)]
        corpus.write_utterances(syllables.syllabify(read(args.input), *lists, separator, args.strip, args.filling_vowel, args.tolerant), args.output)
    elif args.command == "stats":
        found = statistics.describe(read(args.input), separator)
        corpus.write_json(spark, found, args.output) if args.json else corpus.write_text(spark, corpus.raw_lines(found), args.output)
    elif args.command == "eval":
        own, gold = read(args.text), read(args.gold)
        corpus.write_text(spark, corpus.score_lines(evaluate.evaluate(own, gold, read(args.rand_index) if args.rand_index else None)), args.output)
        if args.summary:
            corpus.write_summary(evaluate.error_summary(own, gold), args.summary)
    elif args.command == "jobs":
        ended = jobs.run_jobs(spark, "\n".join(r["value"] for r in spark.read.text(args.input).collect()), job_segmenters(), args.output)
        if failed := {name: own.error for name, own in ended.items() if own.error}:
            raise RuntimeError("; ".join(f"job {name} failed: {str(e).splitlines()[0] if str(e) else e!r}" for name, e in failed.items()))
    else:
        train = getattr(args, "train_file", None)
        corpus.write_utterances(segmented(args.command, args, read(args.input), read(train) if train else None, separator), args.output)


def main(argv: list[str] | None = None) -> int:
    """0, or 1 after an error, which is logged."""
    args = parser().parse_args(argv)
    level = logging.ERROR if args.quiet else [logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)]
    logging.basicConfig(stream=sys.stderr, level=level, format="%(levelname)s %(name)s: %(message)s")
    log = logging.getLogger("lexiloom")
    try:
        run(SparkSession.builder.appName(f"lexiloom-{args.command}").getOrCreate(), args)
    except KeyboardInterrupt:
        log.error("interrupted")
        return 1
    except Exception as error:  # noqa: BLE001  any failure becomes an exit code
        log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
