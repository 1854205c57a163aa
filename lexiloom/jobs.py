"""Jobs files: one pipeline a line, from tagged texts to scores.

A line is ``<name> <test>[,<train>] <unit> <separators> <command>``, the command a segmenter of the command line with its options;
``#`` starts a comment.
"""

from __future__ import annotations

import re
import shlex
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from .functions.separator import Separator
from .operators import evaluate, prepare, statistics
from .sources import corpus

SEPARATORS = re.compile(r"-([psw]) ?('[^']*'|\"[^\"]*\"|\S+)")


@dataclass(frozen=True)
class Job:
    name: str
    test: str
    train: str | None
    unit: str
    separator: Separator
    command: str
    options: list[str] = field(default_factory=list)


def parse_job(line: str, known: set[str]) -> Job:
    head = line.split(None, 3)
    if len(head) < 4 or head[2] not in ("phone", "syllable"):
        raise ValueError(f"a job is <name> <test>[,<train>] phone|syllable <separators> <command>: {line!r}")
    name, files, unit, rest = head
    own, end = {}, 0
    while found := SEPARATORS.match(rest, end):
        own[{"p": "phone", "s": "syllable", "w": "word"}[found[1]]] = found[2].strip("'\"")
        end = found.end() + (len(rest[found.end() :]) - len(rest[found.end() :].lstrip()))
    words = shlex.split(rest[end:])
    command = words[0].rpartition("-")[2] if words else ""
    if command not in known:
        raise ValueError(f"job {name}: unknown command {command!r}, choose in {', '.join(sorted(known))}")
    test, _, train = files.partition(",")
    return Job(name, test, train or None, unit, Separator(**{"phone": None, "syllable": None, "word": None} | own), command, words[1:])


@dataclass(frozen=True)
class Outcome:
    """What became of a job: its scores, or the error that ended it, and when it ran (seconds of one clock)."""

    scores: dict | None
    error: Exception | None
    began: float
    ended: float


def there(spark: SparkSession) -> Callable[[str], bool]:
    """Whether a path exists, by the file system that Spark reads it from; patterns count if they match something."""

    def exists(path: str) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return found is not None and len(found) > 0

    return exists


def read_jobs(text: str, known: set[str], exists: Callable[[str], bool]) -> list[Job]:
    """The jobs of a file, checked: names differ, files are there."""
    jobs = [parse_job(line, known) for raw in text.splitlines() if (line := raw.split("#", 1)[0].strip())]
    names = [j.name for j in jobs]
    if again := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"job names must differ: {', '.join(sorted(again))}")
    if gone := [p for j in jobs for p in (j.test, j.train) if p and not exists(p)]:
        raise ValueError(f"no such file: {', '.join(gone)}")
    return jobs


def run_job(spark: SparkSession, job: Job, segmenters: dict, out: str) -> dict:
    """Statistics, prepared and gold texts, segmentation, scores and error summary of a job, each in a file under ``out``; the scores."""
    start, base = time.time(), f"{out}/{job.name}"
    tagged = corpus.read_lines(spark, job.test)
    prepared, gold = prepare.prepare(tagged, job.separator, job.unit), prepare.gold(tagged, job.separator)
    trained = None if job.train is None else corpus.read_lines(spark, job.train)
    segmented = segmenters[job.command](prepared, trained, tagged, job).persist()
    try:
        corpus.write_json(spark, statistics.describe(tagged, job.separator), f"{base}/stats.json")
        for name, rows in (("prepared", prepared), ("gold", gold), ("segmented", segmented)):
            corpus.write_utterances(rows, f"{base}/{name}.txt", parts=1)
        scores = evaluate.evaluate(segmented, gold, prepared)
        corpus.write_text(spark, corpus.score_lines(scores), f"{base}/eval.txt")
        corpus.write_summary(evaluate.error_summary(segmented, gold), f"{base}/summary.json")
    finally:
        segmented.unpersist()
    corpus.write_text(spark, [f"{time.time() - start:.1f} s"], f"{base}/log.txt")
    return scores


def run_jobs(spark: SparkSession, text: str, segmenters: dict, out: str, at_once: int = 4) -> dict[str, Outcome]:
    """The outcome of every job of a file, ``at_once`` of them at a time.

    Each job has a thread, a job group and a scheduler pool of its own name, so that with spark.scheduler.mode FAIR they share the cluster and
    one can be cancelled by its name. A job that fails leaves its error in its outcome and in ``error.txt`` of its folder; the others go on.
    """
    context = spark.sparkContext

    def one(job: Job) -> Outcome:
        context.setLocalProperty("spark.scheduler.pool", job.name)
        context.setJobGroup(job.name, f"job {job.name}: {job.command}", interruptOnCancel=True)
        began = time.monotonic()
        try:
            return Outcome(run_job(spark, job, segmenters, out), None, began, time.monotonic())
        except Exception as error:  # noqa: BLE001  the other jobs go on
            context.cancelJobGroup(job.name)
            corpus.write_text(spark, str(error).splitlines()[:1], f"{out}/{job.name}/error.txt")
            return Outcome(None, error, began, time.monotonic())

    todo = read_jobs(text, set(segmenters), there(spark))
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        waiting = {job.name: pool.submit(inheritable_thread_target(one), job) for job in todo}
        return {name: result.result() for name, result in waiting.items()}
