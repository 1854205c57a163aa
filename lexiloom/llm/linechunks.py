"""Line deduplication over content-defined chunks.

A rolling hash over the hashes of ``window`` consecutive lines marks lines by each of its top ``BITS`` bits, being 0 in one way of cutting
and 1 in another. A chunk reaches from one marked window to the next of the same way, both included, so where it begins and ends depends on
its own lines alone, however many lines stand before it. Of all ways only the shortest chunk that begins at a line and the shortest
that ends at it count: what a longer one covers, shorter ones cover too. The first and the last two lines of a text are chunks besides, so that whole copies go whole.

With a window of one line (the default) a repeated run of n lines is found but for lines that differ from all others of the run in every
bit: one in ``2 ** (BITS * (n - 1))``. A wider window needs runs of two windows, one line more each.

Chunks have two lines or more. Of equal ones, in a later document or later in the same one, only the first stays. They are judged on the
texts as given, overlaps count, so of a line that repeats itself without end one is left.

* Digests of all chunks, rolled over their lines' hashes, are counted; a digest's counts are added up in each task first. Most chunks are unlike all others and end here.
* Those that occur again are fetched from their texts and meet by digest, and their bytes are compared in sorted order with one chunk held. Of
  equal chunks that a task fetches at once only the first meets others; its copies are repeats already.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches, numbered, release, written

#: Lines in the rolling window, bits of its hash that mark lines, bytes of chunks that a task holds at once.
WINDOW, BITS, HELD_BYTES = 1, 6, 48 << 20
_BASE, _SPREAD, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def rolled(hashes: list[int], window: int) -> list[int]:
    """The rolling hash of the ``window`` lines that begin at each line."""
    out, roll, drop = [], 0, pow(_BASE, window, 1 << 64)
    for i, h in enumerate(hashes):
        roll = (roll * _BASE + h - (hashes[i - window] * drop if i >= window else 0)) & _MASK
        if i >= window - 1:
            out.append((roll * _SPREAD & _MASK) >> (64 - BITS))
    return out


def chunks(hashes: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk, from the lines' hashes."""
    if len(hashes) < 2:
        return []
    marks, none = rolled(hashes, window), (1 << BITS) - 1
    found = {(0, 2), (len(hashes) - 2, 2)}
    for step, order in ((1, range(len(marks))), (-1, range(len(marks) - 1, -1, -1))):
        for i in order:
            j = i + step
            # lines passed over are alike in all bits, so they pass over none themselves
            while 0 <= j < len(marks) and marks[i] ^ marks[j] == none:
                j += step
            if 0 <= j < len(marks):
                found.add((min(i, j), abs(i - j) + window))
    return sorted(found)


def lines_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def marked(lines: list[bytes], window: int):
    """(digest, first, lines) of the chunks; digests are signed."""
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    for first, n in chunks(hashes, window):
        roll = n
        for h in hashes[first : first + n]:
            roll = (roll * _BASE + h) & _MASK
        yield (roll ^ roll >> 32) * _SPREAD % (1 << 64) - (1 << 63), first, n


def spread(batches, window: int = WINDOW):
    """Rows (digest, rid, n): the chunks' digests of each text, and how often it has them."""
    for pdf in batches:
        rows = [(d, rid, n) for rid, text in zip(pdf["rid"].tolist(), pdf["text"], strict=True) for d, n in Counter(d for d, *_ in marked(lines_of(text), window)).items()]
        if rows:
            yield pd.DataFrame(rows, columns=["digest", "rid", "n"])


def fetch(batches, window: int = WINDOW):
    """Rows (digest, rid, first, lines, chunk) of the wanted chunks; chunk is null where an equal one that was fetched with it stands earlier."""
    names = ["digest", "rid", "first", "lines", "chunk"]

    def flush(rows):
        rows.sort(key=lambda r: r[:3])
        out, digest, data = [], None, None
        for row in rows:
            if row[0] == digest and row[4] == data:  # nothing is left to compare it with, so it goes anywhere
                out.append(((row[1] * _BASE + row[2]) % (1 << 63), *row[1:4], None))
            else:
                digest, data = row[0], row[4]
                out.append(row)
            if len(out) >= 1 << 13:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    rows, size = [], 0
    for pdf in batches:
        for rid, text, wanted in zip(pdf["rid"].tolist(), pdf["text"], pdf["wanted"], strict=True):
            wanted, lines = set(wanted.tolist()), lines_of(text)
            for digest, first, n in marked(lines, window):
                if digest in wanted:
                    data = b"\n".join(lines[first : first + n])
                    rows.append((digest, rid, first, n, data))
                    size += len(data)
            if size > HELD_BYTES:
                yield from flush(rows)
                rows, size = [], 0
    yield from flush(rows)


def repeated(batches):
    """(rid, first, lines) of the chunks that stand earlier, from rows sorted by digest and place."""
    digest, known = None, []
    for pdf in batches:
        rows = []
        for d, rid, first, n, data in zip(pdf["digest"].tolist(), pdf["rid"].tolist(), pdf["first"].tolist(), pdf["lines"].tolist(), pdf["chunk"], strict=True):
            if data is None:
                rows.append((rid, first, n))
                continue
            if d != digest:
                digest, known = d, []
            if data in known:
                rows.append((rid, first, n))
            else:
                known.append(data)
        if rows:
            yield pd.DataFrame(rows, columns=["rid", "first", "lines"])


def remove_repeated_lines(docs: DataFrame, keep_text: bool = True, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_lines, n_chunks, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text); with ``keep_text`` also text, what stays.

    n_chunks counts the chunks that were looked for, n_removed the lines in those removed. Lines end at LF only. Null and empty
    texts have no lines; a text whose lines are all removed is empty. Documents come in order of doc_id, null last; rows that share a
    doc_id in order of a hash of the text, wholly equal rows in any, of which one counts as first. A very long text is held by one task as
    its lines and those chunks that repeat, a few times its size. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    lean_batches(docs.sparkSession)
    docs = numbered(docs.select("doc_id", "text"))
    digests = written(docs.select("rid", "text").mapInPandas(lambda batches: spread(batches, window), "digest long, rid long, n long"), "chunk-digests")
    again = written(digests.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest"), "chunks-again")
    wanted = digests.join(again, "digest").groupBy("rid").agg(F.collect_list("digest").alias("wanted"))
    rows = docs.select("rid", "text").join(wanted.hint("merge"), "rid").mapInPandas(lambda batches: fetch(batches, window), "digest long, rid long, first long, lines long, chunk binary")
    rows = rows.repartition("digest").sortWithinPartitions("digest", "rid", "first")
    found = written(rows.mapInPandas(repeated, "rid long, first long, lines long"), "repeated-chunks")
    release(docs)
    cuts = found.groupBy("rid").agg(F.collect_list(F.struct("first", "lines")).alias("cuts"))
    kind = "doc_id long, n_lines long, n_chunks long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    names = [c.split()[0] for c in kind.split(", ")]

    def finish(batches):
        for pdf in batches:
            out = []
            for doc_id, text, own in zip(pdf["doc_id"], pdf["text"], pdf["cuts"], strict=True):
                lines = lines_of(text)
                gone = {i for c in (own if own is not None else ()) for i in range(c["first"], c["first"] + c["lines"])}
                rest = b"\n".join(line for i, line in enumerate(lines) if i not in gone)
                out.append((doc_id, len(lines), len(chunks([xxhash.xxh3_64_intdigest(line) for line in lines], window)), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "surrogatepass"))[: len(names)])
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    # always a shuffled join: the runs grow with the corpus, so they are never broadcast
    return docs.join(cuts.hint("merge"), "rid", "left").select("doc_id", "text", "cuts").mapInPandas(finish, kind)
