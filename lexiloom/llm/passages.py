"""Exact removal of repeated passages by prefix-free parsing.

A passage is a string of ``LENGTH`` bytes. A rolling hash over ``TRIGGER`` bytes sets triggers: in every passage the leftmost
least hash. So a trigger is fixed by the passage alone, each passage has one, and equal passages have it at the same place. The
triggers cut a text into phrases; a phrase with the bytes that its passages reach is long enough that none is a prefix
of another with the same trigger, and equal phrases hold equal passages.

* Parse: each phrase becomes a row (trigger hash, phrase digest, document, place). Inside a task all but the first of
  equal phrases are repeats already: they are dealt out evenly, and only the first one meets those of other tasks.
* Dictionary: rows meet by trigger and are read in sorted order with constant memory. All but the first row of a phrase
  are repeats. A trigger with one distinct phrase is settled there: most of the corpus ends here.
* Suffixes: where distinct phrases share a trigger, the first occurrence of each is fetched from its text. A suffix array of these
  phrases, built to the depth of a passage, ranks all their passages exactly; among passages of one rank and one distance from the trigger,
  all but the first in corpus order are repeats. Triggers with over ``CROWD`` distinct phrases are dealt out passage by passage, and
  passages are read in sorted order with one held.

Repeats come back to their documents as runs of passage starts, the union of the covered bytes is cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_join, lean_batches, numbered, release, written

LENGTH = 100
TRIGGER = 32
REACH = LENGTH - TRIGGER + 1
#: Bytes that are parsed at once, rows that a task compares at once, distinct phrases of a trigger that meet in one task.
SLICE, ROWS, CROWD = 1 << 20, 1 << 19, 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all runs of ``size`` values (a power of two) by doubling."""
    factor, width = _BASE, 1
    with np.errstate(over="ignore"):
        while width < size:
            values = values[:-width] * factor + values[width:]
            factor, width = factor * factor, 2 * width
    return values


def least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    width = 1
    while 2 * width <= size:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def phrases(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, first, last, trigger, hash, digest) of the phrases of the parts [starts, ends) of a buffer, which have LENGTH bytes at least.

    first and last are the starts of the passages that the trigger owns; places count from the start of the buffer.
    """
    h = rolling(_BYTES[np.frombuffer(buffer, dtype=np.uint8)], TRIGGER)
    low = least(h, REACH)
    turn = np.ones(len(low), dtype=bool)
    turn[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
    turn[starts] = True
    first = np.flatnonzero(turn)
    after = np.append(first[1:], len(low))
    part = np.searchsorted(starts, first, side="right") - 1
    bound = ends[part] - LENGTH
    keep = first <= bound
    first, part, last = first[keep], part[keep], np.minimum(after - 1, bound)[keep]
    trigger = np.empty(len(first), dtype=np.int64)
    reach = np.arange(REACH)
    for i in range(0, len(first), 1 << 15):
        at = first[i : i + (1 << 15)]
        trigger[i : i + (1 << 15)] = at + np.argmin(h[at[:, None] + reach], axis=1)
    digest = xxhash.xxh3_64_intdigest
    digests = np.array([digest(buffer[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)
    return part, first, last, trigger, low[first].view(np.int64), digests.view(np.int64)


def slices(rids, texts):
    """Batches of (rid, offset, bytes) of about SLICE bytes; a long text is cut with LENGTH - 1 bytes of overlap."""
    held, size = [], 0
    for rid, text in zip(rids, texts, strict=True):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data) - LENGTH + 1, 0), SLICE):
            piece = data[at : at + SLICE + LENGTH - 1]
            held.append((rid, at, piece))
            size += len(piece)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def packed(trigger: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return trigger << 14 | (trigger - first) << 7 | (trigger - last)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    trigger = place >> 14
    return trigger, trigger - (place >> 7 & 127), trigger - (place & 127)


def parse(batches):
    """Rows (h, d, rid, place); a negative place marks what is a repeat already."""
    columns = ["h", "d", "rid", "place"]

    def flush(held):
        h, d, rid, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, rid, d, h))
        h, d, rid, place = h[order], d[order], rid[order], place[order]
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        place = np.where(again, ~place, place)
        with np.errstate(over="ignore"):  # nothing is left to compare them with, so they go anywhere
            h = np.where(again, (rid * 0x9E3779B1 + place) * 0x85EBCA77, h)
        for i in range(0, len(h), 1 << 17):
            yield pd.DataFrame(dict(zip(columns, (x[i : i + (1 << 17)] for x in (h, d, rid, place)), strict=True)))

    held, size = [], 0
    for pdf in batches:
        for pieces in slices(pdf["rid"].to_numpy(), pdf["text"]):
            ends = np.cumsum([len(b) for _, _, b in pieces])
            starts = np.append(0, ends[:-1])
            part, first, last, trigger, h, d = phrases(b"".join(b for _, _, b in pieces), starts, ends)
            shift = np.array([at for _, at, _ in pieces], dtype=np.int64)[part] - starts[part]
            rid = np.array([r for r, _, _ in pieces], dtype=np.int64)[part]
            held.append((h, d, rid, packed(trigger + shift, first + shift, last + shift)))
            size += len(h)
            if size >= ROWS:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def settle(batches):
    """From rows sorted by (h, d, rid, place): (h, rid, place) with place < 0 for repeats, else the first of a phrase whose trigger has others."""
    before = None  # (h, d) of the row before, and its first row if it is the only phrase of its trigger so far
    alone = None
    for pdf in batches:
        if not len(pdf):
            continue
        h, d, rid, place = (pdf[c].to_numpy() for c in ("h", "d", "rid", "place"))
        known = place < 0
        if known.any():
            yield pd.DataFrame({"h": h[known], "rid": rid[known], "place": place[known]})
            h, d, rid, place = h[~known], d[~known], rid[~known], place[~known]
        if not len(h):
            continue
        new_h = np.empty(len(h), dtype=bool)
        new_d = np.empty(len(h), dtype=bool)
        new_h[1:] = h[1:] != h[:-1]
        new_d[1:] = new_h[1:] | (d[1:] != d[:-1])
        new_h[0] = before is None or before[0] != h[0]
        new_d[0] = new_h[0] or before[1] != d[0]
        at = np.flatnonzero(new_d)
        # a phrase is crowded if the phrase before or after it has the same trigger
        shares = np.zeros(len(at), dtype=bool)
        shares[:] = ~new_h[at]
        shares[:-1] |= ~new_h[at[1:]]
        if len(at) and not new_h[at[0]] and alone is not None:
            yield pd.DataFrame({"h": [alone[0]], "rid": [alone[1]], "place": [alone[2]]})
            alone = None
        repeats = ~new_d
        if repeats.any():
            yield pd.DataFrame({"h": h[repeats], "rid": rid[repeats], "place": ~place[repeats]})
        if shares.any():
            of = at[shares]
            yield pd.DataFrame({"h": h[of], "rid": rid[of], "place": place[of]})
        if len(at):
            alone = None if shares[-1] else (h[at[-1]], rid[at[-1]], place[at[-1]])
        before = (h[-1], d[-1])


def fetch(batches):
    """The bytes of phrases: (h, sub, rid, first, trigger, last, bytes); of crowded triggers passage by passage."""
    names = ["h", "sub", "rid", "first", "trigger", "last", "bytes"]
    rows = []
    for pdf in batches:
        for rid, text, wanted in zip(pdf["rid"], pdf["text"], pdf["wanted"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                trigger, first, last = (int(x) for x in unpacked(w["place"]))
                if not w["crowded"]:
                    rows.append((w["h"], 0, rid, first, trigger, last, data[first : last + LENGTH]))
                    continue
                for s in range(first, last + 1):
                    own = data[s : s + LENGTH]
                    rows.append((w["h"], xxhash.xxh3_64_intdigest(own, trigger - s) >> 1 | 1, rid, s, trigger, s, own))
            if len(rows) >= 1 << 15:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def suffix_ranks(buffer: bytes) -> np.ndarray:
    """Rank of the LENGTH bytes from each place of a buffer in the order of all, equal where the bytes are: its suffix array to that depth.

    Eight bytes are one number; doubling ranks pairs of ranks until 64 bytes, and two overlapping runs of 64 cover LENGTH.
    """
    x = np.frombuffer(buffer + bytes(8), dtype=np.uint8)
    n = len(x) - 8
    words = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | x[i : i + n]
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    for step in (8, 16, 32, LENGTH - 64):
        later = np.zeros(n, dtype=np.int64)
        later[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
    return rank


def repeats_among(group: np.ndarray, rid: np.ndarray, first: np.ndarray, trigger: np.ndarray, last: np.ndarray, data: list[bytes]) -> pd.DataFrame:
    """(rid, first, last): runs of passages that stand earlier in the same group, at the same distance from the trigger.

    The suffix order of the phrases, within their trigger and distance from it, puts equal passages side by side; ties stand in corpus order.
    """
    rank = suffix_ranks(b"".join(data))
    count = last - first + 1
    row = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = rank[np.cumsum([0, *map(len, data[:-1])])[row] + j]
    start = first[row] + j
    aligned = group[row] * 128 + trigger[row] - start
    order = np.lexsort((start, rid[row], place, aligned))
    row, place, start, aligned = row[order], place[order], start[order], aligned[order]
    good = np.zeros(len(row), dtype=bool)
    good[1:] = (place[1:] == place[:-1]) & (aligned[1:] == aligned[:-1])
    row, start = row[good], start[good]
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    if not len(row):
        return pd.DataFrame({"rid": [], "first": [], "last": []}, dtype="int64")
    edge = np.ones(len(row), dtype=bool)
    edge[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(row)) - 1
    return pd.DataFrame({"rid": rid[row[begin]], "first": start[begin], "last": start[end]})


def compare(batches):
    """Repeats among the phrases of each (h, sub); rows come sorted by (h, sub, bytes, rid, first).

    Rows with a sub are single passages: all but the first with the same bytes are repeats, so that one row is held, however many there are.
    """
    held, passed = [], None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, sub = frame["h"].to_numpy(), frame["sub"].to_numpy()
        group = np.zeros(len(h), dtype=np.int64)
        group[1:] = np.cumsum((h[1:] != h[:-1]) | (sub[1:] != sub[:-1]))
        return repeats_among(group, *(frame[c].to_numpy() for c in ("rid", "first", "trigger", "last")), list(frame["bytes"]))

    size = 0
    for pdf in batches:
        single = pdf["sub"].to_numpy() != 0
        if single.any():
            rows = pdf[single]
            key = list(zip(rows["h"], rows["sub"], rows["bytes"], strict=True))
            again = [k == before for k, before in zip(key, [passed, *key], strict=False)]
            passed = key[-1]
            if any(again):
                yield rows.loc[again, ["rid", "first", "last"]]
            pdf = pdf[~single]
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < 1 << 14:
            continue
        frame = pd.concat(held, ignore_index=True)
        tail = (frame["h"] == frame["h"].iloc[-1]) & (frame["sub"] == frame["sub"].iloc[-1])
        if not tail.all():
            yield run(frame[~tail].reset_index(drop=True))
            frame = frame[tail].reset_index(drop=True)
        held, size = [frame], 0 if tail.all() else len(frame)
    if held and (frame := pd.concat(held, ignore_index=True)) is not None and len(frame):
        yield run(frame)


def cut(text: str | None, runs) -> tuple[int, int, int, str, bytes]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest, the rest) of a text without the passages that start in ``runs``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kept, done, removed, spans, reached = [], 0, 0, 0, -1
    for first, last in sorted(runs):
        end = last + LENGTH
        if first > reached:
            spans += 1
            kept.append(data[done:first])
            removed += end - first
        elif end > reached:
            removed += end - reached
        reached = max(reached, end)
        done = reached
    kept.append(data[done:])
    rest = b"".join(kept)
    return len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(rid, first, last), written: runs of starts of passages that stand earlier; ``docs`` has rid and text."""
    rows = docs.select("rid", "text").mapInPandas(parse, "h long, d long, rid long, place long")
    rows = rows.repartition("h").sortWithinPartitions("h", "d", "rid", "place")
    settled = written(rows.mapInPandas(settle, "h long, rid long, place long"), "settled")
    release(docs)
    open_ = settled.filter("place >= 0")
    crowded = written(open_.groupBy("h").count().filter(F.col("count") > CROWD).select("h", F.lit(True).alias("crowded")), "crowded")
    wanted = bounded_join(open_, crowded, ["h"]).withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "place", "crowded")).alias("wanted"))
    bytes_ = docs.select("rid", "text").join(wanted, "rid").mapInPandas(fetch, "h long, sub long, rid long, first long, trigger long, last long, bytes binary")
    found = written(bytes_.repartition("h", "sub").sortWithinPartitions("h", "sub", "bytes", "rid", "first").mapInPandas(compare, "rid long, first long, last long"), "found")
    release(docs)
    place = F.bitwise_not("place")
    at = F.shiftright(place, 14)
    known = settled.filter("place < 0").select("rid", (at - F.shiftright(place, 7).bitwiseAND(127)).alias("first"), (at - place.bitwiseAND(127)).alias("last"))
    return known.unionByName(found)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text); with ``keep_text`` also kept, the rest as binary.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document of smaller doc_id, or earlier in
    the same one. Strings are judged on the input and never cross documents. Null texts count as empty, and texts under 100 bytes
    stay. Null doc_ids come last; rows that share a doc_id are ordered by a hash of the text, and of wholly equal rows one counts as first.
    An empty table gives an empty result. Other columns are ignored. Phrases count as equal by 64 bits of trigger hash and 64 bits
    of digest; passages of distinct phrases are ranked by their bytes.
    """
    lean_batches(docs.sparkSession)
    docs = numbered(docs.select("doc_id", "text"))
    runs = repeated_runs(docs).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = [c.split()[0] for c in kind.split(", ")]

    def finish(batches):
        for pdf in batches:
            out = []
            for doc_id, text, own in zip(pdf["doc_id"], pdf["text"], pdf["runs"], strict=True):
                n, removed, spans, sha, rest = cut(text, [(r["first"], r["last"]) for r in own] if own is not None else [])
                out.append((doc_id, n, removed, spans, sha, rest)[: len(names)])
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return docs.join(runs, "rid", "left").select("doc_id", "text", "runs").mapInPandas(finish, kind)
