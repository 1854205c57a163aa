"""Two tokenizers' tokens of the same text, aligned in minimal groups, and counts of the id pairs that overlap.

Both tokenizers cut before a single space between two characters that are no white space, so a text falls into pieces that are encoded
and aligned apart; a worker aligns each different piece once and keeps what it found, up to ``HELD`` characters. Within a piece the
tokens are the nodes of a bipartite graph, two of them linked if their bytes overlap, and union-find (arrays: hook roots, halve paths)
gives its components: exactly the minimal groups. The members of a component are expanded into its links. Pairs are counted by one
distributed aggregate; the counts meet the documents' pairs in a join that is a broadcast only below ``PAIRS`` counted rows.
Each text is encoded once; its distinct pairs are a written table.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_join, free_names, lean_batches, written

#: Characters of pieces whose alignment a worker keeps, and of text that it aligns at once.
HELD, BLOCK = 5_000_000, 2_000_000

#: Distinct id pairs that may be broadcast: 16 bytes each.
PAIRS = 1_000_000

#: What counts as white space here, in any version of Unicode: a larger set only makes longer pieces.
SPACE = r"\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2028-\u202f\u2060\ufeff"
BOUNDARY = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
CLEAN = re.compile(f"(?s:[^{SPACE}](?:.*[^{SPACE}])?)")

#: Characters whose classes all versions of Unicode agree on.
PLAIN = re.compile(r"[\n\x20-\x7e\u00a1-\u024f]*")

#: The pattern that splits texts before byte-level merges (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level BPE in the tokenizers library's JSON."""

    def __init__(self, data: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data.decode())
        self.model.encode_special_tokens = True
        about, of = json.loads(data), byte_characters()
        vocabulary = about["model"]["vocab"]
        self.bytes = [b""] * (1 + max(*vocabulary.values(), *(t["id"] for t in about["added_tokens"]), 0))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in token) if set(token) <= of.keys() else token.encode()
        before = about["pre_tokenizer"] or {}
        self.splits = about["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        # ranks merge as the list of merges does if merged tokens are numbered in its order; special tokens are none of them
        special = {t["content"] for t in about["added_tokens"]}
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in about["model"]["merges"]]
        self.fast = None
        if self.splits and made == sorted(made) and {bytes([b]) for b in range(256)} <= set(self.bytes):
            ranks = {self.bytes[i]: i for token, i in vocabulary.items() if token not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of " " + piece for each piece."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.fast and len(p) <= 256 and PLAIN.fullmatch(p)]
        for i in plain:
            out[i] = self.fast.encode_ordinary(" " + pieces[i])
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.model.encode_batch_fast([" " + pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out


class PieceVocabulary:
    """A sentencepiece model."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # a model that changes white space, or has pieces beyond a space, sees texts whole
        self.splits = not any(re.search("[^▁]▁", p) for p in names) and self.model.decode(self.model.encode("  a  b ")) == "  a  b "

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; the model puts a space before it."""
        return self.model.encode(pieces, num_threads=1)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links (u, v) over nodes 0 to n - 1: union-find over arrays."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) whose byte ranges overlap, for two cuts of the same bytes given by the tokens' ends."""
    starts_a, starts_b = np.concatenate([[0], ends_a])[:-1], np.concatenate([[0], ends_b])[:-1]
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    many = last - first
    a = np.repeat(np.arange(len(ends_a)), many)
    return a, np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


class Aligner:
    """Aligns pieces and remembers them; ``size_b`` codes a pair of ids as one number."""

    def __init__(self, a: bytes, b: bytes) -> None:
        self.a, self.b = ByteVocabulary(a), PieceVocabulary(b)
        self.splits = self.a.splits and self.b.splits
        self.lengths = [np.array([len(x) for x in v.bytes]) for v in (self.a, self.b)]
        self.size_b = len(self.b.bytes)
        self.names = [[str(i) for i in range(len(v.bytes))] for v in (self.a, self.b)]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.sound = np.zeros(0, dtype=bool)
        self.numbers = np.zeros((0, 4), dtype=np.int64)
        self.firsts, self.codes = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.held, self.kept, self.late = 0, 0, []

    def rough(self, text: str) -> list[str]:
        """The pieces of " " + text where a cut at all spaces isn't right, each without the space before it.

        A piece that starts or ends in white space has a space of its own before it, so that it is never taken for one of a cut at all spaces.
        """
        return [p if CLEAN.fullmatch(p) else " " + p for p in (BOUNDARY.split(text) if self.splits else [text])]

    def known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of the piece) for all pieces of ``texts``, none for an empty one; pieces not met before are aligned."""
        parts = [t.split(" ") if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        many = np.array([len(own) for own in parts], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), many)
        found = np.fromiter(map(self.at.get, flat, itertools.repeat(-1)), dtype=np.int64, count=len(flat))
        late = np.flatnonzero(found < 0)
        odd = {i for i, k in zip(text[late].tolist(), late.tolist(), strict=True) if not (self.splits and CLEAN.fullmatch(flat[k]))}
        keys = {i: self.rough(texts[i]) for i in sorted(odd)}
        late = late[~np.isin(text[late], sorted(odd))]
        if len(late) > len(flat) // 2 and len(self.at) > len(late):
            self.forget()  # other texts than before: learn theirs
            return self.known(texts)
        new = dict.fromkeys(itertools.chain((flat[k] for k in late.tolist()), (k for own in keys.values() for k in own)))
        if new := [k for k in new if k not in self.at]:
            self.learn(new)
        found[late] = [self.at[flat[k]] for k in late.tolist()]
        if odd:
            own = np.split(found, np.cumsum(many)[:-1])
            for i, k in keys.items():
                own[i] = np.array([self.at[x] for x in k], dtype=np.int64)
            found, text = np.concatenate(own), np.repeat(np.arange(len(texts)), [len(x) for x in own])
        return text, found

    def learn(self, keys: list[str]) -> None:
        """Align the pieces ``keys``, none of which is known."""
        new = [k.removeprefix(" ") for k in keys]
        found = [v.encode(new) for v in (self.a, self.b)]
        sound = [True] * len(new)
        for v, ids in zip((self.a, self.b), found, strict=True):
            if b"".join(map(v.bytes.__getitem__, itertools.chain.from_iterable(ids))) != " ".join(["", *new]).encode():
                sound = [ok and b"".join(map(v.bytes.__getitem__, own)) == (" " + p).encode() for ok, own, p in zip(sound, ids, new, strict=True)]
        kept = [[ids if ok else [] for ids, ok in zip(own, sound, strict=True)] for own in found]
        counts = [np.array([len(x) for x in own], dtype=np.int64) for own in kept]
        ids = [np.fromiter((i for x in own for i in x), dtype=np.int64, count=int(n.sum())) for own, n in zip(kept, counts, strict=True)]
        ends = [np.cumsum(lengths[own]) for lengths, own in zip(self.lengths, ids, strict=True)]
        u, v = links(*ends)
        label = components(len(ids[0]) + len(ids[1]), u, v + len(ids[0]))
        sides = [label[: len(ids[0])], label[len(ids[0]) :]]
        cuts = [np.concatenate([np.flatnonzero(np.diff(x, prepend=-1)), [len(x)]]).tolist() for x in sides]
        words = [[names[i] for i in own.tolist()] for names, own in zip(self.names, ids, strict=True)]
        shown = [",".join(words[0][i:j]) + "|" + ",".join(words[1][k:m]) for i, j, k, m in zip(cuts[0][:-1], cuts[0][1:], cuts[1][:-1], cuts[1][1:], strict=True)]
        tops = np.concatenate([[0], np.cumsum(counts[0])])
        group = np.searchsorted(np.array(cuts[0]), tops)  # the first group of each piece
        pair = np.searchsorted(u, tops)
        self.groups += [";".join(shown[i:j]) for i, j in zip(group[:-1].tolist(), group[1:].tolist(), strict=True)]
        self.sound = np.concatenate([self.sound, np.array(sound, dtype=bool)])
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.numbers = np.concatenate([self.numbers, np.stack([*counts, np.diff(group), np.diff(pair)], axis=1)])
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + pair[1:]])
        self.codes = np.concatenate([self.codes, ids[0][u] * self.size_b + ids[1][v]])
        size = sum(map(len, new))
        if self.held + size <= HELD:
            self.held, self.kept = self.held + size, len(self.at)
        else:
            self.late += keys

    def trim(self) -> None:
        """Drop what was learned beyond ``HELD`` characters; what was met first stays, and with it most of what is frequent."""
        for key in self.late:
            del self.at[key]
        self.late = []
        del self.groups[self.kept :]
        self.sound, self.numbers, self.firsts = self.sound[: self.kept], self.numbers[: self.kept], self.firsts[: self.kept + 1]
        self.codes = self.codes[: self.firsts[-1]]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links of each text; its groups; and (text, pair code, times) of the pairs, in order."""
        text, flat = self.known(texts)
        lost = np.zeros(len(texts), dtype=bool)
        lost[text[~self.sound[flat]]] = True
        text, flat = text[~lost[text]], flat[~lost[text]]
        ends = np.searchsorted(text, np.arange(len(texts)), "right").tolist()
        shown = list(map(self.groups.__getitem__, flat.tolist()))
        numbers = np.zeros((len(texts), 4), dtype=np.int64)
        for k in range(4):
            numbers[:, k] = np.bincount(text, weights=self.numbers[flat, k], minlength=len(texts))
        many = self.numbers[flat, 3]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.firsts[flat], many)
        size = len(self.a.bytes) * self.size_b
        keys, times = np.unique(np.repeat(text, many) * size + self.codes[at], return_counts=True)
        self.trim()
        return numbers, [";".join(shown[i:j]) for i, j in zip([0, *ends], ends, strict=False)], keys // size, keys % size, times


ENCODED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_own: dict[str, Aligner] = {}


def encode(docs: DataFrame, a_file: str, b_file: str, keep_groups: bool = False) -> DataFrame:
    """``docs`` without text, plus n_a to groups_sha256, the distinct ``pairs`` (a * vocabulary of B + b) of each row and their ``times``.

    The files are read once, by the driver, and sent to the executors: they are vocabularies of fixed size.
    """
    lean_batches(docs.sparkSession)
    models = tuple(open(f, "rb").read() for f in (a_file, b_file))
    name, held = hashlib.sha256(b"".join(models)).hexdigest(), docs.sparkSession.sparkContext.broadcast(models)
    docs = docs.drop("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times")
    carried = [c for c in docs.columns if c.lower() != "text"]
    shape = docs.select(*carried).limit(0)
    fields = ENCODED + ", groups string" * keep_groups + ", pairs array<long>, times array<int>"

    def aligned(batches):
        if name not in _own:  # a reused worker keeps its tables
            _own.clear()
            _own[name] = Aligner(*held.value)
        own = _own[name]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            starts, size = [0], 0
            for i, t in enumerate(texts):
                if size and size + len(t) > BLOCK:
                    starts, size = [*starts, i], 0
                size += len(t)
            for i, j in zip(starts, [*starts[1:], len(texts)], strict=True):
                numbers, groups, text, codes, times = own.texts(texts[i:j])
                offsets = pa.array(np.searchsorted(text, np.arange(j - i + 1)), pa.int32())
                out = [*batch.columns[:-1]]
                out = [c.slice(i, j - i) for c in out] + [pa.array(numbers[:, k]) for k in range(4)]
                out.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()))
                out += [pa.array(groups, pa.string())] if keep_groups else []
                out += [pa.ListArray.from_arrays(offsets, pa.array(codes)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = shape.schema
    for f in docs.sparkSession.createDataFrame([], fields).schema:
        schema = schema.add(f)
    names = schema.fieldNames()
    return docs.select(*carried, "text").mapInArrow(aligned, schema)


def pair_counts(encoded: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links of all rows hold each pair of ids, and whether no pair with its B id has more."""
    each = encoded.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    each = written(each, "pair-counts").withColumn("b_id", F.col("pair") % size_b)
    most = each.groupBy("b_id").agg(F.max("n").alias("most"))  # a row for each entry of a vocabulary
    return bounded_join(each, most, ["b_id"], "inner").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def vocabulary_size(b_file: str) -> int:
    return len(PieceVocabulary(open(b_file, "rb").read()).bytes)


def align(docs: DataFrame, a_file: str, b_file: str, keep_groups: bool = False, most_pairs: int = PAIRS) -> DataFrame:
    """``docs`` without text, plus n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (with ``keep_groups`` also groups).

    Null and empty texts, and those whose joined token bytes differ from a space and the text, have no tokens: zeros and ''. Repeated rows
    and null ids stay, each a row of its own. A very long text without a splitting space is one piece, in about sixty times its
    size. Columns named like results are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_best", "count_sum")
    row, n_best, count_sum = free_names(docs, "row", "best_", "sum_")
    encoded = written(encode(docs.withColumn(row, F.monotonically_increasing_id()), a_file, b_file, keep_groups), "aligned")
    counts = written(pair_counts(encoded, vocabulary_size(b_file)), "pair-best")
    each = encoded.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = bounded_join(each, counts, ["pair"], "inner", most_pairs)
    sums = met.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias(n_best), F.sum(F.col("times") * F.col("n")).alias(count_sum))
    out = encoded.drop("pairs", "times").join(sums, row, "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.withColumns({"n_best": number(n_best), "count_sum": number(count_sum)}).drop(row, n_best, count_sum)
