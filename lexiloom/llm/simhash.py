"""SimHash near-duplicates by a Gray-order hierarchical index.

Texts become fingerprints of one or more 64-bit words. Equal fingerprints collapse first, so a group of copies is one
row from there on. Each word is cut into ``distance + 1`` blocks; fingerprints that differ in at most ``distance`` bits
agree in one block, so a shuffle by (block number, block value) brings all candidates together. Inside a partition the
fingerprints, rotated so that the block leads, are sorted by Gray rank: neighbours share long bit patterns. Runs of
``FAN`` are factored into nodes that keep the bits all members share (mask and value), runs of nodes into upper nodes.
The self-join walks pairs of nodes from the top and drops a pair of whole groups as soon as the shared bits of the two
differ in more bits than allowed.

What leaves a partition is a forest: each member with the root of its local component, never all pairs of a group.
Block values with over ``SPLIT`` fingerprints are dealt out as pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import bounded_join, free_names, lean_batches, written

FAN = 8
SPLIT = 1 << 17
HELD = 1 << 15
SLAB = 1 << 14
SEED = 42


def gram_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``shingle`` words; of a shorter text that has words, of all its words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower: A-Z only; bytes.split: space, tab, LF, VT, FF, CR
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < shingle:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*[tokens[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype=np.uint64)


def hashes_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """Big-endian bytes of the fingerprint. Word 0 takes the bits of the hashes, word i those of a remixed hash."""
    if not len(hashes):
        return bytes(8 * words)
    out = b""
    for i in range(words):
        h = hashes if i == 0 else remixed(hashes, i)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
        out += np.packbits(ones * 2 > len(h), bitorder="little").tobytes()[::-1]
    return out


def text_fingerprint(text: str | None, shingle: int, words: int) -> bytes:
    return hashes_fingerprint(gram_hashes(text, shingle), words)


def remixed(h: np.ndarray, i: int) -> np.ndarray:
    """A second hash from a first one: xor with a multiple of an odd constant, then two multiply-shift rounds."""
    x = h ^ np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """``docs`` plus ``fingerprint`` (binary, 8 bytes for each word); an own column of that name is replaced."""

    @F.pandas_udf("binary")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle, words) for t in texts], dtype=object)

    return docs.drop("fingerprint").withColumn("fingerprint", fingerprint(F.col("text")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over Gray-sorted codes: levels[0] are the codes, each node above keeps what FAN children share."""

    def __init__(self, codes: np.ndarray, key_bits: int) -> None:
        rank = gray_rank(codes)
        self.order = np.argsort(rank, kind="stable")
        codes = codes[self.order]
        key = rank[self.order] >> np.uint64(64 - key_bits)
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(codes, full, key, key)]
        all_, any_ = codes, codes
        while len(all_) > 1:
            starts = np.arange(0, len(all_), FAN)
            all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)
            _, _, low, high = self.levels[-1]
            self.levels.append((all_, ~(all_ ^ any_), low[starts], high[np.minimum(starts + FAN, len(high)) - 1]))

    def close_pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slabs of pairs (i < j, sorted positions) with one key whose codes differ in at most ``most`` bits."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        child = np.arange(FAN)
        while stack:
            level, a, b = stack.pop()
            if len(a) > SLAB:
                stack += [(level, a[i : i + SLAB], b[i : i + SLAB]) for i in range(0, len(a), SLAB)]
                continue
            if level == 0:
                keep = a < b
                if keep.any():
                    yield a[keep], b[keep]
                continue
            value, mask, low, high = self.levels[level - 1]
            x = np.repeat((a[:, None] * FAN + child), FAN, axis=1).ravel()
            y = np.tile((b[:, None] * FAN + child), (1, FAN)).ravel()
            keep = (x <= y) & (y < len(value))
            x, y = x[keep], y[keep]
            keep = high[x] >= low[y]
            x, y = x[keep], y[keep]
            keep = np.bitwise_count((value[x] ^ value[y]) & mask[x] & mask[y]) <= most
            if keep.any():
                stack.append((level - 1, x[keep], y[keep]))


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of pairs over an array of roots, flat before and after."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(start, bits) of each block, counted from the most significant bit."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(s, e - s) for s, e in zip(edges, edges[1:], strict=False)]


def dealt(prints: DataFrame, words: int, blocks: int, split: int = SPLIT) -> DataFrame:
    """The rows of ``prints`` (fingerprint, anything else) once for each block of the first ``words`` words, together with all that agree in it."""
    bounds = block_bounds(blocks)

    def keyed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            codes = np.frombuffer(b"".join(pdf["fingerprint"]), dtype=">u8").astype(np.uint64).reshape(len(pdf), -1)
            for t in range(words * blocks):
                start, bits = bounds[t % blocks]
                key = (codes[:, t // blocks] >> np.uint64(64 - start - bits)) & np.uint64((1 << bits) - 1)
                yield pdf.assign(table=np.full(len(pdf), t, dtype=np.int32), key=key.astype(np.int64))

    kind = ", ".join(f"{n} {t}" for n, t in prints.dtypes) + ", table int, key long"
    rows = written(prints.mapInPandas(keyed, kind), "blocks")
    crowded = rows.groupBy("table", "key").count().filter(F.col("count") > split)
    crowded = crowded.select("table", "key", F.ceil(F.col("count") / split).cast("int").alias("_chunks"))
    rows = bounded_join(rows, crowded, ["table", "key"]).withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("_chunks")).cast("int")
    rows = rows.withColumn("_chunk", chunk).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    rows = rows.select("table", "key", F.least("_chunk", "_other").alias("one"), F.greatest("_chunk", "_other").alias("other"), *prints.columns)
    return together(rows)


def together(rows: DataFrame) -> DataFrame:
    """``rows`` with those that meet in one task, in the order that ``runs`` needs."""
    return rows.repartition("table", "key", "one", "other").sortWithinPartitions("table", "one", "other", "key")


def runs(batches, most: int = HELD) -> Iterator[pd.DataFrame]:
    """Rows of one (table, one, other) from rows sorted by it and key: ``most`` rows or more, cut where the key changes, never inside a key."""
    held, size, last = [], 0, None
    for pdf in batches:
        if not len(pdf):
            continue
        meet = pdf[["table", "one", "other", "key"]].to_numpy(dtype=np.int64)
        before = np.vstack([meet[:1] if last is None else last, meet[:-1]])
        last = meet[-1:]
        group = np.flatnonzero((meet[:, :3] != before[:, :3]).any(axis=1))
        key = np.flatnonzero((meet != before).any(axis=1))
        done = 0
        for end in [*group.tolist(), len(pdf)]:
            while end - done + size > most:
                at = key[(k := np.searchsorted(key, done + max(most - size, 0))) : k + 1]
                if not len(at) or at[0] > end or (at[0] == done and not size):
                    break
                yield pd.concat([*held, pdf.iloc[done : at[0]]], ignore_index=True)
                held, size, done = [], 0, int(at[0])
            held.append(pdf.iloc[done:end])
            size, done = size + end - done, end
            if end < len(pdf):
                if size:
                    yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def buckets(batches, bounds: list[tuple[int, int]], most: int = HELD) -> Iterator[tuple[pd.DataFrame, GrayIndex, np.ndarray]]:
    """(rows, index, codes) of groups of rows that meet, rows and codes in the order of the index; a bounded number at a time."""
    for part in runs(batches, most):
        if len(part) < 2:
            continue
        t = int(part["table"].iloc[0])
        codes = np.frombuffer(b"".join(part["fingerprint"]), dtype=">u8").astype(np.uint64).reshape(len(part), -1)
        start, bits = bounds[t % len(bounds)]
        word = codes[:, t // len(bounds)]
        turned = (word << np.uint64(start)) | (word >> np.uint64(64 - start)) if start else word
        index = GrayIndex(turned, bits)
        yield part.iloc[index.order], index, codes[index.order]


def linked(prints: DataFrame, words: int, blocks: int, word_distance: int, distance: int) -> DataFrame:
    """(node, root) of the linked ones among distinct ``prints`` (fingerprint), nodes as lower-case hex.

    Two fingerprints link if some block agrees, that block's word differs in at most ``word_distance`` bits and all words
    together in at most ``distance``. With one word and ``blocks > distance`` those are exactly all pairs within
    ``distance``, as a block without a difference is left.
    """
    bounds = block_bounds(blocks)

    def forest(batches):
        for prints_, index, codes in buckets(batches, bounds):
            names = prints_["fingerprint"].to_numpy()
            root = np.arange(len(codes))
            for a, b in index.close_pairs(word_distance):
                keep = root[a] != root[b]
                if words > 1:
                    a, b = a[keep], b[keep]
                    keep = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1) <= distance
                if keep.any():
                    root = merge(root, a[keep], b[keep])
            own = np.flatnonzero(root != np.arange(len(root)))
            if len(own):
                yield pd.DataFrame({"a": [p.hex() for p in names[own]], "b": [p.hex() for p in names[root[own]]]})

    return components(dealt(prints, words, blocks).mapInPandas(forest, "a string, b string"))


def roots_of(made: DataFrame, words: int, blocks: int, word_distance: int, distance: int) -> DataFrame:
    """(fingerprint, _root) for each distinct fingerprint of ``made``: the same root for all that links join."""
    distinct = made.select("fingerprint").distinct().withColumn("node", F.lower(F.hex("fingerprint")))
    found = linked(made.select("fingerprint").distinct(), words, blocks, word_distance, distance)
    return distinct.join(found, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("_root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, words: int = 1, blocks: int = 5, word_distance: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links reach; links go between fingerprints, so rows with equal fingerprints are
    always together, those of texts without words (fingerprint 0) too. A null text counts as empty. Rows with a null doc_id
    are linked like others; component_id is null only if no row of the component has a doc_id. Repeated rows come back
    as often as they come. A very long text is held by one task as words and hashes, about thirty times its size. The result has no
    ties: all rows of a component get the same id. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    lean_batches(docs.sparkSession)
    made = written(fingerprints(docs.select("doc_id", "text"), shingle, words).drop("text"), "fingerprints")
    known = written(made.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")).join(roots_of(made, words, blocks, word_distance, distance), "fingerprint"), "roots")
    least = known.groupBy("_root").agg(F.min("_first").alias("component_id"))
    known = known.join(least, "_root").select("fingerprint", "component_id")
    return made.join(known, "fingerprint", "left").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


#: Five-word shingles; five words make the tables, three more sharpen the distance: of 512 bits, texts with a Jaccard of 0.8 differ in 78 on
#: average, with a deviation of 8.1.
SIMILAR = {"shingle": 5, "words": 5, "spare": 3, "blocks": 6, "word_distance": 24, "distance": 94}
JACCARD = 0.8
#: Rows with their sets of shingles that are held together, and beyond which a block value is dealt out; pairs that are compared at once, and the
#: 64-bit cells of the table of shared shingles that serves them.
HELD_SETS, SPLIT_SETS, PAIRS, CELLS = 1 << 12, 1 << 13, 1 << 14, 1 << 22


def tree_links(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(roots, a, b): the union of pairs as in ``merge``, and pairs that suffice for it, earlier ones first."""
    left, right = [], []
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        high, at = np.unique(np.maximum(ra, rb), return_index=True)
        root[high] = np.minimum(ra, rb)[at]
        left.append(a[at])
        right.append(b[at])
        while not np.array_equal(up := root[root], root):
            root = up
    none = np.zeros(0, dtype=np.int64)
    return root, np.concatenate([none, *left]), np.concatenate([none, *right])


def met_before(differ: np.ndarray, table: int, bounds: list[tuple[int, int]], word_distance: int) -> np.ndarray:
    """Whether pairs, given by the bits of all words in which they differ, meet in a table before ``table`` too."""
    out = np.zeros(len(differ), dtype=bool)
    for t in range(table):
        start, bits = bounds[t % len(bounds)]
        word = differ[:, t // len(bounds)]
        same = word >> np.uint64(64 - start - bits) & np.uint64((1 << bits) - 1) == 0
        out |= same & (np.bitwise_count(word) <= word_distance)
    return out


def near_pairs(rows: pd.DataFrame, index: GrayIndex, codes: np.ndarray, apart_yet, bounds: list[tuple[int, int]], word_distance: int, distance: int, jaccard: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, bits apart) of rows (n, table) that may be similar and for which ``apart_yet`` holds, each pair in the first table where it meets."""
    n, table = rows["n"].to_numpy(), int(rows["table"].iloc[0])
    for a, b in index.close_pairs(word_distance):
        keep = apart_yet(a, b) & (np.minimum(n[a], n[b]) >= jaccard * np.maximum(n[a], n[b]) - 1e-6)
        a, b = a[keep], b[keep]
        differ = codes[a] ^ codes[b]
        apart = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        keep = np.flatnonzero(apart <= distance)
        keep = keep[~met_before(differ[keep], table, bounds, word_distance)]
        if len(keep):
            yield a[keep], b[keep], apart[keep]


def joining(prints: DataFrame, words: int, blocks: int, word_distance: int, distance: int, jaccard: float) -> DataFrame:
    """(a, b), distinct and written: pairs of ``prints`` (node, n, fingerprint) that join all candidates of each block value, close ones first.

    n is the size of the set. A block value gives fewer pairs than it has nodes.
    """
    bounds = block_bounds(blocks)

    def pairs(batches):
        for rows, index, codes in buckets(batches, bounds):
            node, root = rows["node"].to_numpy(), np.arange(len(rows))
            for a, b, apart in near_pairs(rows, index, codes, lambda a, b: root[a] != root[b], bounds, word_distance, distance, jaccard):  # noqa: B023
                order = np.lexsort((np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), apart))
                root, a, b = tree_links(root, a[order], b[order])
                yield pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    return written(dealt(prints, words, blocks).mapInPandas(pairs, "a long, b long").distinct(), "candidates")


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets ``a`` and ``b`` of each pair have in common.

    Where few sets make many pairs, elements that several have become bits of a table; else each pair is compared by itself.
    """
    own, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < 8 * len(own):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own.tolist()])
    _, element, times = np.unique(np.concatenate([sets[k] for k in own.tolist()]), return_inverse=True, return_counts=True)
    common = times > 1
    wide = max(1, -(-int(common.sum()) // 64))
    if wide * len(own) > CELLS and len(a) > 1:
        half = len(a) // 2
        return np.concatenate([shared_counts(sets, a[:half], b[:half]), shared_counts(sets, a[half:], b[half:])])
    place = (np.cumsum(common) - 1)[element[common[element]]]
    bits = np.zeros((len(own), wide), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner[common[element]], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    x, y, some = at[: len(a)], at[len(a) :], max(1, CELLS // (4 * wide))
    return np.concatenate([np.bitwise_count(bits[x[i : i + some]] & bits[y[i : i + some]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), some)])


def similar_groups(prints: DataFrame, sets: DataFrame, words: int, blocks: int, word_distance: int, distance: int, jaccard: float) -> DataFrame:
    """(a, b), distinct and written: links that join all groups with a similar pair of nodes, of ``prints`` (node, n, fingerprint, group); ``sets`` has node and grams.

    Sets go only to the block values where a node has a candidate of another group. There all candidates whose groups aren't joined yet are compared
    where they meet, so a block value gives fewer links than it has groups: no pair of nodes leaves a task.
    """
    bounds = block_bounds(blocks)
    size = (bounds, word_distance, distance, jaccard)

    def having(batches):
        for rows, index, codes in buckets(batches, bounds):
            group, some = rows["group"].to_numpy(), np.zeros(len(rows), dtype=bool)
            for a, b, _ in near_pairs(rows, index, codes, lambda a, b: group[a] != group[b], *size):  # noqa: B023
                some[a] = some[b] = True
            if some.any():
                yield rows[some]

    def links(batches):
        for rows, index, codes in buckets(batches, bounds, HELD_SETS):
            n, grams = rows["n"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in rows["grams"]]
            names, group = np.unique(rows["group"].to_numpy(), return_inverse=True)
            root = np.arange(len(names))
            for a, b, _ in near_pairs(rows, index, codes, lambda a, b: root[group[a]] != root[group[b]], *size):  # noqa: B023
                for i in range(0, len(a), PAIRS):
                    x, y = a[i : i + PAIRS], b[i : i + PAIRS]
                    keep = root[group[x]] != root[group[y]]
                    x, y = x[keep], y[keep]
                    if not len(x):
                        continue
                    both = shared_counts(grams, x, y)
                    keep = both >= jaccard * (n[x] + n[y] - both) - 1e-9
                    root, one, other = tree_links(root, group[x[keep]], group[y[keep]])
                    if len(one):
                        yield pd.DataFrame({"a": names[one], "b": names[other]})

    rows = dealt(prints, words, blocks, SPLIT_SETS)
    kind = ", ".join(f"{name} {t}" for name, t in rows.dtypes)
    rows = written(rows.mapInPandas(having, kind), "partners")
    return written(together(rows.join(sets, "node")).mapInPandas(links, "a long, b long").distinct(), "links")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, grams), written: the sorted hashes of the distinct shingles; ``texts`` has node and text, nodes once."""

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(gram_hashes(t, shingle)).tobytes() for t in texts], dtype=object)

    return written(texts.select("node", grams("text").alias("grams")), "sets")


def judged(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(a, b, ok), written: whether the shingle sets of two nodes have a Jaccard of ``jaccard`` or more; ``sets`` has node and grams."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= jaccard * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return written(pairs.select("a", "b", similar("x", "y").alias("ok")), "judged")


def in_groups(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, group) of ``nodes`` (node); a node without links is its own group."""
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"))


def around(failed: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes, written, of all groups between which a pair of ``failed`` (a, b) stands.

    No others can have an unchecked candidate of another group: checked pairs join the two, and the first of these that leaves a group has failed.
    """
    one, other = (in_groups(failed.select(F.col(c).alias("node")).distinct(), roots).select(F.col("node").alias(c), F.col("group").alias("_" + c)) for c in "ab")
    groups = failed.join(one, "a").join(other, "b").filter("_a <> _b").select(F.explode(F.array("_a", "_b")).alias("root")).distinct()
    groups = written(groups, "groups")
    return written(roots.join(groups, "root", "left_semi").select("node").unionByName(groups.select(F.col("root").alias("node"))).distinct(), "around")


def one_of_each(docs: DataFrame, shingle: int = 5, words: int = 5, spare: int = 3, blocks: int = 6, word_distance: int = 24, distance: int = 94, jaccard: float = JACCARD) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group of linked texts the row of least doc_id stays (null last), then of least text hash.

    Texts link if the Jaccard of their sets of shingles is ``jaccard`` or more. Fingerprints of the sets only give the candidates. First, pairs
    that join each block value are checked. Around those that aren't similar, all candidates of groups that aren't joined yet are compared inside the
    tasks where they meet, and only links that join groups leave them, so no candidate is left out and no table of pairs grows with the square of
    a group. Where most texts of a large group are just short of similar, the comparisons still do: no link can be ruled out otherwise.

    Of wholly equal rows (doc_id and text) one stays. Null texts count as empty, and texts without words are one group. A very long text is
    held by one task as words and hashes, about thirty times its size. Ties go to the lesser doc_id, then to the lesser hash. All columns stay, whatever
    their names. An empty table gives an empty result.
    """
    lean_batches(docs.sparkSession)
    columns = docs.columns
    key, hash_ = free_names(docs, "_id", "_hash")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), hash_: F.sha2(F.coalesce("text", F.lit("")), 256)})

    @F.pandas_udf("node long, n int, fingerprint binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(gram_hashes(t, shingle)) for t in texts]
        node = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
        return pd.DataFrame({"node": node, "n": [len(x) for x in sets], "fingerprint": [hashes_fingerprint(x, words + spare) for x in sets]})

    made = keyed.select("doc_id", F.col(key).alias("_id"), F.col(hash_).alias("_hash"), sketch("text").alias("_made")).select("doc_id", "_id", "_hash", "_made.*")
    made = written(made, "fingerprints")
    prints = written(made.groupBy("node").agg(F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"), F.min(F.struct("_id", "_hash")).alias("at")), "nodes")
    size = (words, blocks, word_distance, distance, jaccard)

    def sets_for(nodes: DataFrame) -> DataFrame:
        where = written(prints.join(nodes, "node").select("node", F.col("at._id").alias(key), F.col("at._hash").alias(hash_)), "met")
        texts = bounded_join(keyed.select(key, hash_, "text"), where, [key, hash_], "inner")
        # equal rows have equal sets: one of them will do
        return sets_of(texts.dropDuplicates(["node"]) if repeats else texts, shingle)

    repeats = not made.groupBy("_id", "_hash").count().filter("count > 1").isEmpty()
    plain = prints.select("node", "n", "fingerprint")
    pairs = joining(plain, *size)
    sets = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    checked = judged(pairs, sets, jaccard)
    roots = written(components(checked.filter("ok").select("a", "b")), "roots")
    open_ = around(checked.filter("not ok"), roots)
    if not open_.isEmpty():
        # all of them stand in a pair that was checked, so their sets are there
        new = similar_groups(plain.join(in_groups(open_, roots), "node"), sets, *size)
        if not new.isEmpty():
            roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)), "roots")
    known = plain.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("_root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_id"), F.col("_hash"))
    first = made.groupBy("node").agg(F.min(order).alias("first")).join(known, "node").groupBy("_root").agg(F.min("first").alias("first"))
    gone = made.select("_id", "_hash").distinct().join(first.select("first._id", "first._hash"), ["_id", "_hash"], "left_anti")
    gone = written(gone.select(F.col("_id").alias(key), F.col("_hash").alias(hash_)), "gone")
    kept = bounded_join(keyed, gone, [key, hash_], "left_anti")
    return (kept.dropDuplicates([key, hash_]) if repeats else kept).select(*columns)
