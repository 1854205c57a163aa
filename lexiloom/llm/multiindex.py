"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each to the nearest of K centroids (k-means over at most ``SAMPLE`` vectors, in hash order);
a pair of centroids is a cell, and every vector is in one. Vectors that are wholly equal are one entry with its ``k + 1``
smallest ids: none of the others can be among anyone's k nearest.

A query walks the cells from the nearest on, by the sum of the two squared distances, with a heap over the two sorted lists of centroids, until
they hold ``reach`` entries; these are reranked by their exact distance on the original vectors. ``reach`` isn't guessed: at most
``TRIALS`` queries are compared with all entries, in blocks, and it is the least number that finds ``RECALL`` of their true neighbours. On vectors
without structure that is a good part of all entries, on clustered ones few.

Cells above ``CELL`` entries are split by hash; ranges of cells make shards of about ``SHARD`` entries. A query is sent once to each shard in
which it visits cells, with their numbers; the queries of a shard are split into blocks of about ``VISITS``. So a task holds one shard and one block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_join, written

SAMPLE, TRIALS, RECALL = 20_000, 100, 0.97
MOST_CENTROIDS, ROUNDS = 256, 10
CELL, SHARD, VISITS = 1024, 4096, 4096

#: Entries that the trial queries meet at once.
BLOCK = 4096


def vectors_of(column, dim: int) -> np.ndarray:
    """Rows as float64; shorter vectors are padded with 0."""
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to ``q``, by their differences."""
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :], 0)


def centroids(points: np.ndarray, k: int) -> np.ndarray:
    """k-means from the first k different rows; an empty cluster keeps its centre."""
    centres = points[np.sort(np.unique(points, axis=0, return_index=True)[1])[:k]].copy()
    for _ in range(ROUNDS):
        near = np.argmin(squares(points, centres), axis=1)
        many = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres


class Codes:
    """Centroids of both halves, and how many entries each cell has: at most ``MOST_CENTROIDS`` squared numbers."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.dim, self.half = sample.shape[1], -(-sample.shape[1] // 2)
        self.centres = [centroids(sample[:, : self.half], k), centroids(sample[:, self.half :], k)]
        self.sizes = np.zeros(0, dtype=np.int64)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [squares(x[:, : self.half], self.centres[0]), squares(x[:, self.half :], self.centres[1])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (np.argmin(s, axis=1) for s in self.halves(x))
        return one * len(self.centres[1]) + two

    def walk(self, near: list[np.ndarray]):
        """(cell, summed distance) from the nearest on, for a query's squared distances to the centroids of both halves."""
        order = [np.argsort(x, kind="stable") for x in near]
        one, two = (x[o].tolist() for x, o in zip(near, order, strict=True))
        width, names = len(self.centres[1]), [o.tolist() for o in order]
        heap, column = [(one[0] + two[0], 0, 0)], 0
        while heap:
            d, i, j = heapq.heappop(heap)
            yield names[0][i] * width + names[1][j], d
            if j + 1 < len(two):
                heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):  # each row of pairs starts once the row above has started
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))

    def visited(self, near: list[np.ndarray], reach: int) -> list[int]:
        """The cells with entries that a query visits until they hold ``reach``, and all that are as near as the last."""
        out, held, last = [], 0, None
        for cell, d in self.walk(near):
            if held >= reach and d > last:
                break
            if n := int(self.sizes[cell]):
                out.append(cell)
                held, last = held + n, d
        return out


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and other columns of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.withColumn("v", v).drop("embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).withColumn("vec_id", F.col("vec_id").cast("long"))


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """(entry, v, ids, rows): one row for each different vector, with its k + 1 smallest vec_ids. Tasks keep that many of a vector before the shuffle."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    few = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    held = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    return few.groupBy("v").agg(held.alias("held")).select(F.col("held")[0]["row"].alias("entry"), "v", "held")


def trial(entries: DataFrame, queries: np.ndarray, codes: Codes, k: int) -> int:
    """The least number of entries, nearest cells first, that holds ``RECALL`` of the true k nearest of ``queries``, at most ``TRIALS``."""
    held = entries.sparkSession.sparkContext.broadcast((queries, codes))

    def compare(batches):
        q, c = held.value
        near = c.halves(q)
        best: list = [[] for _ in q]
        sums = [np.add.outer(near[0][i], near[1][i]).ravel() for i in range(len(q))]
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                x = vectors_of(pdf["v"].iloc[at : at + BLOCK], c.dim)
                cell = c.cells(x)
                for i in range(len(q)):
                    d = distances(x, q[i])
                    d[d == 0] = np.inf  # the query itself
                    first = np.argpartition(d, k)[:k] if len(d) > k else np.arange(len(d))
                    best[i] = sorted([*best[i], *zip(d[first].tolist(), sums[i][cell[first]].tolist(), strict=True)])[:k]
        found = [(i, d, s) for i, own in enumerate(best) for d, s in own if d < np.inf]
        yield pd.DataFrame(found, columns=["q", "d", "far"])

    found = entries.select("v").mapInPandas(compare, "q int, d double, far double")
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d"))).filter(F.col("place") <= k)
    near, needs = codes.halves(queries), []
    for r in first.select("q", "far").collect():  # k rows for each trial query
        sums = np.add.outer(near[0][r["q"]], near[1][r["q"]]).ravel()
        needs.append(int(codes.sizes[sums <= r["far"] * (1 + 1e-12)].sum()))
    return max(k + 1, int(np.quantile(needs, RECALL, method="higher"))) if needs else k + 1


def build(entries: DataFrame, n: int, dim: int) -> Codes:
    """Centroids from a bounded sample, and the sizes of all cells."""
    chosen = entries.withColumn("_o", F.xxhash64(F.lit(11), "v")).orderBy("_o", "entry").limit(SAMPLE).select("v").toPandas()
    wanted = 1 << max(2, round(np.log2(max(n, 1)) / 2 - 1.5))
    return Codes(vectors_of(chosen["v"], dim), min(MOST_CENTROIDS, wanted))


def nearest(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``is_query`` holds, k near other rows by Euclidean distance, nearest first.

    Approximate: some neighbours may be missed, those returned carry their exact distance in double precision on the original vectors.
    Rows with a null vec_id, a null or zero vector or a null or non-finite component take no part; shorter vectors are padded with 0, an empty one is
    zero. Only the query's own row is no candidate. Rows that repeat count each, repeated queries give rows of their own. Ties go to the
    smaller vec_id. With fewer than k found candidates all are returned, and at least k + 1 entries are always visited if there are as many. An empty table gives
    an empty result. A very long vector widens all to its length. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    asks = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(taking_part(asks.withColumn("row", F.monotonically_increasing_id())), "parts")
    widest = rows.agg(F.max(F.size("v")).alias("dim")).first()["dim"]
    schema = "query_id long, rank int, vec_id long, score double"
    if not widest:
        return spark.createDataFrame([], schema)
    shorter = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(widest) - F.size("v")))
    rows = rows.withColumn("v", F.transform(shorter, lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    entries = written(entries_of(rows, k), "entries")
    n = entries.count()
    codes = build(entries, n, widest)
    shared = spark.sparkContext.broadcast(codes)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(vectors_of(v, widest)).astype(np.int32))

    placed = written(entries.withColumn("cell", cell_of("v")), "cells")
    codes.sizes = np.zeros(len(codes.centres[0]) * len(codes.centres[1]), dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MOST_CENTROIDS squared rows
        codes.sizes[r["cell"]] = r["n"]
    asked = written(rows.filter("asks").groupBy("v").agg(F.min("row").alias("query")), "asked")  # equal queries are searched once
    tried = asked.withColumn("_o", F.xxhash64(F.lit(12), "v")).orderBy("_o", "query").limit(TRIALS).select("v").toPandas()
    if tried.empty:
        return spark.createDataFrame([], schema)
    reach = trial(placed, vectors_of(tried["v"], widest), codes, k)
    sized = spark.sparkContext.broadcast((codes, reach))
    # a shard is a range of cells, so that cells of one centroid stand together; a large cell's parts stand in several
    starts, parts = np.cumsum(codes.sizes) - codes.sizes, np.maximum(1, -(-codes.sizes // CELL))
    many = [(int(c), int(parts[c]), int(starts[c])) for c in np.flatnonzero(codes.sizes)]
    many = spark.createDataFrame(many, "cell int, parts int, start long")

    def visit(batches):
        c, far = sized.value
        for pdf in batches:
            x = vectors_of(pdf["v"], c.dim)
            near, out = c.halves(x), []
            for i, query in enumerate(pdf["query"].tolist()):
                cells = np.array(c.visited([near[0][i], near[1][i]], far), dtype=np.int64)
                tops = np.cumsum(parts[cells])
                step = np.arange(int(tops[-1])) - np.repeat(tops - parts[cells], parts[cells])
                cells = np.repeat(cells, parts[cells])
                shard = (starts[cells] + step * CELL) // SHARD
                order = np.argsort(shard, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    if len(own):
                        out.append((int(shard[own[0]]), query, x[i].tobytes(), np.unique(cells[own]).astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["shard", "query", "q", "cells"])

    visits = written(asked.mapInPandas(visit, "shard int, query long, q binary, cells binary"), "visits")
    blocks = written(visits.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(VISITS)).cast("int").alias("blocks")), "visit-blocks")
    part = F.pmod(F.xxhash64("entry"), F.col("parts"))
    held = bounded_join(placed, many, ["cell"], "inner").withColumn("shard", F.floor((F.col("start") + part * CELL) / F.lit(SHARD)).cast("int"))
    held = bounded_join(held, blocks, ["shard"], "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = bounded_join(visits, blocks, ["shard"], "inner").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))

    def rerank(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(block):
            own = own.sort_values(["cell", "entry"], ignore_index=True)
            x, entry, cell = vectors_of(own["v"], widest), own["entry"].to_numpy(), own["cell"].to_numpy()
            for query, q, cells in zip(block["query"].tolist(), block["q"], block["cells"], strict=True):
                at = np.flatnonzero(np.isin(cell, np.frombuffer(cells, dtype=np.int32)))
                d = distances(x[at], np.frombuffer(q))
                if len(d) > k + 1:  # all that tie with the last stay: entries of equal distance may differ in their ids
                    keep = d <= np.partition(d, k)[k]
                    at, d = at[keep], d[keep]
                found += zip([query] * len(at), entry[at].tolist(), d.tolist(), strict=True)
        return pd.DataFrame(found, columns=["query", "entry", "score"])

    sides = [side.groupBy("shard", "block") for side in (held.select("shard", "block", "cell", "entry", "v"), visits.select("shard", "block", "query", "q", "cells"))]
    near = written(sides[0].cogroup(sides[1]).applyInPandas(rerank, "query long, entry long, score double"), "near")
    near = near.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy("score"))).filter(F.col("place") <= k + 1)
    named = near.join(entries.select("entry", "held"), "entry").select("query", "score", F.explode("held").alias("x")).select("query", "score", "x.*")
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    named = named.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    own = rows.filter("asks").select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), "v").join(asked, "v").drop("v")
    order = Window.partitionBy("asker").orderBy("score", "vec_id", "row")
    out = own.join(named.drop("place"), "query").filter("asker <> row").withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
