"""Exact top-k inner products by best-first search in M-trees.

Vectors are quantised to integers and lifted by one coordinate, sqrt(M - |x|^2) with M the largest |x|^2, so that the
Euclidean distance to a query (lifted by 0) falls as the inner product rises: a metric for an order that is none.

Vectors go to the nearest of a bounded set of pivots (at most ``PIVOTS``, taken in hash order); a cell above ``TREE_ROWS``
is dealt out to several trees by hash. Each tree is bulk-loaded into pages: a page knows its routing centre, its covering radius
and its distance to the parent's centre, a leaf also each entry's distance to the centre. The pages are a written table.

Queries go to the nearest pivot too, and each pivot's are packed into blocks of ``BLOCK``: near queries stand together. The pivots give
every query a first bound, its own cell's first tree a close one. Trees whose root ball no query of the block can reach within its
bound never meet the block: the root centres and radii are one row a tree, counted and broadcast, and only (tree, block) pairs
that remain are joined. A work unit is one tree against one block, both bounded. Each query walks the tree best first, opening
the page of the least lower bound; pages and entries that the stored distances and the triangle inequality rule out are never
compared. Bounds only prune; scores are exact integers. Where vectors lie so that no ball can be ruled out, every block meets
every tree, as any exact search must.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

PIVOTS = 512
TREE_ROWS = 16_384
LEAF, FAN_SPLITS = 256, 3
BLOCK = 4096
SCALE = 256.0
SLACK = 1e-6

#: Root balls that may be broadcast.
ROOTS = 20_000

PAGE = "tree int, page int, up int, centre binary, radius double, up_distance double, ids binary, rows binary, vectors binary, distances binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vectors`` with vec_id as long and q, floor(256 * x), instead of embedding; only rows that take part."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(SCALE)).cast("long"))
    return vectors.filter(good & F.coalesce(finite, F.lit(False))).withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("q", scaled).drop("embedding")


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of integers as float64; shorter vectors are padded with 0."""
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", x - y, x - y), 0))


def halves(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two halves of ``at`` by nearness to two far members."""
    p = points[at]
    a = int(np.argmax(distances(p, p[:1])))
    b = int(np.argmax(distances(p, p[a : a + 1])))
    order = np.argsort(distances(p, p[a : a + 1]) - distances(p, p[b : b + 1]), kind="stable")
    return [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def pages_of(tree: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, most: float) -> list[tuple]:
    """Pages of a bulk-loaded tree, parents first."""
    points, out = lift(vectors, most), []
    todo = [(np.arange(len(ids)), -1, None)]
    while todo:
        at, up, up_centre = todo.pop()
        p = points[at]
        centre = p[int(np.argmin(distances(p, p.mean(axis=0, keepdims=True))))]
        away = distances(p, centre[None, :])
        page, leaf = len(out), len(at) <= LEAF
        held = (ids[at].tobytes(), rows[at].tobytes(), vectors[at].astype(np.int64).tobytes(), away.tobytes()) if leaf else (b"", b"", b"", b"")
        up_distance = 0.0 if up_centre is None else float(distances(centre[None, :], up_centre[None, :])[0])
        out.append((tree, page, up, centre.tobytes(), float(away.max()), up_distance, *held))
        if not leaf:
            parts = [at]
            for _ in range(FAN_SPLITS):
                parts = [h for x in parts for h in (halves(points, x) if len(x) > LEAF else [x])]
            todo += [(x, page, centre) for x in parts]
    return out


class Tree:
    def __init__(self, rows: pd.DataFrame, dim: int, most: float) -> None:
        rows = rows.sort_values("page", ignore_index=True)
        self.centres = np.stack([np.frombuffer(c) for c in rows["centre"]])
        self.radius = rows["radius"].to_numpy()
        self.up_distance = rows["up_distance"].to_numpy()
        self.ids = [np.frombuffer(x, dtype=np.int64) for x in rows["ids"]]
        self.rows = [np.frombuffer(x, dtype=np.int64) for x in rows["rows"]]
        self.vectors = [np.frombuffer(x, dtype=np.int64).reshape(-1, dim).astype(np.float64) for x in rows["vectors"]]
        self.away = [np.frombuffer(x) for x in rows["distances"]]
        self.children: list[np.ndarray] = [np.flatnonzero(rows["up"].to_numpy() == p) for p in range(len(rows))]
        self.most = most

    def search(self, row: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of at least ``floor`` but for the query's own ``row``, fewer if fewer reach it; equal scores to the smaller id."""
        square = float(q @ q)
        lifted = np.append(q, 0.0)
        slack = SLACK * (1.0 + square + self.most)
        best: list[tuple[int, int]] = []
        bound = floor

        def reach() -> float:
            """The distance beyond which no score reaches the bound."""
            return float(np.sqrt(max(0.0, square + self.most - 2 * bound + slack)))

        root = float(np.sqrt(((self.centres[0] - lifted) ** 2).sum()))
        heap = [(max(0.0, root - self.radius[0]), 0, root)]
        while heap:
            least, page, to_centre = heapq.heappop(heap)
            far = reach()
            if least > far:
                break
            children = self.children[page]
            if len(children):
                may = children[np.abs(to_centre - self.up_distance[children]) - self.radius[children] <= far]
                if len(may):
                    gone = distances(self.centres[may], lifted[None, :])
                    for c, d in zip(may.tolist(), gone.tolist(), strict=True):
                        if (low := max(0.0, d - self.radius[c])) <= far:
                            heapq.heappush(heap, (low, c, d))
                continue
            may = np.abs(to_centre - self.away[page]) <= far
            ids, rows, vectors = self.ids[page], self.rows[page], self.vectors[page]
            if not may.all():
                ids, rows, vectors = ids[may], rows[may], vectors[may]
            scores = vectors @ q
            keep = (scores >= bound) & (rows != row)
            if keep.any():
                best = sorted([*best, *zip(scores[keep].tolist(), ids[keep].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    bound = max(bound, best[-1][0])
        return best


def cell_of(about: dict, spark):
    """A function of q: the nearest of the pivots that make cells."""
    shared = spark.sparkContext.broadcast(about)

    @F.pandas_udf("int")
    def cell(q: pd.Series) -> pd.Series:
        a = shared.value
        centres = lift(a["pivots"][: a["cells"]], a["most"])
        points = lift(matrix(q, a["dim"]), a["most"])
        return pd.Series(np.argmin((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1).astype(np.int32))

    return cell


def build(vectors: DataFrame) -> tuple[DataFrame, dict]:
    """Index pages over all of ``vectors`` (row, vec_id, q), as a written table, and what a search needs to know of them."""
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    known = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dim"), F.coalesce(F.max(square), F.lit(0.0)).alias("most")).first()
    n, dim, most = known["n"], max(1, known["dim"]), known["most"]
    wanted = min(PIVOTS, max(8, -(-n // (TREE_ROWS // 2))))
    chosen = vectors.withColumn("_o", F.xxhash64(F.lit(3), "vec_id")).orderBy("_o", "row").limit(wanted).collect()
    pivots = matrix(pd.Series([r["q"] for r in chosen], dtype=object), dim)
    cells = max(1, min(len(chosen), -(-n // (TREE_ROWS // 2))))
    about = {"n": n, "dim": dim, "most": most, "pivots": pivots, "pivot_rows": np.array([r["row"] for r in chosen], dtype=np.int64), "cells": cells}
    placed = written(vectors.withColumn("cell", cell_of(about, vectors.sparkSession)("q")), "cells")
    # one row for each cell, at most PIVOTS: how many trees it makes and the first of them
    sizes = {r["cell"]: -(-r["n"] // TREE_ROWS) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    first = [sum(sizes.get(i, 0) for i in range(c)) for c in range(cells + 1)]
    of_cell = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)
    chunk = F.pmod(F.xxhash64("row"), of_cell([max(1, sizes.get(c, 0)) for c in range(cells)])).cast("int")
    placed = placed.withColumn("tree", (of_cell(first[:cells]) + chunk).cast("int"))
    about["homes"] = first[:cells]

    def load(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        made = pages_of(int(pdf["tree"].iloc[0]), *(pdf[c].to_numpy(dtype=np.int64) for c in ("vec_id", "row")), matrix(pdf["q"], dim), most)
        return pd.DataFrame(made, columns=[c.split()[0] for c in PAGE.split(", ")])

    return written(placed.select("tree", "row", "vec_id", "q").groupBy("tree").applyInPandas(load, PAGE), "pages"), about


def units(roots: DataFrame, blocks: DataFrame, dim: int, most: float) -> DataFrame:
    """(tree, block): the work units. ``roots`` has one row a tree; those that a block's queries can't reach within their bounds are left out."""
    rows = roots.select("tree", "centre", "radius").limit(ROOTS + 1).collect()
    if len(rows) > ROOTS:  # too many to send: every tree meets every block
        return roots.select("tree").join(blocks.select("block", "home"), F.col("tree") != F.col("home")).select("tree", "block")
    held = roots.sparkSession.sparkContext.broadcast((np.array([r["tree"] for r in rows]), np.stack([np.frombuffer(r["centre"]) for r in rows]), np.array([r["radius"] for r in rows])))

    def reachable(batches):
        trees, centres, radius = held.value
        for pdf in batches:
            for block, q, floor in zip(pdf["block"], pdf["q"], pdf["floor"], strict=True):
                own = np.frombuffer(q, dtype=np.int64).reshape(-1, dim).astype(np.float64)
                square = (own**2).sum(axis=1)
                lifted = np.concatenate([own, np.zeros((len(own), 1))], axis=1)
                far = np.sqrt(np.maximum(0, square + most - 2 * np.frombuffer(floor) + SLACK * (1 + square + most)))
                near = np.zeros(len(trees), dtype=bool)
                for i in range(0, len(own), 256):
                    gone = (lifted[i : i + 256] ** 2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * lifted[i : i + 256] @ centres.T
                    slack = SLACK * (1 + square[i : i + 256] + most)
                    gone = np.sqrt(np.maximum(gone - slack[:, None], 0))
                    near |= (gone - radius[None, :] <= far[i : i + 256, None]).any(axis=0)
                yield pd.DataFrame({"tree": trees[near].astype(np.int32), "block": np.full(int(near.sum()), block)})

    return blocks.select("block", "q", "floor").mapInPandas(reachable, "tree int, block string").join(blocks.select(F.col("home").alias("tree"), "block"), ["tree", "block"], "left_anti")


def search(pages: DataFrame, about: dict, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``queries`` (row, vec_id, q), rows of the index, against all others that ``pages`` hold."""
    spark = pages.sparkSession
    dim, most = about["dim"], about["most"]
    if not about["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shared = spark.sparkContext.broadcast((about["pivots"], about["pivot_rows"]))
    asked = written(queries.withColumn("cell", cell_of(about, spark)("q")), "queries")
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("chunks"))  # at most PIVOTS rows
    asked = asked.join(F.broadcast(counts), "cell")
    home = F.element_at(F.array(*[F.lit(h) for h in about["homes"]]), F.col("cell") + 1)
    asked = asked.withColumns({"block": F.concat_ws(":", "cell", F.pmod(F.xxhash64("row"), F.col("chunks"))), "home": home.cast("int")})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        q, ids, rows = matrix(pdf["q"], dim), pdf["vec_id"].to_numpy(dtype=np.int64), pdf["row"].to_numpy(dtype=np.int64)
        pivots, pivot_rows = shared.value
        floor = pdf["least"].fillna(-np.inf).to_numpy(dtype=np.float64)
        if len(pivots) > k:
            scores = np.where(pivot_rows[None, :] == rows[:, None], -np.inf, q @ pivots.T)
            floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        packed = {"ids": [ids.tobytes()], "rows": [rows.tobytes()], "q": [q.astype(np.int64).tobytes()], "floor": [floor.tobytes()]}
        return pd.DataFrame({**{c: pdf[c].iloc[:1].to_numpy() for c in ("block", "home")}, **packed})

    packed = lambda df, label: written(df.groupBy("block").applyInPandas(pack, "block string, home int, ids binary, rows binary, q binary, floor binary"), label)

    def run(key, own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(block):
            tree = Tree(own, dim, most)
            ids, rows, floor = np.frombuffer(block["ids"].iloc[0], dtype=np.int64), np.frombuffer(block["rows"].iloc[0], dtype=np.int64), np.frombuffer(block["floor"].iloc[0])
            q = np.frombuffer(block["q"].iloc[0], dtype=np.int64).reshape(-1, dim).astype(np.float64)
            for i in range(len(ids)):
                found += [(int(rows[i]), int(ids[i]), v, int(s)) for s, v in tree.search(int(rows[i]), q[i], k, floor[i])]
        return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"])

    def found(pairs: DataFrame, blocks: DataFrame, label: str) -> DataFrame:
        against = pages.join(pairs, "tree").groupBy("tree", "block").cogroup(blocks.join(pairs, "block").groupBy("tree", "block"))
        return written(against.applyInPandas(run, "row long, query_id long, vec_id long, score long"), label)

    blocks = packed(asked.withColumn("least", F.lit(None).cast("double")), "query-blocks")
    near = found(written(blocks.select(F.col("home").alias("tree"), "block"), "home-units"), blocks, "near")
    least = near.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select("row", F.col("least").cast("double").alias("least"))
    blocks = packed(asked.join(least, "row", "left"), "bounded-blocks")
    out = near.unionByName(found(written(units(pages.filter("page = 0"), blocks, dim, most), "units"), blocks, "far"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``is_query`` holds, their k best other rows by integer inner product.

    Rows with a null vec_id, a null vector, or a null or non-finite component take no part; an empty vector is all
    zeros, shorter vectors are padded with 0. Only the query's own row is no candidate: rows that share its vec_id are others, repeated
    rows count each, and a repeated query gives rows of its own. Ties go to the smaller vec_id; with fewer than k candidates all are
    returned. A very long vector widens all to its length. An empty table gives an empty result. Other columns are ignored, whatever their
    names. Scores are exact below 2^53.
    """
    asks = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(quantised(asks.withColumn("row", F.monotonically_increasing_id())), "vectors")
    pages, about = build(rows.drop("asks"))
    return search(pages, about, rows.filter("asks").drop("asks"), k)
