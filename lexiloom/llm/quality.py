"""Quality by nearest-neighbour voting in a latent semantic space.

Text becomes hashed counts of its byte n-grams plus a few terms for its shape; the space is the truncated SVD of a
bounded sample of labelled rows, found by one task in a fixed number of subspace iterations over at most ``2 * PER_CLASS`` vectors
(33 MB). Only the axes and the labelled vectors in them (``RANK`` floats each, about 1.2 MB) come to the driver and are
broadcast. Every document is compared with all of them, exactly, in blocks of cosine products; its nearest neighbours
vote with their similarity.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches

#: Labelled rows of each class that the model may hold; the rows are chosen by hash.
PER_CLASS = 2000
TERMS = 2048  # a power of two
RANK, SPARE, ROUNDS = 48, 16, 12
NEIGHBOURS = 25
POWER = 4
BLOCK = 512
THRESHOLD = 0.7


def term_vector(text: str | None) -> np.ndarray:
    """Unit vector of log counts of byte 2-grams and 3-grams, and of shape terms."""
    data = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(TERMS, dtype=np.float64)
    if len(raw) > 1:
        two = raw[:-1] * np.uint32(256) + raw[1:]
        counts += np.bincount((two * np.uint32(2654435761)) >> np.uint32(33 - TERMS.bit_length()), minlength=TERMS)
        three = two[:-1] * np.uint32(256) + raw[2:]
        counts += np.bincount((three * np.uint32(2246822519)) >> np.uint32(33 - TERMS.bit_length()), minlength=TERMS)
    vector = np.log1p(counts)
    norm = math.sqrt(float(vector @ vector))
    if norm:
        vector /= norm
    tokens = data.split()
    spread = len(set(tokens)) / len(tokens) if tokens else 0.0
    if len(raw):
        upper = float(np.count_nonzero((raw >= 65) & (raw <= 90))) / len(raw)
        letters = float(np.count_nonzero(((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128))) / len(raw)
    else:
        upper = letters = 0.0
    shape = np.array([spread, 3 * upper, letters, min(1.0, math.log1p(len(tokens)) / 10), 1.0 - letters])
    return np.concatenate([vector, 0.5 * shape]).astype(np.float32)


def principal_axes(vectors: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The RANK leading right singular vectors of ``vectors - mean``, by subspace iteration from a fixed start."""
    n, d = vectors.shape
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).normal(size=(d, min(d, RANK + SPARE))))[0].astype(np.float32)
    for _ in range(ROUNDS):
        y = vectors @ q - mean @ q
        q = np.linalg.qr((vectors.T @ y - np.outer(mean, y.sum(axis=0))).astype(np.float64))[0].astype(np.float32)
    y = (vectors @ q - mean @ q).astype(np.float64)
    return (q @ np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :RANK]).astype(np.float32)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, shares: tuple[float, float]) -> None:
        """shares: of label 0 and of label 1 among all labelled rows that may be learned from."""
        self.prior = shares[1]
        self.mean = vectors.mean(axis=0, dtype=np.float64).astype(np.float32)
        self.axes = principal_axes(vectors, self.mean)
        self.labels = labels.astype(np.float32)
        self.known = self.unit(vectors @ self.axes - self.mean @ self.axes)
        held = [max(1, int((labels == c).sum())) for c in (0, 1)]
        self.weights = np.where(labels == 1, shares[1] / held[1], shares[0] / held[0]).astype(np.float32)
        self.weights /= self.weights.mean()

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the votes of the NEIGHBOURS most similar vectors; all that tie with the last of them vote too."""
        points = self.unit(vectors @ self.axes - self.mean @ self.axes)
        near = points @ self.known.T
        k = near.shape[1] - min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, k, axis=1)[:, k : k + 1]
        votes = np.where(near >= least, np.maximum(near, 0) ** POWER * self.weights, 0)
        total = votes.sum(axis=1)
        return np.where(total > 0, votes @ self.labels / np.maximum(total, 1e-12), self.prior).clip(0, 1)


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from; null ids neither."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Model from at most ``per_class`` labelled rows of each class, taken in hash order; None without labelled rows."""
    usable = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    shares = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = None
    for label in sorted(shares):
        part = usable.filter(F.col("quality") == label).withColumn("_o", order).orderBy("_o", "doc_id").limit(per_class).drop("_o")
        chosen = part if chosen is None else chosen.unionByName(part)

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([term_vector(t).tobytes() for t in texts], dtype=object)

    # one row for each document, of which there are at most 2 * per_class; a broadcast of as many ids
    chosen = chosen.groupBy("doc_id").agg(F.collect_list("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", vector("text").alias("v"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("v", "quality")).alias("r")).select("doc_id", "r.*")
    total = sum(shares.values())
    known = (shares.get(0, 0) / total, shares.get(1, 0) / total)

    def train(batches):
        held = [(i, q, np.frombuffer(v, dtype=np.float32)) for pdf in batches for i, qs, v in zip(pdf["doc_id"], pdf["quality"], pdf["v"], strict=True) for q in sorted(qs)]
        if held:
            held.sort(key=lambda r: r[:2])
            labels = np.array([q for _, q, _ in held])
            yield pd.DataFrame({"model": [pickle.dumps(Model(np.stack([v for _, _, v in held]), labels, known))]})

    found = rows.repartition(1).mapInPandas(train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` plus held_out, score and predicted, from the text alone.

    A null text counts as empty; empty texts are points like others. Without any labelled row to learn from, every score
    is 1, so that nothing is rejected. Null labels, and labels of unknown documents, are ignored; repeated labels of a
    document count once each. Null doc_ids count as held out. Repeated rows stay. Neighbours that tie with the last one all vote. A very long
    text is counted whole, by one task, in about twenty times its size. An empty table gives an empty result. Input columns named like
    results are replaced.
    """
    lean_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    model = fit(docs, labels, per_class)
    if model is None:
        out = docs.withColumn("score", F.lit(1.0))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def rate(texts: pd.Series) -> pd.Series:
            found = [held.value.scores(np.stack([term_vector(t) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)]
            return pd.Series(np.concatenate(found) if found else np.zeros(0), dtype="float64")

        out = docs.withColumn("score", rate(F.col("text")))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int")
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", predicted)
