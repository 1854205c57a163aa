"""The quality classifier's votes against a plain nearest-neighbour vote, one document and one labelled vector at a time."""

import math

import numpy as np

from lexiloom.llm import quality, queries
from lexiloom.llm.shared import documents


def plain_vote(model, text):
    """Share of label 1 among the votes of the most similar labelled vectors, all that tie with the last one included."""
    own = quality.term_vector(text).astype(np.float64)
    point = [sum((own[i] - float(model.mean[i])) * float(model.axes[i, k]) for i in np.flatnonzero((own != 0) | (model.mean != 0))) for k in range(model.axes.shape[1])]
    norm = math.sqrt(sum(x * x for x in point)) or 1e-12
    near = sorted(((sum(a / norm * float(b) for a, b in zip(point, known, strict=True)), i) for i, known in enumerate(model.known)), reverse=True)
    least = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
    total = ones = 0.0
    for likeness, i in near:
        if likeness >= least - 1e-6:
            vote = max(likeness, 0.0) ** quality.POWER * float(model.weights[i])
            total, ones = total + vote, ones + vote * float(model.labels[i])
    return ones / total if total else model.prior


def test_votes_equal_a_plain_vote(spark, data):
    docs = documents(spark, data).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.orderBy("doc_id").limit(25).collect()}
    texts |= {-1: "", -2: None, -3: "!!! ??? 0000"}
    extra = spark.createDataFrame([(i, t) for i, t in texts.items() if i < 0], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in queries.op4_quality(spark, data).collect()}
    found |= {r["doc_id"]: r["score"] for r in quality.score(docs.unionByName(extra), spark.read.parquet(f"{data}/labels.parquet")).filter("doc_id < 0").collect()}
    for i, text in texts.items():
        assert abs(found[i] - plain_vote(model, text)) < 2e-3, i
