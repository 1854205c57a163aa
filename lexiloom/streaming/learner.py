"""The incremental lexicon learner over a stream: one learner for each key, whose lexicon is the key's keyed state.

Words, begins and ends are map states, so a micro-batch writes the entries that it changed and no others; forgotten words leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.puddle import Learner

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Lexicon(StatefulProcessor):
    """Segments the rows of a key while learning from them."""

    def __init__(self, columns: list[str], order: str, window: int, by_frequency: bool, memory: int) -> None:
        self.columns, self.order, self.options = columns, order, (window, by_frequency, memory)

    def init(self, handle: StatefulProcessorHandle) -> None:
        item = "item string"
        self.words = handle.getMapState("words", item, "n long, learned long")
        self.edges = {kind: handle.getMapState(kind, item, "n long") for kind in ("begin", "end")}
        self.clock = handle.getValueState("clock", "learned long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        learner = Learner(*self.options)
        held = sorted(((k[0], *v) for k, v in self.words.iterator()), key=lambda x: x[2])
        learner.load(("word", word, n) for word, n, _ in held)
        for kind, state in self.edges.items():
            learner.load([(kind, k[0], v[0]) for k, v in state.iterator()])
        learner.touched.clear()
        known, before = set(learner.words), {"begin": dict(learner.begins), "end": dict(learner.ends)}
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, ignore_index=True)
        yield batch.assign(text=[" ".join(learner.segment(t.split())) for t in batch["text"]])[self.columns]
        for word in known - learner.words.keys():
            self.words.removeKey((word,))
        clock = self.clock.get()[0] if self.clock.exists() else 0
        for word, n in learner.words.items():  # in the order of learning
            if word in learner.touched:
                clock += 1
                self.words.updateValue((word,), (n, clock))
        self.clock.update((clock,))
        for kind, now in (("begin", learner.begins), ("end", learner.ends)):
            for item, n in now.items():
                if before[kind].get(item) != n:
                    self.edges[kind].updateValue((item,), (n,))

    def close(self) -> None:
        pass


def segment_stream(prepared: DataFrame, group: str = "doc_id", order: str = "line_no", window: int = 2, by_frequency: bool = False, memory: int = 0) -> DataFrame:
    """``prepared`` (a stream of doc_id, line_no, text) segmented while learning; write it in append mode.

    Utterances of a key are read by ``order`` within a batch, and batches in turn: the stream must bring them in order. The state of a
    key is its lexicon, so keys should be conversations or documents, not whole sources; ``memory`` bounds its words to those learned last.
    Needs the RocksDB state store.
    """
    if not prepared.sparkSession.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {PROVIDER} to the RocksDB provider: map states need it")
    lexicon = Lexicon(prepared.columns, order, window, by_frequency, memory)
    return prepared.groupBy(group).transformWithStateInPandas(lexicon, prepared.schema, "Append", "None")
