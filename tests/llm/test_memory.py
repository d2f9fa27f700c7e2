"""What a worker holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from claimweave.llm import toxicity


class OneBatch:
    """A table of one batch whose ``mapInArrow`` runs in this process, where its arrays are counted."""

    columns, schema = ["doc_id", "text"], "doc_id long, text string"

    def __init__(self, spark, texts):
        self.sparkSession, self.batch = spark, pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=self.columns)

    def mapInArrow(self, work, schema):
        return list(work(iter([self.batch])))


def test_arrays_of_a_slice_stay_small(spark):
    r = np.random.default_rng(3)
    words = np.array(["".join(map(chr, r.integers(97, 123, 6))) for _ in range(500)])
    docs = OneBatch(spark, [" ".join(r.choice(words, 400)) for _ in range(1500)])  # 4 MB
    model = toxicity.Linear(r.normal(0, 0.01, 1 << toxicity.BITS), 0.0)
    toxicity.clean_rows(docs, model)  # tables that are built once
    tracemalloc.start()
    toxicity.clean_rows(docs, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
