"""Substring deduplication where a block is more than one slice of text, and what its workers are sent at once."""
import numpy as np

from tabulon.llm import substring_dedup

from . import brute


def test_a_block_of_several_slices_loses_no_window(spark):
    g, passage = np.random.default_rng(6), [f"p{j}" for j in range(40)]
    texts = [" ".join([f"w{x}" for x in g.integers(1 << 30, size=3000)] + passage[i % 20 :] + [f"e{i}"]) for i in range(60)]
    assert sum(map(len, texts)) > 1 << 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.text.encode().split(), r.n_removed) for r in substring_dedup.without_repeats(docs).collect()}
    assert got == brute.without_repeats(list(enumerate(texts)))
    at_once = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    assert 0 < at_once <= 4 << 20
