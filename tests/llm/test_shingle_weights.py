"""TF-IDF of near-duplicates: exact document frequencies of every shingle, and classes by them."""
import math

import numpy as np
import pytest

from tabulon.llm import near_dedup, queries

from . import brute


def corpus():
    """A group of near copies, a phrase that half of the documents end with, exact copies, nulls and short texts."""
    g, texts = np.random.default_rng(31), []
    base = [f"w{j}" for j in range(160)]
    for _ in range(150):
        w = list(base)
        for j in g.choice(160, g.integers(0, 7), False):
            w[j] = f"z{g.integers(1 << 30)}"
        texts.append(" ".join(w))
    for i in range(200):
        w = [f"v{g.integers(1 << 30)}" for _ in range(g.integers(20, 60))]
        texts += [" ".join(w + ["all", "rights", "are", "reserved", "by", "us"] * (1 + i % 2 * 3))] * (1 + (i % 10 == 0))
    return [*texts, None, "", "one two", "one two"]


def frequencies(texts):
    out: dict = {}
    for t in texts:
        w = brute.words(t)
        for x in {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ():
            out[x] = out.get(x, 0) + 1
    return out


def smooth_sets(texts):
    df, n, sets = frequencies(texts), len(texts), []
    for t in texts:
        w, counts = brute.words(t), {}
        for x in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
            counts[x] = counts.get(x, 0) + 1
        sets.append({x: (1 + math.log(k)) * (1 + math.log((1 + n) / (1 + df[x]))) for x, k in counts.items()})
    return sets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("weights")
    spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("size, parts", [(near_dedup.BLOCK_BYTES, 2), (3_000, 5)])
def test_frequencies_are_exact_for_every_shingle(spark, monkeypatch, size, parts):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    monkeypatch.setattr(near_dedup, "AT_ONCE", min(size, near_dedup.AT_ONCE))
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    df = frequencies(texts)
    rows = near_dedup.sampled(docs, (len(texts), near_dedup.smooth_idf), "doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = brute.words(r.text)
        want = sorted(df[x] for x in {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else []
        assert r.text == texts[r.doc] and sorted(np.frombuffer(r.df, "<i4").tolist()) == want


def test_query_links_by_real_frequencies(spark, monkeypatch, folder):
    texts = corpus()
    flat = brute.near_classes(list(range(len(texts))), texts)
    monkeypatch.setattr(brute, "weighted_sets", smooth_sets)
    want = brute.near_classes(list(range(len(texts))), texts)
    assert want != flat  # the damped frequencies give other classes
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op9_near_dedup"](spark, folder).collect()}
    assert got == want


def test_tabulated_samples_equal_single_ones(monkeypatch):
    g = np.random.default_rng(2)
    x = g.integers(1 << near_dedup.BITS, size=4000, dtype=np.uint64)
    weight = np.where(g.random(4000) < 0.3, 1.0, g.choice([0.31, 0.5, 0.77, 1.7], 4000))
    weight[:50] = g.random(50)
    heads = np.arange(0, 4000, 100)
    one = near_dedup.Sampler().samples(x, weight, heads)
    monkeypatch.setattr(near_dedup, "TABULATED", 1 << 40)
    assert (one == near_dedup.Sampler().samples(x, weight, heads)).all()


def test_stage_keeps_one_of_each_class_by_real_frequencies(spark, monkeypatch, folder):
    import corpus_pipeline

    texts = corpus()
    flat = brute.near_classes(list(range(len(texts))), texts)
    monkeypatch.setattr(brute, "weighted_sets", smooth_sets)
    want = {i for i, c in brute.near_classes(list(range(len(texts))), texts).items() if i == c}
    assert want != {i for i, c in flat.items() if i == c}
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()]
    assert sorted(got) == sorted(want)
