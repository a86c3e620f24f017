"""The pipeline against plain Python, stage by stage and whole, on a small table; queries of the entry file."""
import sys

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tabulon.llm import packing
from tabulon.llm.shared import _folders

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(g, n):
    return " ".join("".join(g.choice(list("abcdefgh"), g.integers(3, 8))) for _ in range(n))


def corpus():
    """Rows with good and bad documents, a bad host, copies, near copies, shared passages, nulls and repeated rows; labels."""
    g = np.random.default_rng(31)
    passage, rows, labels = prose(g, 60), [], []
    for i in range(120):
        bad = i % 5 == 0
        text = prose(g, int(g.integers(55, 90)))
        if bad:
            text = "!! ".join(text.upper().split()) + " $$$"
        elif i % 7 == 0:
            text += " " + passage
        rows.append((i, text, "en", f"host{i % 6}", len(text)))
        if i < 100:
            labels.append((i, int(not bad), 0))
    for i in range(120, 150):  # a host of short documents, and two good ones
        text = prose(g, 70 if i < 122 else 8)
        rows.append((i, text, "en", "short.example", len(text)))
    for i in range(150, 180):  # copies and near copies of earlier documents
        base = rows[1 + 5 * (i % 6)][1].split()
        if i % 2:
            base[int(g.integers(0, len(base)))] = "changed"
        text = " ".join(base)
        rows.append((i, text, None, f"host{i % 6}", len(text)))
    rows += [(180, None, "en", "host1", None), (181, "", None, None, 0), rows[1], rows[1], (182, prose(g, 60), "en", None, 1), (None, prose(g, 60), "en", "host2", 2)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def crc(i):
    import zlib

    return zlib.crc32(("null" if i is None else str(i)).encode())


def wanted():
    """What each stage leaves, in plain Python."""
    rows, labels = corpus()
    text = {r[0]: r[1] for r in rows}
    sample = [(text[i], q) for i, q, _ in labels if crc(i) % 5 != 0]
    score = brute.neighbour_scores(sample, [r[1] for r in rows])
    assert all(abs(s - 0.3) > 0.02 for s in score)  # no row hangs on the last digits
    one = [r for r, s in zip(rows, score) if s >= 0.3]
    keep, left = brute.kept_by_rules([(r[0], r[1], r[3]) for r in one]), []
    for r in one:
        if not brute.rules(r[1])[2] and r[0] in keep:
            left.append(r)
    two = left
    distinct = {r[0]: r for r in two if r[0] is not None}
    # Repeated rows count in the frequencies, so all rows go in, under numbers that keep the order of the ids.
    named = [r for r in two if r[0] is not None]
    classes = brute.near_classes([(r[0], k) for k, r in enumerate(named)], [r[1] for r in named])
    three = [r for k, r in enumerate(named) if classes[(r[0], k)] == (r[0], k)] + [r for r in two if r[0] is None]
    assert len(distinct) <= len(named)
    last = max(r[0] for r in rows if r[0] is not None) + 1
    cut = brute.without_repeats([(last if r[0] is None else r[0], r[1]) for r in three])
    four = []
    for r in three:
        words, gone = cut[last if r[0] is None else r[0]]
        t = b" ".join(words).decode() if gone else r[1]
        four.append((r[0], t, r[2], r[3], len(t) if gone else r[4]))
    return one, two, three, four


def test_stages_and_run(spark, folder):
    docs, want = spark.read.parquet(f"{folder}/documents.parquet"), wanted()
    assert len(want[0]) < 190 and len(want[1]) < len(want[0]) and len(want[2]) < len(want[1]) and any(a != b for a, b in zip(sorted(want[3], key=repr), sorted(want[2], key=repr)))
    assert not any(r[3] == "short.example" for r in want[1])  # its good documents go with their host
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(rows, key=repr), name
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.run(spark, folder).collect()
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    import pyarrow as pa

    size = {r[0]: len(x) // 2 + 1 for r, x in zip(want[3], words.encode(pa.array([r[1] for r in want[3]])))}
    total: dict = {}
    for r in got:
        assert r.doc_tokens == size[r.doc_id]
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == size
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * 4096 + r.offset for r in line] == list(np.cumsum([0] + [r.length for r in line])[:-1])


def test_stages_on_an_empty_table(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_stages_pass_other_columns_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40")
    more = docs.selectExpr("*", "map('a', doc_id) as score", "doc_id as n_words", "array(text) as _counts", "'x' as root", "1 as _id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert rows and all(r.score == {"a": i} and r.n_words == i and r._id == 1 for i, r in rows.items())


def test_intermediates_go_with_their_stage(spark, folder):
    before = [list(s) for s in _folders()]
    out = corpus_pipeline.STAGES[2][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    out.count()
    after = _folders()
    assert len(after) == len(before) == 1 and len(after[0]) <= len(before[0]) + 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tabulon_")]


def test_entry_has_every_query():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names) and "corpus_pipeline" in sys.modules
