"""Every operator on nulls in every column, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import bpe, labelled, near_dedup, packing, quality_neighbours, quality_rules, sharding, substring_dedup, tiff, toxicity, url_filters

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Names that operators use inside; every one is also a column of the input here.
CLASHES = "doc copy sig bucket band root node rep block data part n ids place range start length score host n_words n_removed w k y text_ class_id doc_id_ _id _row _counts _fails kept page media value row x spread hit at window".split()
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)


def words(seed, n):
    g = np.random.default_rng(seed)
    return " ".join("".join(g.choice(list("abcdefgh"), 5)) for _ in range(n))


LONG = words(77, 60000) + " " + "z" * 100000
ROWS = [(1, words(1, 80), "a"), (2, words(1, 80), "a"), (1, words(1, 80), "a"), (3, None, None), (4, "", "b"), (5, " \n\t ", "b"), (6, LONG, "c"),
        (7, words(1, 40) + " " + words(2, 40), "a"), (None, words(1, 80), "a"), (None, None, None), (8, "one two three", "d"), (9, "é漢字。🎉 " * 60, "d"), (10, "x " * 200, "a"), (-5, words(9, 60), "")]


def table(spark, rows):
    return spark.createDataFrame([(*r, *(c for c in CLASHES)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=repr)


ALL = sorted((r[0] for r in ROWS), key=repr)


def test_rules(odd, none):
    got = quality_rules.judged(odd).collect()
    assert sorted((r.doc_id for r in got), key=repr) == ALL and quality_rules.judged(none).count() == 0
    for r in got:
        texts = {t for i, t, _ in ROWS if i == r.doc_id}
        assert (r.n_words, r.n_repeat_words, r.base_failed) in {brute.rules(t) for t in texts}
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns and quality_rules.kept_documents(none).columns == odd.columns and quality_rules.kept_documents(none).count() == 0
    assert ids(kept) == sorted(brute.kept_by_rules(ROWS), key=repr)
    assert {r.text for r in kept.collect()} <= {t for _, t, _ in ROWS}


def test_urls(spark):
    rows = [(1, None, None), (None, "http://A.NET/x", None), (2, "no scheme", "<link rel=canonical href=http://b.net/>"), (3, "", ""), (4, "http://ok.com/" + "q" * 200000, '<meta http-equiv=refresh content="0;url=http://EXAMPLE.com/de/1">'),
            (4, "http://ok.com/" + "q" * 200000, None), (5, "://", None), (6, "http://example.com/de/1", "<link rel=canonical href=''>" * 500), (7, "ftp://x.org/fr/y?net/#a", None)]
    pages = spark.createDataFrame([(*r, "h", "p", "n", "r") for r in rows], "page_id long, url string, html string, host string, path string, node string, root string")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_filters.judged(pages).collect()), key=repr)
    want = [(1, "", None, "allow"), (None, "a.net", "net/", "block"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "ok.com", None, "block"), (4, "ok.com", None, "block"), (5, "", None, "allow"), (6, "example.com", "example.com/de/", "block"), (7, "x.org", "org/fr/", "allow")]
    assert got == sorted(want, key=repr)
    assert url_filters.judged(pages.limit(0)).count() == 0


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(odd, path, keep_ids=True).collect()
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * 4096 + r.offset for r in line] == list(np.cumsum([0] + [r.length for r in line])[:-1])
    t = Tokenizer.from_file(path)
    want = sorted(sum(([(i, x)] * 1 for i, x in ((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x, _ in ROWS)), []), key=repr)
    have, pieces = [], sorted(got, key=lambda r: (repr(r.doc_id), r.sequence_id, r.offset))
    open_ = {}
    for r in pieces:  # pieces of one row lie one behind the other on the line
        mine = open_.setdefault(r.doc_id, [])
        if r.start == 0:
            mine.append([])
        mine[-1] += np.frombuffer(r.ids, "<u4").tolist()
        if r.start + r.length == r.doc_tokens:
            have.append((r.doc_id, tuple(mine.pop())))
    assert sorted(have, key=repr) == want and packing.packed(none, path).count() == 0


def test_substrings(spark, odd, none):
    got = substring_dedup.without_repeats(odd, counts=("n_words", "n_removed"))
    assert [c for c in got.columns if c not in ("n_words", "n_removed")] == [c for c in odd.columns if c not in ("n_words", "n_removed")]
    assert ids(got) == ALL and substring_dedup.without_repeats(none).count() == 0
    for spaced in (False, True):
        rows = substring_dedup.without_repeats(odd, spaced=spaced).collect()
        assert {(r.doc_id, r.n_removed) for r in rows if r.doc_id in (1, 2, 6, 7, None)} == {(1, 0), (2, 80), (6, 0), (7, 40), (None, 80), (None, 0)}
        for r in rows:
            first = {t for i, t, _ in ROWS if i == r.doc_id}
            if r.n_removed == 0 and not spaced:
                assert r.text in first
            elif r.n_removed == 0:
                assert r.text in {None if t is None else " ".join(x.decode() for x in brute.words(t)) for t in first}
    with pytest.raises(TypeError):
        substring_dedup.without_repeats(odd.withColumn("doc_id", F.lit("a")))


def test_scores(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, None), (7, None, 1), (None, 1, 1), (10, 0, 1), (10, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")):
        space = quality_neighbours.fitted(odd, given, "quality", lambda k: F.lit(True))
        got = quality_neighbours.scored(odd, space)
        assert ids(got) == ALL and [c for c in got.columns if c != "score"] == [c for c in odd.columns if c != "score"]
        assert all(0 <= r.score <= 1 for r in got.collect()) and quality_neighbours.scored(none, space).count() == 0
        model = toxicity.fitted(odd, given, "toxic", lambda k: F.lit(True))
        rows = toxicity.scored(odd, model).collect()
        assert sorted((r.doc_id for r in rows), key=repr) == ALL and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and toxicity.scored(none, model).count() == 0


def test_samples_are_bounded_though_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 5, i % 2) for i in range(50)], "doc_id long, quality int")
    rows = labelled.sample(docs, labels, "quality", lambda k: k != 3, 3).collect()
    assert len(rows) == 3 and all(r.y == 1 for r in rows)


def test_images(odd, none):
    media = tiff.imaged(odd)
    pages = tiff.decoded(media, "doc_id", "media").collect()
    assert sorted((r.doc_id for r in pages), key=repr) == ALL and all(r.error is None for r in pages)
    payload = sorted(((r.doc_id, bytes(r.pixels)) for r in pages), key=repr)
    raw = [(i, (t or "").encode()) for i, t, _ in ROWS]
    assert payload == sorted(((i, x + b"\0" * (-len(x) % 64 or 64 * (not x))) for i, x in raw), key=repr)
    assert tiff.imaged(none).count() == 0 and tiff.decoded(tiff.imaged(none), "doc_id", "media").count() == 0


def test_byte_pairs(odd, none):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(odd, path, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for i, t, _ in ROWS:
        x = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr) and bpe.encoded(none, path, public_tokenizers.PATTERN).count() == 0


def test_near_duplicates(odd, none):
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(odd).collect()), key=repr)
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, -5: -5, None: None}
    assert got == sorted(((i, want[i]) for i, _, _ in ROWS), key=repr) and near_dedup.classes(none).count() == 0
    kept = near_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and ids(kept) == sorted([1, 3, 4, 5, 6, 7, 8, 9, 10, -5, None, None], key=repr)
    assert near_dedup.kept_documents(none).count() == 0


def test_an_id_of_several_texts_joins_their_classes(spark):
    rows = [(5, words(1, 60), ""), (3, words(1, 60), ""), (5, words(2, 60), ""), (9, words(2, 60), ""), (5, None, ""), (7, words(3, 60), ""), (8, words(3, 60) + " end", ""), (7, words(4, 60), ""), (None, words(4, 60), "")]
    got = near_dedup.classes(table(spark, rows))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == sorted([(5, 3), (3, 3), (5, 3), (9, 3), (5, 3), (7, 7), (8, 7), (7, 7), (None, None)], key=repr)
    assert ids(near_dedup.kept_documents(table(spark, rows))) == sorted([3, 7, None], key=repr)


def test_near_classes_do_not_depend_on_the_layout(spark):
    g, texts = np.random.default_rng(6), []
    for k in range(60):
        w = words(k % 6, 50).split()
        for j in g.choice(50, g.integers(0, 4), False):
            w[j] = "q"
        texts.append(" ".join(w))
    docs = table(spark, [(i, t, "") for i, t in enumerate(texts)])
    want = brute.near_classes(list(range(60)), texts)
    for n in (1, 3, 17):
        assert {r.doc_id: r.class_id for r in near_dedup.classes(docs.repartition(n)).collect()} == want


def test_shards(spark, odd, none, tmp_path):
    size, arrival = F.coalesce(F.octet_length("text"), F.lit(0)), F.coalesce(F.col("doc_id"), F.lit(-1))
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=4000, smallest=100)
    store.append(odd, arrival, size)
    store.append(none, arrival, size)
    store.compact()
    got = store.read()
    assert ids(got) == ALL and got.select(*odd.columns).exceptAll(odd).count() == 0 and odd.exceptAll(got.select(*odd.columns)).count() == 0


def test_digests_of_queries(spark, tmp_path):
    """Contract columns of op3, op6 and op7 against their definitions, on whole small tables."""
    from tabulon.llm import queries

    rows = [r for r in ROWS if r[0] is not None]
    spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.QUERIES["op6_tiff"](spark, str(tmp_path)).collect():
        options = [(t or "").encode() for i, t, _ in rows if i == r.doc_id]
        padded = [x + b"\0" * (-len(x) % 64 or 64 * (not x)) for x in options]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in {(len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for x, p in zip(options, padded)}
    got = queries.QUERIES["op9_near_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got) == sorted([(1, 1, True), (1, 1, False), (2, 1, False), *((i, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, -5))])
