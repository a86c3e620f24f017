import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import bpe, near_dedup, packing, quality_neighbours, quality_rules, sharding, substring_dedup, tiff, toxicity, url_filters
from tabulon.llm.components import components

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, n_words long, score double, host string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "s" if i % 2 else None, 7, 0.5, "h") for i, t in enumerate(texts)], SCHEMA)


def words(seed, n):
    g = np.random.default_rng(seed)
    return " ".join("".join(g.choice(list("abcdefgh"), 5)) for _ in range(n))


HARD = [None, "", "  \n ", "a", "x " * 3000, words(1, 200), words(1, 200), "é漢 🎉 " * 40]


def test_rules_count_and_keep(spark):
    text = "\n".join(["one two three four"] * 3 + [words(2, 60)]) + " #*"
    got = {r.doc_id: r for r in quality_rules.judged(docs(spark, [text, *HARD])).collect()}
    assert got[0].n_repeat_words == 12 and got[0].n_dup_lines == 2 and got[0].n_symbols == 2 and got[0].kept
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert quality_rules.judged(docs(spark, [])).count() == 0
    assert {r.doc_id for r in quality_rules.kept_documents(docs(spark, [text, *HARD])).collect()} == {i for i, r in got.items() if r.kept}


def test_redirects_spread_blocks_and_allows_win(spark):
    link = '<html><link rel="canonical" href="{}"></html>'.format
    rows = [(1, "http://bad.net/x", None), (2, "http://fine.com/a#top", link("http://bad.net/x")), (3, "http://other.com/b", '<meta http-equiv="refresh" content="0; url=http://fine.com/a">'),
            (4, "http://plain.com/", None), (5, "http://good.com/z", link("http://www.example.net/en/1")), (6, "http://w.com/", link("http://bad2.net/")), (7, "http://v.com/", link("http://example.net/en/2")), (8, None, None), (9, "http://w.com/", link("http://example.net/en/2"))]
    got = {r.page_id: r.verdict for r in url_filters.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}


def test_components_match_union_find(spark):
    g = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in g.integers(0, 120, (90, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def test_packing_covers_every_token_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(docs(spark, HARD), path, keep_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * 4096 + r.offset for r in line] == list(np.cumsum([0] + [r.length for r in line])[:-1])
    for i, text in enumerate(HARD):
        want = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == want.tobytes() and all(r.ids_crc32 == zlib.crc32(r.ids) for r in mine)
    assert packing.packed(docs(spark, []), path).count() == 0


def test_windows_against_brute_force(spark):
    shared = words(5, 60)
    texts = [*HARD, words(6, 30) + " " + shared, shared + " " + words(7, 20), words(8, 9) + " " + shared + " end", None]
    ids = [*range(len(texts) - 1), None]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(docs(spark, texts, ids)).collect()}
    cut = [(t or "").split() for t in texts]
    first = {}
    for i, w in enumerate(cut):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in enumerate(cut[:-1]):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert got[i].n_removed == len(gone) and got[i].text.split() == [x for j, x in enumerate(w) if j not in gone] if texts[i] else got[i].n_removed == 0


def test_bpe_matches_the_library(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*HARD, "a" * 3000, " it's\x1c  x y\n\n 12", "ab" * 500]
    got = {r.doc_id: r for r in bpe.encoded(docs(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("code, decode", [(tiff.packbits, tiff.unpackbits), (tiff.lzw, tiff.unlzw)])
def test_tiff_codes_round_trip(code, decode):
    g = np.random.default_rng(1)
    for n in (1, 2, 127, 128, 129, 5000, 40000):
        for data in (bytes(n), g.integers(0, 3, n, np.uint8).tobytes(), g.integers(0, 256, n, np.uint8).tobytes()):
            assert decode(code(data), n) == data


def test_tiff_pages_and_damage(spark):
    payload = [words(9, 2000).encode()[: 64 * k] for k in (1, 20, 40, 180)] + [bytes(64) * 5000]
    files = [tiff.stored_bytes(p) for p in payload] + [b"II*\0", None, b"junk"]
    rows = tiff.decoded(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "k long, f binary"), "k", "f").collect()
    assert [bytes(r.pixels) for r in sorted(rows, key=lambda r: r.k)[:5]] == payload
    assert all(r.error for r in rows if r.k > 4)
    assert tiff.imaged(docs(spark, HARD)).where("n_bytes = 0").count() == 2


def test_classifiers_on_odd_input(spark):
    good = [words(i, 40) for i in range(40)]
    bad = ["!! ".join(words(100 + i, 40).upper().split()) + " $$$" for i in range(40)]
    all_docs = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 40), int(i % 2)) for i in range(80)] + [(None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    space = quality_neighbours.fitted(all_docs, labels, "quality", lambda k: k % 4 != 0)
    got = {r.doc_id: r.score for r in quality_neighbours.scored(all_docs, space).collect()}
    assert all((got[i] >= 0.5) == (i < 40) for i in range(80)) and 0 <= got[80] <= 1
    none = quality_neighbours.fitted(all_docs, labels.where("false"), "quality", lambda k: F.lit(True))
    assert {r.score for r in quality_neighbours.scored(all_docs, none).collect()} == {0.5}


def test_toxicity_learns_marked_words(spark):
    texts = [words(i, 30) + (f" grobian{'xyz'[i % 3]} vile" if i % 3 == 0 else "") for i in range(120)] + [None]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fitted(docs(spark, texts), labels, "toxic", lambda k: k < 90)
    got = {r.doc_id: r.score for r in toxicity.scored(docs(spark, texts), model).collect()}
    assert all((got[i] >= 0.7) == (i % 3 == 0) for i in range(90, 120)) and 0 <= got[120] < 0.7


def test_near_duplicates_against_brute_force(spark):
    g = np.random.default_rng(4)
    texts = []
    for k in range(12):
        base = words(50 + k, 120).split()
        for _ in range(5):
            w = list(base)
            for j in g.integers(0, 120, g.integers(0, 5)):
                w[j] = "zz"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "one two", words(99, 50)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, texts)).collect()}
    assert got == brute.near_classes(list(range(len(texts))), texts)


@pytest.mark.parametrize("n, block", [(600, 40), (600, 2048), (1200, 2048)])
def test_near_copies_in_a_large_group_keep_every_class(spark, monkeypatch, n, block):
    monkeypatch.setattr(near_dedup, "linked", functools.partial(near_dedup.linked, block=block))
    g, base, texts = np.random.default_rng(n), [f"w{j}" for j in range(200)], []
    for _ in range(n):  # up to eight edits each, so that many pairs lie on either side of 0.8
        w = list(base)
        for j in g.choice(200, g.integers(0, 9), False):
            w[j] = f"z{g.integers(1 << 30)}"
        texts.append(" ".join(w))
    texts += [f"u{i} v{i} x{i} y{i} z{i} t{i}" for i in range(500)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, texts)).collect()}
    want = brute.near_classes(list(range(len(texts))), texts)
    assert got == want and n / 4 < len({want[i] for i in range(n)}) < n


def test_shards_commit_once(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=4000, smallest=100)
    rows = docs(spark, HARD)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    store.append(rows, F.floor(F.col("doc_id") / 2), size)
    store.append(rows, F.floor(F.col("doc_id") / 2) + 10, size)
    assert store.compact() == 3 and store.versions() == [1, 2, 3]
    assert store.read().count() == 2 * len(HARD) and store.manifest().agg(F.sum("n_rows")).first()[0] == 2 * len(HARD)
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), 2)
    store.expire()
    assert store.read().select("doc_id", "text").exceptAll(rows.union(rows).select("doc_id", "text")).count() == 0


def test_word_ids_match_single_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["  a1b2   zz", "İstanbul naïve éte straße", "don't it's 'll x's", "<|endoftext|> a", " ".join(f"w{'xyz'[i % 3] * (i % 7)}o" for i in range(900)), "数据 данные ªº ﬁn ǅ", ""]
    assert packing.WordIds(path).encode(pa.array(texts)) == [np.array(t.encode(x, add_special_tokens=False).ids, np.uint16).tobytes() for x in texts]


def test_near_duplicates_hidden_behind_closer_samples(spark):
    def changed(base, at, tail, mark):
        out = list(base)
        for j in [6 * k + 4 for k in at] + list(range(len(base) - tail, len(base))):
            out[j] = f"{mark}x{j}"
        return out

    g = np.random.default_rng(12)
    texts, want = [], {}
    for f in range(8):  # two documents just above 0.8 of each other, each among 60 just below 0.8 of it
        one = [f"f{f}w{j}" for j in range(600)]
        two = changed(one, g.choice(97, 13, False), 0, f"t{f}")
        decoys = [changed(base, g.choice(97, 13, False), 3, f"d{f}b{b}n{n}") for b, base in enumerate((one, two)) for n in range(60)]
        family = [*decoys, one, two]
        order = g.permutation(len(family))
        at = {int(x): len(texts) + k for k, x in enumerate(order)}
        pair = (at[len(decoys)], at[len(decoys) + 1])
        want |= {i: i for i in at.values()} | {max(pair): min(pair)}
        texts += [family[x] for x in order]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in family]
        alike = {(i, j) for i in range(len(family)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert alike == {(len(decoys) + 1, len(decoys))}
    filler = [f"u{i} v{i} y{i}" for i in range(int(122 / near_dedup.COMMON))]  # so that no family's shingle is common
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, [" ".join(t) if isinstance(t, list) else t for t in [*texts, *filler]])).collect()}
    assert {i: got[i] for i in want} == want


def test_shards_climb_tiers_over_many_compactions(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=4000, smallest=100)
    for k in range(6):
        rows = docs(spark, ["x" * 300, "y" * 500], [2 * k, 2 * k + 1])
        store.append(rows, F.lit(k), F.octet_length("text"))
        store.compact()
    shards = store.manifest().collect()
    sizes = sorted(r.n_bytes for r in shards)
    assert sum(sizes) == 4800 and sum(n < 4000 for n in sizes) <= 3 and len(sizes) < 4 and all(r.shard for r in shards)
    full = {(r.folder, r.shard) for r in shards if r.n_bytes >= 4000}
    store.expire()
    store.append(docs(spark, ["z" * 50], [99]), F.lit(9), F.octet_length("text"))
    store.compact()
    store.expire()
    assert full and full <= {(r.folder, r.shard) for r in store.manifest().collect()}
    assert sorted((r.doc_id, len(r.text)) for r in store.read().collect()) == [(i, 500 if i % 2 else 300) for i in range(12)] + [(99, 50)]


def test_alias_targets_of_every_form(spark):
    refresh, long = '<meta http-equiv="refresh" content="0; url={}">'.format, "q" * 6000
    rows = [(1, "http://www.example.com/x", refresh("/de/y")), (2, "http://a.com/b", refresh("//bad.net/x")), (3, "http://www.example.com/a/b", refresh("../de/z?k=1")),
            (4, "http://c.com/", refresh(f"http://bad.net/{long}")), (5, "http://d.com/", '<link rel="nofollow Canonical" href="http://bad.net/1">'),
            (6, "http://e.com/", refresh("http://f.com/?a=1&amp;b=&#50;&#x33;")), (7, "http://f.com/?a=1&b=23", refresh("http://bad.net/2")), (8, "http://g.com/", "<link rel=stylesheet href=http://bad.net/canonical>")]
    got = {r.page_id: r.verdict for r in url_filters.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" for k in range(1, 8)} | {8: "allow"}
