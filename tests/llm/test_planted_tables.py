"""Whole queries over planted tables against DuckDB: a bad host, chains and clusters of aliases, repeated passages."""
import duckdb
import numpy as np
import pytest

from tabulon.llm import queries, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(g, n):
    return " ".join("".join(g.choice(list("abcdefgh"), g.integers(3, 8))) for _ in range(n))


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = db.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got, names = df.collect(), list(want.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    return got


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    g, rows = np.random.default_rng(12), []
    passage = prose(g, 70)
    for i in range(400):
        host = "bad.example" if i % 10 == 0 else "noisy.example" if i % 10 == 1 else f"host{i % 9}"
        text = prose(g, int(g.integers(52, 120)))
        if host == "bad.example" and i % 20:
            text = prose(g, 9)
        if host == "noisy.example" and i % 3:
            text = " ".join(w + " ###" if k % 2 else w for k, w in enumerate(text.split()))
        if i % 17 == 0:
            text = passage[: int(g.integers(100, 400))] + "\n" + text + "\n" + passage
        rows.append((i, text, "en", host, len(text)))
    rows += [(400, None, "en", "host1", 0), (401, "", "en", None, 0), (402, rows[3][1], "en", "host2", 0)]
    at = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_bad_hosts_are_rejected(spark, folder):
    got = same(spark, folder, "op1_quality_rules")
    rejected = {r.host for r in got if r.host_rejected}
    assert rejected == {"bad.example", "noisy.example"}
    assert any(not r.base_failed and not r.kept for r in got) and all(r.kept for r in got if not r.base_failed and r.host not in rejected)


def test_repeats_and_shards(spark, folder):
    assert sum(r.n_removed for r in same(spark, folder, "op4_substring_dedup")) > 1000
    same(spark, folder, "op10_sharding")


#: Pages whose aliases are found by a recursive query over undirected links.
RECURSIVE = """
with recursive edge as (select a, b from links union select b, a from links),
reach as (select a as node, a as other from edge union select r.node, e.b from reach r join edge e on r.other = e.a),
rule as (select node, case when ends_with(split_part(split_part(node, '://', 2), '/', 1), '.net') and not starts_with(node, 'http://example.net/en/') then 'block' when starts_with(node, 'http://example.net/en/') then 'allow' end as v from (select node from reach union select url from pages)),
spread as (select r.node, max((v = 'allow')::int) as yes, max((v = 'block')::int) as no from reach r join rule on r.other = rule.node group by r.node)
select page_id, coalesce(rule.v, case when yes = 1 then 'allow' when no = 1 then 'block' end, 'allow') as verdict
from pages left join rule on url = rule.node left join spread on url = spread.node
"""


def test_aliases_match_a_recursive_query(spark):
    g = np.random.default_rng(9)
    urls = [f"http://site{i}.com/p" for i in range(250)] + [f"http://b{i}.net/x" for i in range(12)] + [f"http://example.net/en/{i}" for i in range(6)]
    order = g.permutation(len(urls)).tolist()
    links = {k: urls[order[(order.index(k) + 1) % len(urls)]] for k in order[:60]}  # one long chain
    for k in g.choice(250, 110, False).tolist():
        links.setdefault(k, urls[int(g.integers(0, len(urls)))])
    rows = []
    for k, u in enumerate(urls):
        to = links.get(k)
        html = None if to is None else f'<link rel="canonical" href="{to}">' if k % 2 else f'<meta http-equiv="Refresh" content="3; URL=\'{to}\'">'
        rows.append((k, u, html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    db = duckdb.connect()
    db.execute("create table links(a varchar, b varchar)")
    db.execute("create table pages(page_id bigint, url varchar)")
    db.executemany("insert into links values (?, ?)", [(urls[k], v) for k, v in links.items() if urls[k] != v])
    db.executemany("insert into pages values (?, ?)", [(k, u) for k, u, _ in rows])
    want = sorted(db.sql(RECURSIVE).fetchall())
    got = sorted((r.page_id, r.verdict) for r in url_filters.judged(pages).collect())
    assert got == want
    by = [r.decided_by for r in url_filters.judged(pages).collect()]
    assert by.count("alias") > 30 and {"rule", "default"} <= set(by)
