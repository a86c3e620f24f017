from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon import queries
from tabulon.errors import DuplicateTableError, EngineError, NoSuchColumnError, NoSuchTableError, TableSizeMismatch, UnsupportedLiteralError, UnsupportedOperationError, UnsupportedOperatorError
from tabulon.functions import semantics as S
from tabulon.operators import relational as R
from tabulon.plans.dialect import rewritten, tokens
from tabulon.plans.engine import Engine, run_query_file, select
from tabulon.sources import csv

DATA = "/root/testdata/sf0.001"


def norm(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_oracle(spark, name):
    db = duckdb.connect()
    for t in queries.TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = db.sql(queries.ORACLES[name])
    cols, names = sorted(df.columns), list(want.columns)
    assert cols == sorted(names)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)


@pytest.fixture()
def shop(tmp_path):
    (tmp_path / "Staff.csv").write_text("Staff_id (N) (P),Name (T),Pay (N),Since (D)\n1,\"Doe, Ann\",100.5,2021-01-01 9:05:00\n2,Bo,80,2021-01-01 23:59:59\n\n3,Cy,,2021-01-02 00:00:00\r\n")
    (tmp_path / "Sales.csv").write_text("Sale_id (N),Staff_id (N),Amount (N)\n1,1,10\n2,1,20.25\n3,2,5\n")
    return tmp_path


def test_scan_types_and_tags(spark, shop):
    df = csv.scan(spark, str(shop / "Staff.csv"))
    assert dict(df.dtypes) == {"Staff_id": "bigint", "Name": "string", "Pay": "double", "Since": "timestamp_ntz"}
    assert [(r.Name, r.Pay) for r in df.orderBy("Staff_id").collect()] == [("Doe, Ann", 100.5), ("Bo", 80.0), ("Cy", None)]


def test_untagged_inference_is_deterministic(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d\n1,1.5,2023-01-15,3 Main St\n2,2,2023-01-16,Nancy\n")
    assert [k for _, k in csv.scan(spark, str(p)).dtypes] == ["bigint", "double", "timestamp_ntz", "string"]


def test_query_file_writes_csv(spark, shop):
    q = shop / "q.txt"
    q.write_text("SELECT e.Name, (SELECT SUM(s.Amount) FROM Sales s WHERE s.Staff_id = e.Staff_id) AS Total\nFROM Staff e\nORDER BY Total Desc")
    path = run_query_file(spark, str(shop), str(q), str(shop))
    assert open(path).read() == 'Name,Total\n"Doe, Ann",30.250000\nBo,5.000000\nCy,0.000000\n'


def test_dates_and_two_valued_logic(spark, shop):
    e = Engine(spark)
    try:
        e.load_folder(str(shop))
        ids = lambda q: sorted(r[0] for r in e.sql(q)[0].collect())
        assert ids("SELECT Staff_id FROM Staff WHERE Since = '2021-01-01'") == [1, 2]
        assert ids("SELECT Staff_id FROM Staff WHERE Since <= '2021-01-01'") == [1, 2]
        assert ids("SELECT Staff_id FROM Staff WHERE Since = '9:05:00'") == [1]
        assert ids("SELECT Staff_id FROM Staff WHERE Pay != 80") == [1, 3]
        assert ids("SELECT Staff_id FROM Staff WHERE NOT (Pay > 90)") == [2, 3]
        assert ids("SELECT Staff_id FROM Staff WHERE Pay ISNULL") == [3]
        assert e.sql("SELECT SUM(Pay) AS s FROM Staff WHERE Staff_id > 9")[0].first()[0] == 0
        with pytest.raises(NoSuchTableError):
            e.sql("SELECT * FROM Nowhere")
        with pytest.raises(NoSuchColumnError):
            e.sql("SELECT nothing FROM Staff")
        with pytest.raises(TableSizeMismatch):
            e.sql("SELECT Name, COUNT(*) AS n FROM Staff")
        with pytest.raises(UnsupportedOperationError):
            e.sql("DROP TABLE Staff")
        with pytest.raises(EngineError):
            e.sql("hello world")
    finally:
        for t in list(e.tables):
            e.remove(t)


def test_null_matching_and_null_sort(spark):
    a = spark.createDataFrame([(1,), (None,)], "x long")
    assert R.equi_join(a, a.toDF("y"), "x", "y").count() == 1
    assert R.equi_join(a, a.toDF("y"), "x", "y", null_equal=True).count() == 2
    b = spark.createDataFrame([(-5,), (None,), (5,)], "x long")
    assert [r.x for r in R.sort(b, "x", null_as_zero=True).collect()] == [-5, None, 5]
    assert b.where(S.ne(F.col("x"), 5, "bigint")).count() == 2


def test_cells_of_times_and_long_integers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("at (D),n,m,Name (x) (T)\n9:15:00,1234567890123456789,99999999999999999999,a\n2021-3-4,-9223372036854775808,1,b\nabc,1,2,\n")
    df = csv.scan(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("at", "timestamp_ntz"), ("n", "bigint"), ("m", "double"), ("Name", "string")]
    rows = df.collect()
    assert [str(r["at"]) for r in rows] == ["1970-01-01 09:15:00", "2021-03-04 00:00:00", "None"]
    assert [r["n"] for r in rows] == [1234567890123456789, -9223372036854775808, 1] and [r["Name"] for r in rows] == ["a", "b", ""]


def test_ragged_rows_and_repeated_names_are_errors(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        csv.scan(spark, str(tmp_path / "r.csv")).collect()
    (tmp_path / "d.csv").write_text("a (N),A (T)\n1,2\n")
    with pytest.raises(ValueError):
        csv.scan(spark, str(tmp_path / "d.csv"))


def test_sink_quotes_and_parts_agree(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 0.5, None), (2, " plain ", -2.0, "x")], "k long, s string, v double, n string").coalesce(1)
    csv.write(df, str(tmp_path / "one.csv"))
    csv.write_parts(df, f"file://{tmp_path}/parts")
    (part,) = (tmp_path / "parts").glob("part-*")
    want = 'k,s,v,n\n1,"a ""b"", c",0.500000,\n2, plain ,-2.000000,x\n'
    assert (tmp_path / "one.csv").read_text() == part.read_text() == want


COLUMNS = {"t": {"x": "bigint", "y": "double", "s": "string", "d": "timestamp_ntz"}, "tgt": {"x": "bigint"}}


@pytest.mark.parametrize("text, error", [
    ("WITH a AS (SELECT 1 AS x) INSERT INTO tgt SELECT * FROM a", UnsupportedOperationError),
    ("SELECT x FROM t WHERE d > 5", UnsupportedOperationError),
    ("SELECT SUM(d) FROM t", UnsupportedOperationError),
    ("SELECT SUM(x) OVER (ORDER BY y GROUPS 2 PRECEDING) AS n FROM t", UnsupportedOperationError),
    ("SELECT x FROM t WHERE x = 'abc'", EngineError),
    ("SELECT x FROM t WHERE d > 'hello'", EngineError),
    ("SELECT x FROM t WHERE s = x", EngineError),
    ("SELECT x FROM t WHERE x", UnsupportedLiteralError),
    ("SELECT x FROM t WHERE x = ?", UnsupportedLiteralError),
    ("SELECT x ^ 2 FROM t", UnsupportedOperatorError),
    ("SELECT x FROM t WHERE s = 'a' * 'b'", UnsupportedOperatorError),
    ("SELECT x FROM t WHERE x > ALL (SELECT x FROM tgt)", UnsupportedOperatorError),
    ("SELECT x FROM t WHERE", EngineError),
    ("SELECT x FROM t GROUP x", EngineError),
    ("DROP TABLE t", UnsupportedOperationError),
])
def test_refused_statements(text, error):
    with pytest.raises(error) as e:
        rewritten(tokens(text), COLUMNS)
    assert type(e.value) is error


@pytest.mark.parametrize("text, want", [
    ("SELECT x FROM t WHERE NOT x BETWEEN 1 AND 5", "SELECT x FROM t WHERE (NOT coalesce((x BETWEEN 1 AND 5), FALSE))"),
    ("SELECT TOP 3 x FROM t UNION SELECT x FROM tgt", "(SELECT x FROM t LIMIT 3) UNION SELECT x FROM tgt"),
    ("SELECT x FROM t WHERE x = 2.9", "SELECT x FROM t WHERE (x = CAST(2.9 AS BIGINT))"),
    ("SELECT x FROM t a WHERE a.x = (SELECT y FROM t)", "SELECT x FROM t AS a WHERE (a.x = (SELECT y FROM t LIMIT 1))"),
    ("SELECT SUM(x) FROM t", "SELECT coalesce(SUM(x), 0) AS x FROM t"),
    ("SELECT x FROM other.t FOR UPDATE OF t NOWAIT", "SELECT x FROM t"),
    ("SELECT 'it''s' AS q, \"x\" FROM t -- end", "SELECT 'it\\'s' AS q, `x` FROM t"),
])
def test_rewritten_text(text, want):
    assert rewritten(tokens(text), COLUMNS) == want


def test_commands_never_run(spark):
    for text in ("CREATE TABLE zz AS SELECT 1 AS a", "WITH a AS (SELECT 1 AS x) INSERT INTO tgt SELECT * FROM a", "SET a.b = 1", "DROP VIEW IF EXISTS zz"):
        with pytest.raises(UnsupportedOperationError):
            select(spark, text)


def test_prompt_commands(spark, shop, monkeypatch):
    from tabulon import cli

    e = Engine(spark)
    try:
        assert cli.command(e, f"load {shop}/Staff.csv Crew") == "loaded Crew"
        with pytest.raises(DuplicateTableError):
            cli.command(e, f"load {shop}/Staff.csv Crew")
        assert "Pay" in cli.command(e, "details Crew") and "Ann" in cli.command(e, "show Crew 0 1")
        assert "Spark decides" in cli.command(e, "cfg mTE 5") and cli.command(e, "dummy") == "ok"
        monkeypatch.setattr("sys.stdin", iter(["SELECT Name", "FROM Crew WHERE Pay > 90", ".", "never read"]))
        assert "Ann" in cli.command(e, "editor")
        assert "result_0" in e.tables and cli.command(e, f"save result_0 {shop}/out.csv") and (shop / "out.csv").read_text().startswith("Name\n")
        assert cli.command(e, "remove Crew") == "removed Crew"
        with pytest.raises(NoSuchTableError):
            cli.command(e, "remove Crew")
    finally:
        for t in list(e.tables):
            e.remove(t)


def test_average_of_many_times_is_exact(spark):
    rows = spark.range(40_000).selectExpr("id AS k", "id % 3 AS g", "timestamp_ntz '1969-12-31 23:59:59.999999' + make_dt_interval(cast(id % 9000 AS int), 0, 0, cast(id * 0.000001 AS decimal(18, 6))) AS t")
    e = Engine(spark)
    e.register("many_times", rows.unionAll(spark.sql("SELECT -1L, 0L, CAST(NULL AS timestamp_ntz)")))
    try:
        micros = {r.k: (r.g, r.d * 86_400_000_000 + r.k - 1) for r in rows.selectExpr("k", "g", "k % 9000 AS d").collect()}  # its microseconds since 1970

        def mean(values):
            return datetime(1970, 1, 1) + timedelta(microseconds=(2 * sum(values) + len(values)) // (2 * len(values)))

        assert e.sql("SELECT AVG(t) AS m FROM many_times")[0].first().m == mean([m for _, m in micros.values()])
        got = {r.g: (r.m, r.d) for r in e.sql("SELECT g, AVG(t) FILTER (WHERE k < 20000) AS m, AVG(CAST(t AS DATE)) AS d FROM many_times GROUP BY g")[0].collect()}
        assert {g: m for g, (m, _) in got.items()} == {g: mean([m for k, (h, m) in micros.items() if h == g and k < 20_000]) for g in range(3)}
        assert {g: d for g, (_, d) in got.items()} == {g: mean([m // 86_400_000_000 * 86_400_000_000 for h, m in micros.values() if h == g]) for g in range(3)}
        assert e.sql("SELECT AVG(DISTINCT t) AS m FROM many_times WHERE k < 2")[0].first().m == mean([-1, 86_400_000_000])
        window = e.sql("SELECT k, AVG(t) OVER (ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM many_times WHERE k < 3")[0].collect()
        assert {r.k: r.m for r in window} == {-1: None, 0: mean([-1]), 1: mean([-1, 86_400_000_000]), 2: mean([86_400_000_000, 2 * 86_400_000_000 + 1])}
        assert e.sql("SELECT AVG(t) AS m FROM many_times WHERE k > 99999")[0].first().m == datetime(1970, 1, 1)
    finally:
        e.remove("many_times")
