"""Tables by name, SQL over them, and query files."""
from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import DuplicateTableError, EngineError, NoSuchTableError, UnsupportedOperationError, translated
from ..sources import csv
from .dialect import name_of, rewritten, statements


def select(spark: SparkSession, sql: str) -> DataFrame:
    """spark.sql for queries only: what Spark parses as anything else is refused before it runs."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getName()
        if re.search(r"Command|Statement|plans\.logical\.(Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate|Replace|Overwrite|Append|Cache|Set|Show|Describe)", kind):
            raise UnsupportedOperationError(f"{kind.rsplit('.', 1)[1]}: only queries are run")
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return spark.sql(sql)


class Engine:
    """A registry of tables on a Spark session.  Names are case-sensitive for load and remove; SQL follows Spark."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.results = spark, {}, 0

    def register(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.tables:
            raise DuplicateTableError(name)
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return df

    def load(self, path: str, name: str | None = None) -> DataFrame:
        """Registers a CSV or Parquet file under name (its stem if None)."""
        stem = Path(path).name.split(".")[0]
        df = self.spark.read.parquet(path) if ".parquet" in path else csv.scan(self.spark, path)
        return self.register(name or stem, df)

    def load_folder(self, folder: str, names: set[str] | None = None) -> None:
        """Registers the folder's CSV and Parquet tables (only those in names, if given)."""
        for p in sorted(Path(folder).iterdir()):
            if p.suffix in (".csv", ".parquet") and (names is None or p.stem in names) and p.stem not in self.tables:
                self.load(str(p))

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise NoSuchTableError(name)
        return self.tables[name]

    def save(self, name: str, path: str) -> None:
        csv.write(self.table(name), path)

    def remove(self, name: str) -> None:
        self.table(name)
        self.spark.catalog.dropTempView(name)
        del self.tables[name]

    def details(self, name: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.table(name).schema}

    def columns(self) -> dict[str, dict[str, str]]:
        """Columns and types of every table, for the rewriter."""
        return {name: self.details(name) for name in self.tables}

    def sql(self, text: str) -> list[DataFrame]:
        """The result of each SELECT of text."""
        parts = statements(text)
        if not parts:
            raise EngineError("invalid SQL query")
        tables = self.columns()
        ready = [rewritten(p, tables) for p in parts]  # all are read before any runs
        try:
            return [select(self.spark, sql) for sql in ready]
        except EngineError:
            raise
        except Exception as e:
            raise translated(e) from e

    def query(self, text: str) -> DataFrame:
        """The single result of text, also kept as result_<i>."""
        found = self.sql(text)
        if len(found) != 1:
            raise EngineError(f"one SELECT expected, {len(found)} found")
        self.register(f"result_{self.results}", found[0])
        self.results += 1
        return found[0]


def run_query_file(spark: SparkSession, folder: str, query_file: str, out_dir: str = ".", prefix: str = "result") -> str:
    """Loads the tables that a query file names from a folder, runs it, and writes <prefix>_<stem>.csv."""
    text = Path(query_file).read_text()
    names = {name_of(t) for s in statements(text) for t in s}
    engine = Engine(spark)
    engine.load_folder(folder, names)
    try:
        (df,) = engine.sql(text)
        path = f"{out_dir}/{prefix}_{Path(query_file).stem}.csv"
        csv.write(df, path)
        return path
    finally:
        for name in list(engine.tables):
            engine.remove(name)
