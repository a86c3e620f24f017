"""Shards under size-tiered compaction, in DataFrame operations only.

append() adds a batch as small immutable files; its runs (one per arrival number) enter the manifest
with their sizes.  compact() sorts the small runs into tiers by size (each four times the one below),
joins runs of one tier in arrival order into files of about the target size, joins what stays below
it with other small shards of its tier, old ones too, until no tier has two, leaves alone the shards
that have reached it, and commits.

A manifest is a table of live shards.  Folders of data and manifests have names of their own, so writers never touch
each other's files; the one step that decides is the creation of the version's marker, which holds the manifest's
name and fails if another writer has made it.  A marker without content is a commit under way: readers take the
version before it, writers raise.  This asks exclusive creation of the file system (HDFS and most cloud stores give
it; the local one looks first, then creates).  expire() deletes what older versions alone name, and folders that no
version names once they are older than a grace period, so that writers under way keep theirs.

Runs are planned in blocks of consecutive arrivals, so that no task sees them all; a run larger than
the target is split over several shards by a hash of the row, so one huge arrival is no single task.

Defined cases: null or empty texts count no bytes and are kept; a null id belongs to arrival -1 in
the query; repeated rows are kept; an append of no rows commits a version without new runs; columns
of any other name pass through, those named as in RESERVED raise an error; a column that some appends lack is null there.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, shared_dir, table

#: Columns of the store itself; _home names the folder and _dir, in folders of shards, the shard.
RESERVED = ("_arrival", "_bytes", "_shard", "_tier", "_home", "_dir")
OWN = T.StructType([T.StructField("_arrival", T.LongType()), T.StructField("_bytes", T.LongType()), T.StructField("_shard", T.StringType()), T.StructField("_tier", T.IntegerType()), T.StructField("_home", T.StringType())])
MANIFEST = "folder string, shard string, arrival long, tier int, n_rows long, n_bytes long"


@dataclass
class Store:
    """A folder of shards: data/<name>, manifests/<name>, commits/<version>."""

    spark: SparkSession
    root: str
    target: int = 16 << 20
    smallest: int = 1 << 20
    block: int = 1024

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _markers(self) -> dict[int, int]:
        """Size of each version's marker."""
        fs, p = self._fs(f"{self.root}/commits")
        return {int(x.getPath().getName()): x.getLen() for x in fs.listStatus(p)} if fs.exists(p) else {}

    def versions(self) -> list[int]:
        return sorted(v for v, n in self._markers().items() if n)

    def _state(self, version: int | None = None) -> dict:
        """The marker's content: the manifest's name and the schema of the rows."""
        have = self.versions()
        if not have:
            return {"manifest": None, "schema": T.StructType([]).jsonValue()}
        fs, p = self._fs(f"{self.root}/commits/{version or have[-1]:08d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version (the newest one if None)."""
        name = self._state(version)["manifest"]
        if not name:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def commit(self, manifest: DataFrame, before: int, schema: T.StructType | None = None) -> int:
        """Writes the manifest and makes it version before + 1; raises if that version was or is being committed by another writer."""
        version, name = before + 1, f"{before + 1:08d}-{uuid.uuid4().hex}"
        fields = {f["name"]: f for f in self._state(before or None)["schema"]["fields"]}
        fields |= {f["name"]: f for f in (schema or T.StructType([])).jsonValue()["fields"]}
        folder = f"{self.root}/manifests/{name}"
        manifest.write.parquet(folder)
        fs, p = self._fs(f"{self.root}/commits/{version:08d}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            gone, at = self._fs(folder)
            gone.delete(at, True)
            raise RuntimeError(f"version {version} was committed by another writer") from e
        out.write(json.dumps({"manifest": name, "schema": {"type": "struct", "fields": list(fields.values())}}).encode())
        out.close()
        return version

    def _rows(self, folders: list[str], schema: T.StructType) -> DataFrame:
        """All rows of some folders of data (or of shards in them), read in one call."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def append(self, rows: DataFrame, arrival: Column, size: Column, most_rows: int = 2000) -> int:
        """Adds rows as files of at most most_rows rows; each arrival number becomes a run."""
        if clash := {x.lower() for x in rows.columns} & set(RESERVED):
            raise ValueError(f"reserved column names: {sorted(clash)}")
        before = (self.versions() or [0])[-1]
        home = uuid.uuid4().hex
        own = {"_arrival": arrival.cast("long"), "_bytes": size.cast("long"), "_shard": F.lit(None).cast("string"), "_tier": F.lit(None).cast("int"), "_home": F.lit(home)}
        full = rows.withColumns(own)
        full.write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).parquet(f"{self.root}/data/{home}")
        runs = self._rows([home], full.schema).groupBy("_arrival").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_bytes").alias("n_bytes"))
        new = runs.select(F.lit(home).alias("folder"), F.lit(None).cast("string").alias("shard"), F.col("_arrival").alias("arrival"), F.lit(None).cast("int").alias("tier"), "n_rows", "n_bytes")
        return self.commit(self.manifest(before or None).unionByName(new), before, rows.schema)

    def tier(self, size: Column) -> Column:
        """0 below smallest * 4, and one more for each further factor of four up to the target."""
        out, at = F.lit(0), self.smallest * 4
        while at < self.target:
            out, at = out + (size >= at).cast("int"), at * 4
        return out

    def plan(self, runs: DataFrame) -> DataFrame:
        """(folder, arrival, block, tier, part, pieces) of small runs: runs of a block and tier, in arrival order, fill parts of target bytes."""
        from pyspark.sql import Window

        sized = runs.withColumn("tier", self.tier(F.col("n_bytes"))).withColumn("block", F.floor(F.col("arrival") / self.block))
        line = Window.partitionBy("block", "tier").orderBy("arrival", "folder")
        before = F.sum("n_bytes").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_bytes")
        pieces = F.greatest(F.lit(1), F.floor(F.col("n_bytes") / self.target)).cast("int")
        return sized.withColumn("part", F.floor(before / self.target)).withColumn("pieces", pieces)

    def merged_again(self, units: list[tuple[int, int, str]]) -> list[tuple[list[str], int]]:
        """(names, tier) of shards to join, given (n_bytes, arrival, name) of those below the target: units of a tier, in
        arrival order, fill parts of target bytes, and so on with what comes out, until no tier has two below the target."""
        small, full = [(n, at, [name], None) for n, at, name in units], []
        while True:
            tiers: dict = {}
            for u in sorted(small, key=lambda u: (u[1], u[2])):
                tiers.setdefault(sum(u[0] >= self.smallest * 4 ** k for k in range(1, 32) if self.smallest * 4 ** k < self.target), []).append(u)
            if all(len(line) < 2 for line in tiers.values()):
                return [(names, tier) for _, _, names, tier in full + small if len(names) > 1]
            small = []
            for tier, line in tiers.items():
                parts, before = {}, 0
                for u in line:
                    parts.setdefault(before // self.target, []).append(u)
                    before += u[0]
                for part in parts.values():
                    u = part[0] if len(part) == 1 else (sum(x[0] for x in part), part[0][1], [y for x in part for y in x[2]], tier)
                    (small if u[0] < self.target else full).append(u)

    def compact(self) -> int:
        """Merges all small runs and shards and commits; rows move once, to the task of their new shard."""
        before = (self.versions() or [0])[-1]
        live = self.manifest(before or None)
        schema = T.StructType.fromJson(self._state(before or None)["schema"])
        schema = T.StructType([*schema.fields, *OWN.fields])
        runs, done = live.where("shard is null"), live.where("shard is not null")
        folders = [r["folder"] for r in runs.select("folder").distinct().collect()]  # one per append since the last compaction
        # Shards to merge again: all old ones below the target, and the last part of each block and tier of the new runs
        # (the parts before it were filled; one that came out below the target is an old one at the next compaction).
        unit = F.format_string("b%d-t%d-p%d", "block", "tier", "part")
        plan = self.plan(runs)
        last = plan.groupBy("block", "tier").agg(F.max("part").alias("part"))
        ends = plan.join(last, ["block", "tier", "part"]).groupBy(unit.alias("name")).agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n"), F.min("arrival").alias("arrival"), F.max("pieces").alias("pieces"))
        ends = ends.where(f"pieces = 1 and n < {self.target}").select("n", "arrival", "name")
        old = {f"{r['folder']}/{r['shard']}": r for r in done.where(f"coalesce(n_bytes, 0) < {self.target}").collect()}
        units = [tuple(r) for r in ends.collect()] if folders else []
        joins = self.merged_again(units + [(r["n_bytes"] or 0, r["arrival"], name) for name, r in old.items()])
        if not folders and not joins:
            return before
        to = [(name, f"m{k}-t{tier}", tier) for k, (names, tier) in enumerate(joins) for name in names]
        where = plan.select(F.col("folder").alias("_home"), F.col("arrival").alias("_arrival"), unit.alias("_unit"), F.col("tier").alias("_as"), "pieces")
        # The plan is broadcast only if its measured size allows it; else a join by arrival.
        piece = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in schema.fields if f.name not in RESERVED]), F.col("pieces"))
        placed = self._rows(folders, schema).join(where, ["_home", "_arrival"])
        placed = placed.withColumn("_shard", F.format_string("%s-%d", "_unit", F.when(F.col("pieces") > 1, piece).otherwise(F.lit(0)))).withColumn("_tier", F.col("_as")).drop("_as", "pieces")
        again = [name for name, _, _ in to if name in old]
        if again:  # only the folders of these shards are read
            some = self._rows([f"{old[n]['folder']}/_dir={old[n]['shard']}" for n in again], schema)
            placed = placed.unionByName(some.withColumn("_unit", F.concat("_home", F.lit("/"), "_shard")))
            done = done.where(~F.concat("folder", F.lit("/"), "shard").isin(again))
        home = uuid.uuid4().hex
        if to:
            moves = self.spark.createDataFrame(to, "_unit string, _into string, _as int")
            placed = placed.join(moves, "_unit", "left").withColumn("_shard", F.coalesce("_into", "_shard")).withColumn("_tier", F.coalesce("_as", "_tier")).drop("_into", "_as")
        placed = placed.drop("_unit").withColumn("_home", F.lit(home)).withColumn("_dir", F.col("_shard"))
        placed.repartition(partitions(self.spark), "_shard").write.partitionBy("_dir").option("compression", "zstd").parquet(f"{self.root}/data/{home}")
        new = self._rows([home], schema).groupBy("_shard").agg(F.min("_arrival").alias("arrival"), F.min("_tier").alias("tier"), F.count(F.lit(1)).alias("n_rows"), F.sum("_bytes").alias("n_bytes"))
        new = new.select(F.lit(home).alias("folder"), F.col("_shard").alias("shard"), "arrival", "tier", "n_rows", "n_bytes")
        return self.commit(done.unionByName(new), before)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with _arrival, _bytes, _tier and _shard (null before compaction)."""
        if not self.versions():
            raise ValueError("nothing was committed")
        live = self.manifest(version)
        schema = T.StructType.fromJson(self._state(version)["schema"])
        folders = [r["folder"] for r in live.select("folder").distinct().collect()]  # one per append or compaction
        rows = self._rows(sorted(folders), T.StructType([*schema.fields, *OWN.fields]))
        # A folder may hold shards that a later compaction has moved, so rows are held against the manifest.
        named = live.select(F.col("folder").alias("_f"), F.coalesce("shard", F.lit("")).alias("_s")).distinct()
        return rows.join(named, (F.col("_home") == F.col("_f")) & (F.coalesce("_shard", F.lit("")) == F.col("_s")), "left_semi").drop("_home")

    def expire(self, keep: int = 1, grace: float = 3600.0) -> None:
        """Deletes data that only versions before the last keep ones name, and data and manifests that no version
        names and that are grace seconds old.  Readers of the versions that stay lose nothing."""
        import time

        have = self.versions()
        kept, past = have[-keep:], have[:-keep]
        names = {v: self._state(v)["manifest"] for v in have}
        live: dict[str, set] = {}
        for v in kept:
            for r in self.manifest(v).groupBy("folder").agg(F.collect_set(F.coalesce("shard", F.lit(""))).alias("shards")).collect():
                live.setdefault(r["folder"], set()).update(r["shards"])
        known = set(live)
        for v in past:
            fs, p = self._fs(f"{self.root}/manifests/{names[v]}")
            if fs.exists(p):
                known.update(r["folder"] for r in self.manifest(v).select("folder").distinct().collect())
        now = time.time() * 1000
        fs, p = self._fs(f"{self.root}/data")
        for x in fs.listStatus(p) if fs.exists(p) else []:
            name = x.getPath().getName()
            if name not in live and (name in known or now - x.getModificationTime() > 1000 * grace):
                fs.delete(x.getPath(), True)
            elif name in live and "" not in live[name]:
                for y in fs.listStatus(x.getPath()):
                    if (shard := y.getPath().getName()).startswith("_dir=") and shard[5:] not in live[name]:
                        fs.delete(y.getPath(), True)
        fs, p = self._fs(f"{self.root}/manifests")
        for x in fs.listStatus(p) if fs.exists(p) else []:
            if (name := x.getPath().getName()) not in names.values() and now - x.getModificationTime() > 1000 * grace:
                fs.delete(x.getPath(), True)
        for v in past:  # markers stay: a slow writer must not take a number a second time
            fs, p = self._fs(f"{self.root}/manifests/{names[v]}")
            fs.delete(p, True)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents as arrivals of 500 ids, compacted into shards of about 16 MiB of text and read back."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, shared_dir(spark))
    store.append(docs, F.coalesce(F.floor(F.col("doc_id") / 500), F.lit(-1)), F.coalesce(F.octet_length("text"), F.lit(0)))
    store.compact()
    store.expire()
    return store.read().select("doc_id", F.col("_arrival").alias("arrival"), F.col("_tier").alias("tier"), F.col("_shard").alias("shard"), F.col("_bytes").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = r"""
with d as (
  select doc_id, text, coalesce(doc_id // 500, -1) as arrival, coalesce(strlen(text), 0)::bigint as n_bytes from documents),
r as (select arrival, sum(n_bytes)::bigint as b from d group by arrival),
t as (select *, (b >= 4194304)::int as tier, floor(arrival / 1024)::bigint as block from r),
p as (
  select *, ((sum(b) over (partition by block, tier order by arrival rows unbounded preceding) - b) // 16777216)::bigint as part,
         greatest(1, b // 16777216) as pieces from t)
select doc_id, arrival, tier, 'b' || block || '-t' || tier || '-p' || part || '-0' as shard, n_bytes, md5(text) as text_md5
from d join p using (arrival)
"""
