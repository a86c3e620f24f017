"""Commits of several writers, repeated compaction, expiry."""
import time

import pytest
from pyspark.sql import functions as F

from tabulon.llm.sharding import Store

def by(spark):
    return F.coalesce(F.floor(F.col("doc_id") / 2), F.lit(-1)), F.coalesce(F.octet_length("text"), F.lit(0))


def rows(spark, ids, text="x" * 300):
    return spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")


def held(store, version=None):
    return sorted(r.doc_id for r in store.read(version).collect())


class Racing(Store):
    """A writer that another one overtakes just before its commit."""

    def commit(self, manifest, before, schema=None):
        if self.other:
            other, self.other = self.other, None
            other()
        return super().commit(manifest, before, schema)


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_the_slower_of_two_writers_changes_nothing(spark, root):
    quick, slow = Store(spark, root, target=4000, smallest=100), Racing(spark, root, target=4000, smallest=100)
    quick.append(rows(spark, range(4)), *by(spark))
    for work in (lambda: slow.append(rows(spark, range(90, 99)), *by(spark)), slow.compact):
        have = held(quick)
        slow.other = lambda: quick.append(rows(spark, [50 + len(have)]), *by(spark))
        before = quick.manifest().count()
        with pytest.raises(RuntimeError):
            work()
        assert held(quick) == sorted([*have, 50 + len(have)]) and quick.manifest().count() == before + 1
    assert held(quick, 1) == [0, 1, 2, 3] and quick.versions() == [1, 2, 3]
    slow.other = None
    assert slow.compact() == 4 and held(slow) == held(quick, 3)


def test_a_marker_without_content_is_no_version(spark, root):
    store = Store(spark, root, target=4000, smallest=100)
    store.append(rows(spark, range(4)), *by(spark))
    fs, p = store._fs(f"{root}/commits/00000002")
    fs.create(p, False).close()
    assert store.versions() == [1] and held(store) == [0, 1, 2, 3]
    with pytest.raises(RuntimeError):
        store.append(rows(spark, [9]), *by(spark))
    assert held(store) == [0, 1, 2, 3]


def test_small_shards_merge_until_no_tier_has_two(spark, root):
    store = Store(spark, root, target=4000, smallest=100)
    for k in range(7):
        store.append(rows(spark, [2 * k, 2 * k + 1], "y" * 250), F.lit(k), by(spark)[1])
        store.compact()
        store.expire()
        live = store.manifest().where("n_bytes < 4000").groupBy(store.tier(F.col("n_bytes"))).count()
        assert live.where("count > 1").isEmpty()
    assert held(store) == list(range(14))


def test_expiry_leaves_kept_versions_and_writers_under_way(spark, root):
    store = Store(spark, root, target=4000, smallest=100)
    store.append(rows(spark, range(6)), *by(spark))
    store.compact()
    store.append(rows(spark, range(6, 8)), *by(spark))
    store.compact()
    rows(spark, [77]).write.parquet(f"{root}/data/underway")  # of a writer that has not committed
    store.expire(keep=2)
    assert held(store) == list(range(8)) and held(store, 3) == list(range(8))
    store.expire()
    assert held(store) == list(range(8))
    fs, p = store._fs(f"{root}/data/underway")
    assert fs.exists(p)
    time.sleep(1.1)
    store.expire(grace=1)
    assert not fs.exists(p) and held(store) == list(range(8))
    assert store.append(rows(spark, [9]), *by(spark)) == 5  # numbers are never used again


def test_columns_may_be_added_and_odd_rows_stay(spark, root):
    store = Store(spark, root, target=4000, smallest=100)
    store.append(spark.createDataFrame([(1, None), (None, ""), (1, None), (2, "z" * 9000)], "doc_id long, text string"), *by(spark))
    store.append(spark.createDataFrame([(3, "a", 0.5)], "doc_id long, text string, score double"), *by(spark))
    store.append(rows(spark, []), *by(spark))
    store.compact()
    got = sorted(((r.doc_id, r.text, r.score) for r in store.read().collect()), key=repr)
    assert got == sorted([(1, None, None), (None, "", None), (1, None, None), (2, "z" * 9000, None), (3, "a", 0.5)], key=repr)
    with pytest.raises(ValueError):
        store.append(rows(spark, [1]).withColumn("_SHARD", F.lit(1)), *by(spark))
    with pytest.raises(ValueError):
        Store(spark, root + "/none").read()
