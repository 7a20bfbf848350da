"""Upserts, compaction and crashes of the review store against a plain dictionary."""

import random

import pytest

from agroloom.operators.review_store import ReviewStore
from agroloom.sources import shared

SCHEMA = "id string, changed long, created long, status string, verdict string"


def held(store):
    return {r.id: (r.changed, r.status, r.verdict) for r in store.rows().collect()}


def test_store_equals_a_dictionary(spark, tmp_path):
    r, store, want = random.Random(1), ReviewStore(spark, str(tmp_path / "s"), SCHEMA), {}
    assert held(store) == {} and store.compact() == 0
    for batch in range(5):
        rows = {f"i{k}": (f"i{k}", r.randrange(100) * 10 + batch, k, r.choice(["pending", "reviewed"]), None) for k in r.sample(range(90), 30)}
        store.upsert(spark.createDataFrame(list(rows.values()), SCHEMA))
        for i, row in rows.items():
            want[i] = max(want.get(i, (-1,)), (row[1], row[3], row[4]))
        if batch == 3:
            assert 0 < store.compact(3) <= 64
    assert held(store) == want
    got = [x.created for x in store.items("pending").collect()]
    assert got == sorted(got, reverse=True) and len(got) == sum(s == "pending" for _, s, _ in want.values())


def test_a_crash_between_write_and_switch_loses_nothing(spark, tmp_path, monkeypatch):
    store = ReviewStore(spark, str(tmp_path / "s"), SCHEMA)
    store.upsert(spark.createDataFrame([("a", 1, 1, "pending", None), ("b", 1, 2, "pending", None)], SCHEMA))
    before = held(store)

    def crash(*_):
        raise OSError("the driver died")

    import agroloom.operators.review_store as module

    with monkeypatch.context() as m:
        m.setattr(module, "commit_version", crash)
        for work in (lambda: store.upsert(spark.createDataFrame([("a", 2, 1, "reviewed", "unsafe")], SCHEMA)), lambda: store.compact(1)):
            with pytest.raises(OSError, match="died"):
                work()
            assert held(store) == before
    store.upsert(spark.createDataFrame([("a", 2, 1, "reviewed", "unsafe")], SCHEMA))
    assert held(store)["a"] == (2, "reviewed", "unsafe") and held(store)["b"] == before["b"]


def test_two_writers(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"), SCHEMA)
    store.upsert(spark.createDataFrame([("a", 1, 1, "pending", None)], SCHEMA))
    with pytest.raises(RuntimeError, match="someone else"):
        shared.commit_version(spark, store.path, {"version": 1, "buckets": {}})
    assert set(held(store)) == {"a"}
