import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agroloom.operators import dialog
from agroloom.streaming import keyed
from test_engine import talks

START = dt.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def streamed(spark, path, parts, make, name):
    """All rows of a stream that reads ``parts`` one batch after the other."""
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return sorted(map(str, spark.table(name).collect()))


def test_shuffled_turns_are_answered_in_order_of_time(rocks, tmp_path):
    turns = dialog.marked(talks(rocks)).withColumn("ts", F.lit(START) + F.make_dt_interval(mins=F.col("turn").cast("int"))).cache()
    kept = [c for c in turns.columns if c in ("conv_id", "ts", "turn", *dialog.TURN, *dialog.MARKS, *dialog.TOLD)]
    turns = turns.select(*kept)
    later = turns.limit(1).withColumns({"conv_id": F.lit(-1).cast("long"), "turn": F.lit(0).cast(turns.schema["turn"].dataType), "ts": F.lit(START + dt.timedelta(days=2))})
    parts = [turns.filter("turn % 2 = 1"), turns.filter("turn % 2 = 0").orderBy(F.desc("turn")), later]
    step = keyed.dialogue()
    got = streamed(rocks, tmp_path, parts, lambda s: keyed.in_stream(s, "conv_id", "ts", "turn", step, dialog.STATE_SCHEMA, late="1 hour", forget_ms=86_400_000), "in_order")
    batch = keyed.in_batch(turns, "conv_id", "ts", "turn", step, dialog.STATE_SCHEMA)
    assert got == sorted(map(str, batch.collect())) == sorted(map(str, dialog.resolved(turns).collect()))


CALLS = "source string, id long, ts timestamp, ok boolean, fresh long"
BROKEN, CACHED = "source string, id long, skipped boolean", "source string, id long, fetched boolean, value long"


def calls(spark, n=200):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, START + dt.timedelta(seconds=r.randrange(0, 400_000, 60)), r.random() < 0.6, i * 10) for i in range(n)]
    return spark.createDataFrame([*rows, (None, 900, START, False, None), ("a", None, START, None, 1)], CALLS)


def test_breaker_and_cache_stream_as_in_batch(rocks, tmp_path):
    rows = calls(rocks, 60)
    late = rocks.createDataFrame([("z", 1000, START + dt.timedelta(days=20), True, 1)], CALLS)
    dropped = rocks.createDataFrame([("a", 2000, START, False, 1), ("z", 1001, START + dt.timedelta(days=40), True, 1)], CALLS)
    for name, step, schema in (("broken", keyed.breaker("source"), BROKEN), ("cached", keyed.cache("source"), CACHED)):
        got = streamed(rocks, tmp_path / name, [rows, late, dropped], lambda s, step=step, schema=schema: keyed.in_stream(s, "source", "ts", "id", step, schema, late="10 days"), name)
        want = keyed.in_batch(rows.unionByName(late), "source", "ts", "id", step, schema).collect()
        assert [x for x in got if "id=1001" not in x] == sorted(map(str, want))


def test_steps_of_breaker_and_cache(spark):
    rows = spark.createDataFrame([("a", i, START + dt.timedelta(minutes=m), ok, i) for i, (m, ok) in enumerate([(0, False), (5, False), (9, True), (10, True), (1440, True), (1450, False), (1500, True)])], CALLS)
    broken = keyed.in_batch(rows, "source", "ts", "id", keyed.breaker("source"), BROKEN).orderBy("id").collect()
    assert [r.skipped for r in broken] == [False, True, True, False, False, False, False]
    cached = keyed.in_batch(rows, "source", "ts", "id", keyed.cache("source"), CACHED).orderBy("id").collect()
    assert [(r.fetched, r.value) for r in cached] == [(True, 0)] + [(False, 0)] * 3 + [(True, 4), (False, 4), (False, 4)]
    forgotten = keyed.in_batch(rows, "source", "ts", "id", keyed.cache("source"), CACHED, forget_ms=300_000).orderBy("id").collect()
    assert [r.fetched for r in forgotten] == [True, True, False, False, True, True, True]
    assert keyed.in_batch(rows.limit(0), "source", "ts", "id", keyed.breaker("source"), BROKEN).count() == 0


def test_breaker_on_repeated_rows_is_as_in_sql(spark, tmp_path):
    import duckdb

    from agroloom.plans import dialogue_queries

    rows = [("a", i, START + dt.timedelta(minutes=m), v) for i, m, v in [(3, 0, 10.0), (4, 1, 90.0), (4, 1, 90.0), (4, 1, 90.0), (5, 1, 90.0), (6, 2, 90.0), (7, 11, 90.0), (7, 11, 5.0), (8, 12, 1.0)]]
    rows += [(None, 9, START, 90.0), (None, 10, START + dt.timedelta(minutes=1), 90.0)]
    spark.createDataFrame(rows, "event_type string, event_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = dialogue_queries.source_breaker(spark, str(tmp_path)).select("event_type", "event_id", "skipped").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(dialogue_queries.BREAKER_SQL).fetchall()))


def test_times_without_a_zone_keep_their_distance_in_any_session_zone(spark, tmp_path):
    import duckdb

    from agroloom.plans import dialogue_queries

    days, r = (dt.datetime(2024, 3, 10), dt.datetime(2024, 11, 3)), random.Random(7)  # New York's clocks go on at 2, back at 2
    rows = [("ab"[i % 2], i, days[i % 3 % 2] + dt.timedelta(seconds=r.randrange(18_000)), r.choice([1.0, 90.0]), i % 5) for i in range(600)]
    spark.createDataFrame(rows, "event_type string, event_id long, ts timestamp_ntz, value double, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("source_breaker", "entry_cache"):
            got = dialogue_queries.QUERIES[name](spark, str(tmp_path)).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(dialogue_queries.SQL[name]).fetchall()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
