"""Fold, feed and snapshots against the sequential model."""

import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import model as m
from keyfold.operators import feed, fold
from keyfold.plans.skew import find_slices
from keyfold.session import work_dir
from keyfold.sources.log import EVENT_LOG
from keyfold.sources.snapshot import Snapshot
from keyfold.streaming import channels
from keyfold.streaming.pipeline import ChangePipeline

SPEC = m.SPEC


def frame(spark, rows):
    return spark.createDataFrame(rows, m.SCHEMA)


EDGE = [
    m.row("early", 1, "update", 1, None, True, False),
    m.row("gone", 2, "delete"),
    m.row("twice", 3, "create", 1, "x"),
    m.row("twice", 4, "create", 2, None, True, False),
    m.row("dead", 5, "create", 1, "x"),
    m.row("dead", 6, "delete"),
    m.row("dead", 7, "update", 9, "y", True, True),
    m.row("back", 8, "create", 1, "x"),
    m.row("back", 9, "delete"),
    m.row("back", 10, "create", None, "z"),
    m.row("null", 11, "create", 1, "x"),
    m.row("null", 12, "update", None, None, True, False),
    m.row("empty", 13, "create", 1, "x"),
    m.row("empty", 14, "update", None, None, False, False),
]


@pytest.mark.parametrize("rows", [EDGE, m.random_log(1, 1500, 40), m.random_log(2, 600, 3, hot=0.9)])
def test_fold_and_images_follow_the_model(spark, rows):
    log = frame(spark, rows)
    table, events = m.run(rows)
    state = fold.fold(log, SPEC)
    assert m.live(fold.records(state, SPEC, True)) == m.expected_live(table)
    assert m.events_of(feed.images(log, SPEC)) == sorted(events)
    got = sorted(map(tuple, feed.accepted(log, SPEC).collect()))
    assert got == sorted(e[:3] for e in events)


@pytest.mark.parametrize("group_rows", [5, 50, 400])
def test_hot_keys_are_cut_and_give_the_same_feed(spark, group_rows):
    rows = m.random_log(3, 1500, 20, hot=0.5)
    log = frame(spark, rows)
    slices = find_slices(log, SPEC.keys, SPEC.seq, group_rows)
    assert slices is not None and len(slices.cuts) >= 1
    _, events = m.run(rows)
    assert m.events_of(feed.images(log, SPEC, group_rows=group_rows)) == sorted(events)
    got = sorted(map(tuple, feed.accepted(log, SPEC, group_rows=group_rows).collect()))
    assert got == sorted(e[:3] for e in events)


def test_no_piece_of_a_hot_key_is_much_larger_than_asked(spark):
    # all rows of one key, most of them in a burst of the order column
    rows = [m.row("hot", i, "create", 1, "x") for i in range(500)]
    rows += [m.row("hot", 10_000_000 + i, "create", 1, "x") for i in range(3500)]
    log = frame(spark, rows)
    slices = find_slices(log, SPEC.keys, SPEC.seq, 400)
    sizes = log.groupBy(slices.column(SPEC.keys, SPEC.seq).alias("s")).count().collect()
    assert max(r["count"] for r in sizes) <= 500 and len(sizes) >= 8


def test_find_slices_sees_nothing_in_an_even_log(spark):
    rows = m.random_log(4, 500, 100, hot=0.0)
    assert find_slices(frame(spark, rows), SPEC.keys, SPEC.seq, 200) is None


@pytest.mark.parametrize("group_rows", [10**9, 30])
def test_stretches_compose(spark, group_rows):
    rows = m.random_log(5, 900, 15)
    table, events = m.run(rows)
    state, seen = None, []
    for lo, hi in ((0, 300), (300, 420), (420, 900)):
        part = frame(spark, [r for r in rows if lo <= r[1] < hi])
        seen += m.events_of(feed.images(part, SPEC, state, group_rows))
        state = fold.fold(part, SPEC) if state is None else fold.advance(state, part, SPEC)
    assert m.live(fold.records(state, SPEC, True)) == m.expected_live(table)
    assert sorted(seen) == sorted(events)


def test_repeated_rows_change_nothing(spark):
    rows = m.random_log(6, 400, 10)
    table, events = m.run(rows)
    twice = frame(spark, rows + rows[::3])
    assert m.live(fold.records(fold.fold(twice, SPEC), SPEC, True)) == m.expected_live(table)
    for group_rows in (10**9, 20):
        assert m.events_of(feed.images(twice, SPEC, group_rows=group_rows)) == sorted(events)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), keys=st.integers(1, 6), cut=st.integers(1, 79))
def test_random_logs(spark, seed, keys, cut):
    rows = m.random_log(seed, 80, keys, hot=0.3)
    table, events = m.run(rows)
    first, second = (frame(spark, [r for r in rows if (r[1] < cut) == early]) for early in (True, False))
    state = fold.fold(first, SPEC)
    after = fold.advance(state, second, SPEC)
    assert m.live(fold.records(after, SPEC, True)) == m.expected_live(table)
    got = m.events_of(feed.images(first, SPEC, group_rows=10)) + m.events_of(
        feed.images(second, SPEC, state, group_rows=10)
    )
    assert sorted(got) == sorted(events)


def test_an_empty_log_changes_nothing(spark):
    log = frame(spark, [])
    assert feed.images(log, SPEC).count() == 0 and feed.accepted(log, SPEC).count() == 0
    assert fold.fold(log, SPEC).count() == 0
    state = fold.fold(frame(spark, EDGE), SPEC)
    before = m.live(fold.records(state, SPEC, True))
    assert m.live(fold.records(fold.advance(state, log, SPEC), SPEC, True)) == before
    assert feed.images(log, SPEC, state).count() == 0


def test_publish_rows_are_not_stored(spark):
    rows = [m.row("x", 1, "create", 1, "a"), m.row("x", 2, "publish", 5, "b", True, True)]
    log = frame(spark, rows)
    assert fold.records(fold.fold(log, SPEC), SPEC).collect()[0]["a"] == 1
    assert feed.images(log, SPEC).count() == 1


def test_stream_equals_batch_across_restarts_replays_and_late_rows(spark):
    rows = m.random_log(7, 600, 12)
    table, events = m.run(rows)
    root = work_dir(spark, "test-pipeline")
    pipeline = ChangePipeline(spark, root, SPEC, m.SCHEMA, buckets=4, group_rows=40)
    replay = rows[50:80]
    for lo, hi in ((0, 200), (200, 350), (350, 600)):
        part = [r for r in rows if lo <= r[1] < hi]
        late = replay if lo == 350 else []
        frame(spark, part + late).write.mode("append").parquet(f"{root}/in")
        stream = channels.read_stream(spark, f"{root}/in", m.SCHEMA)
        pipeline.start(stream, available_now=True).awaitTermination()
    assert m.live(pipeline.table()) == m.expected_live(table)
    assert m.events_of(pipeline.feed()) == sorted(events)
    # a replayed row is late if its key has applied something since; all others were rejected again
    assert pipeline.late().count() > 0
    versions = pipeline.snapshot.head().version
    assert versions == 2
    first = m.run([r for r in rows if r[1] < 200])[0]
    assert m.live(pipeline.table(0)) == m.expected_live(first)


def test_a_batch_applied_twice_is_applied_once(spark):
    rows = m.random_log(8, 200, 6)
    pipeline = ChangePipeline(spark, work_dir(spark, "twice"), SPEC, m.SCHEMA, buckets=4)
    for _ in range(2):
        pipeline.process(frame(spark, rows), 0)
    table, events = m.run(rows)
    assert m.live(pipeline.table()) == m.expected_live(table)
    assert m.events_of(pipeline.feed()) == sorted(events)
    assert pipeline.snapshot.head().version == 0


def test_callbacks_hear_data_and_completion(spark):
    root, heard = work_dir(spark, "callbacks"), []
    listener = channels.Callbacks(
        lambda n: heard.append(n), lambda e: heard.append("error"), lambda: heard.append("done")
    )
    frame(spark, EDGE).write.parquet(f"{root}/in")
    spark.streams.addListener(listener)
    try:
        stream = channels.read_stream(spark, f"{root}/in", m.SCHEMA)
        channels.sink(stream, f"{root}/out", f"{root}/cp", available_now=True).awaitTermination()
        for _ in range(100):
            if "done" in heard:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert heard[-1] == "done" and sum(heard[:-1]) == len(EDGE)


def test_newest_version_is_found_among_many(spark):
    store = Snapshot(spark, work_dir(spark, "many"), frame(spark, EDGE).select("id", "a").schema, ("id",), 2)
    assert store.head() is None
    for version in range(6):
        rows = spark.createDataFrame([("k", version)], store.schema)
        assert store.commit(rows, batch_id=version * 10) == version
        assert store.head().version == version and store.head().batch_id == version * 10
    assert store.read().first()["a"] == 5 and store.read(2).first()["a"] == 2


def test_only_touched_buckets_are_rewritten(spark):
    pipeline = ChangePipeline(spark, work_dir(spark, "touch"), SPEC, m.SCHEMA, buckets=16)
    pipeline.process(frame(spark, [m.row(f"k{i}", i, "create", i, "x") for i in range(200)]), 0)
    pipeline.process(frame(spark, [m.row("k7", 300, "update", 1000, None, True, False)]), 1)
    head = pipeline.snapshot.head()
    assert sorted(head.held.values()).count(1) == 1 and len(head.held) == 16
    assert pipeline.table().count() == 200
    assert pipeline.table().filter(F.col("id") == "k7").first()["a"] == 1000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_is_one_shuffle_with_partial_aggregation(spark):
    text = plan(fold.fold(frame(spark, EDGE), SPEC))
    assert text.count("Exchange") == 1 and "partial_max_by" in text
    assert "Join" not in text and "Window" not in text


def test_feed_of_an_even_log_is_one_shuffle(spark):
    text = plan(feed.images(frame(spark, EDGE), SPEC))
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1


def test_a_change_is_in_the_feed_once_and_only_if_committed(spark, tmp_path, monkeypatch):
    from keyfold.sources import snapshot
    from keyfold.streaming import channels, pipeline

    log = spark.createDataFrame(
        [(k, s, "create", float(s), True, None, False) for s, k in enumerate((1, 2, 3, 1))],
        "id long, seq long, op string, value double, present_value boolean, props string, present_props boolean",
    ).selectExpr("id", "seq", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "op", "value", "props", "present_value", "present_props")
    own = pipeline.ChangePipeline(spark, str(tmp_path / "t"), EVENT_LOG, log.schema, buckets=4)
    commit, move = snapshot.Snapshot.commit, pipeline.move

    def fail(*_, **__):
        raise RuntimeError("lost")

    def heard():
        stream = channels.read_stream(spark, own.feed_path, own.spark.read.parquet(own.feed_path).schema)
        channels.sink(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    # lost before the commit: nothing is visible, and the batch may hold other rows later
    monkeypatch.setattr(snapshot.Snapshot, "commit", fail)
    with pytest.raises(RuntimeError):
        own.process(log, 0)
    assert own.snapshot.head() is None and not snapshot.path_exists(spark, own.feed_path)
    monkeypatch.setattr(snapshot.Snapshot, "commit", commit)
    own.process(log.where("seq < 3"), 0)
    assert heard() == 3
    # lost behind the commit: the next call finishes it
    monkeypatch.setattr(pipeline, "move", fail)
    with pytest.raises(RuntimeError):
        own.process(log.where("seq = 3"), 1)
    monkeypatch.setattr(pipeline, "move", move)
    assert heard() == 3
    own.process(log.where("seq = 3"), 1)
    assert heard() == 4 and own.feed().count() == 4
    # a table keeps its number of buckets
    wide = pipeline.ChangePipeline(spark, own.root, EVENT_LOG, log.schema, buckets=64)
    assert wide.table(keys=log.select("id")).count() == 3
