"""Deliveries to handlers, declared filters on live channels, changes between versions."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import model as m
from keyfold.api import Database
from keyfold.session import work_dir
from keyfold.sources.log import LogSpec
from keyfold.streaming import channels
from keyfold.streaming.delivery import Deliveries, DeliveryFailed, Subscription
from keyfold.streaming.pipeline import ChangePipeline

SCHEMA = "id long, seq long, op string, value double"


def batch(spark, first, n=10):
    rows = [(i, i, ("create", "update", "delete", "publish")[i % 4], float(i)) for i in range(first, first + n)]
    return spark.createDataFrame(rows, SCHEMA)


def collector(heard, name, fails=()):
    """A handler that notes what it is given; it fails as often as ``fails`` says for a batch."""
    left = dict(fails)

    def on_data(events, number):
        if left.get(number, 0):
            left[number] -= 1
            raise ValueError(f"{name} is broken")
        heard.append((name, number, sorted(r["seq"] for r in events.collect())))

    return on_data


def test_a_failing_handler_is_asked_again_and_the_others_are_not(spark):
    heard, errors = [], []
    root = work_dir(spark, "handlers")
    listeners = [
        Subscription("broken", "update", collector(heard, "broken", {0: 2, 1: 4}), on_error=errors.append),
        Subscription("sound", "delete", collector(heard, "sound")),
        Subscription("some", "update", collector(heard, "some"), [{"field": "value", "operator": "gt", "value": 3}]),
    ]
    deliveries = Deliveries(spark, root, listeners, tries=3)
    deliveries.deliver(batch(spark, 0), 0)
    assert heard == [("broken", 0, [1, 3, 5, 7, 9]), ("sound", 0, [2, 6]), ("some", 0, [5, 7, 9])] and not errors
    heard.clear()
    with pytest.raises(DeliveryFailed) as failure:
        deliveries.deliver(batch(spark, 10), 1)
    assert failure.value.names == ["broken"] and len(errors) == 1
    assert [h[0] for h in heard] == ["sound", "some"]
    assert [deliveries.delivered(s.name) for s in listeners] == [0, 1, 1]
    heard.clear()
    Deliveries(spark, root, listeners, tries=3).deliver(batch(spark, 10), 1)  # a later run
    assert heard == [("broken", 1, [11, 13, 15, 17, 19])]
    heard.clear()
    deliveries.deliver(batch(spark, 10), 1)
    assert heard == [] and deliveries.delivered("never heard of") == -1
    with pytest.raises(ValueError):
        Deliveries(spark, root, [listeners[0], listeners[0]])


def test_a_stream_goes_on_where_a_handler_failed(spark):
    heard = []
    root = work_dir(spark, "handled-stream")
    listeners = [
        Subscription("sound", "delete", collector(heard, "sound")),
        Subscription("broken", "delete", collector(heard, "broken", {1: 1})),
    ]
    for first in (0, 10):
        batch(spark, first).coalesce(1).write.mode("append").parquet(f"{root}/feed")
        stream = channels.read_stream(spark, f"{root}/feed", batch(spark, 0).schema, files_per_trigger=1)
        query = Deliveries(spark, root, listeners, tries=1).start(stream, available_now=True)
        if first == 0:
            query.awaitTermination()
        else:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination()
    Deliveries(spark, root, listeners, tries=1).start(stream, available_now=True).awaitTermination()
    assert sorted(heard) == [
        ("broken", 0, [2, 6]), ("broken", 1, [10, 14, 18]), ("sound", 0, [2, 6]), ("sound", 1, [10, 14, 18]),
    ]


def test_live_channels_know_all_operators(spark):
    db = Database(spark, work_dir(spark, "operators"), "key")
    fields = [{"name": "room"}, {"name": "size", "type": "Int"}, {"name": "other"}]
    declared = [([("room", "String", "contains", None), ("size", "Int", "gte", "10")],)]
    table = db.create_table("rooms", fields, declared)
    table.create_many([{"id": str(i), "room": f"room {i}", "size": i, "other": "x"} for i in range(8, 13)])
    root = work_dir(spark, "operators-out")

    def heard(name, filters):
        query = channels.sink(table.subscribe("create", filters), f"{root}/{name}", f"{root}/{name}-at", available_now=True)
        query.awaitTermination()
        return sorted(int(r["id"]) for r in spark.read.parquet(f"{root}/{name}").collect())

    assert heard("declared", {"room": "m 1", "size": 11}) == [11, 12]
    assert heard("constant", {"size": None, "other": "not declared"}) == [10, 11, 12]
    own = [{"field": "size", "operator": "ne", "value": 9}, {"field": "room", "operator": "lt", "value": "room 2"}]
    assert heard("own", own) == [10, 11, 12]
    table.publish([{"id": "ghost", "room": "room 1", "size": 50}])
    got = []
    listeners = [
        Subscription("big", "create", collector(got, "big"), [{"field": "size", "operator": "gt", "value": 11}]),
        Subscription("sent", "update", collector(got, "sent")),
    ]
    for _ in range(2):
        table.listen(listeners, f"{root}/listen", available_now=True).awaitTermination()
    assert sum(len(h[2]) for h in got if h[0] == "big") == 1
    assert sum(len(h[2]) for h in got if h[0] == "sent") == 1


def test_changes_between_versions_read_what_differs(spark):
    spec = LogSpec(("id",), ("a", "b"))
    pipeline = ChangePipeline(spark, work_dir(spark, "between"), spec, m.SCHEMA, buckets=16)
    rows = m.random_log(5, 300, 12)
    for number, (lo, hi) in enumerate(((0, 120), (120, 200), (200, 300))):
        pipeline.process(spark.createDataFrame([r for r in rows if lo <= r[1] < hi], m.SCHEMA), number)

    def live(version):
        return {r["id"]: (r["a"], r["b"]) for r in pipeline.table(version).collect()}

    for first, second in ((0, 2), (1, 2), (0, 1), (2, 2)):
        before, after = live(first), live(second)
        found = pipeline.changes_between(first, second).collect()
        kinds = {r["id"]: r["kind"] for r in found}
        assert len(kinds) == len(found)
        assert {k for k, v in kinds.items() if v == "INSERT"} == after.keys() - before.keys()
        assert {k for k, v in kinds.items() if v == "REMOVE"} == before.keys() - after.keys()
        assert {k for k in before.keys() & after.keys() if before[k] != after[k]} <= kinds.keys()
        for r in found:
            assert (r["old"] and tuple(r["old"])) == before.get(r["id"])
            assert (r["new"] and tuple(r["new"])) == after.get(r["id"])
    pipeline.process(spark.createDataFrame([m.row("one", 900, "create", 900, "x")], m.SCHEMA), 3)
    changed = pipeline.changes_between(2, 3)
    assert [r["id"] for r in changed.collect()] == ["one"]
    names = {f.split("/bucket=")[1].split("/")[0] for f in changed.inputFiles()}
    assert len(names) == 1
