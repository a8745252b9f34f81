"""Reads, pages and writes."""

import pytest
from pyspark.sql import functions as F, types as T

from keyfold.functions.tokens import cursor_value
from keyfold.model import Field, TableSpec, table_spec
from keyfold.operators import read, write
from keyfold.session import work_dir
from keyfold.sources.snapshot import Snapshot
from keyfold.sources.tables import scan, table


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"p{i:03d}", i, i % 2 == 0, None if i % 7 == 0 else float(i)) for i in range(250)]
    return spark.createDataFrame(rows, "id string, n long, even boolean, score double").cache()


def test_pages_joined_are_the_table(spark, people):
    token, seen, rounds = None, [], 0
    while True:
        rows = read.page(people, "id", limit=100, token=token).collect()
        seen += [r["id"] for r in rows]
        assert all(r["page_count"] == len(rows) for r in rows)
        token, rounds = rows[0]["next_token"], rounds + 1
        if token is None:
            break
    assert seen == [f"p{i:03d}" for i in range(250)] and rounds == 3
    assert read.page(people, "id", {"n": -1}).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 7, 64, None])
def test_bulk_pages_have_no_gap_or_repeat(people, ranges, monkeypatch):
    monkeypatch.setattr(read, "RANGE_ROWS", 40)  # many ranges, also where none are given
    rows = read.bulk_pages(people, "id", 30, ranges).orderBy("page_no", "position").collect()
    assert [r["id"] for r in rows] == [f"p{i:03d}" for i in range(250)]
    assert [(r["page_no"], r["position"]) for r in rows] == [(i // 30, i % 30) for i in range(250)]
    pages = read.page_index(people, "id", 30, ranges).orderBy("page_no").collect()
    assert [p["page_count"] for p in pages] == [30] * 8 + [10]
    assert pages[-1]["next_token"] is None
    assert cursor_value(pages[0]["next_token"], "id") == "p029"


def test_an_empty_table_has_no_pages(people):
    empty = people.filter("n < 0")
    assert read.bulk_pages(empty, "id", 30, 4).count() == 0
    assert read.page_index(empty, "id", 30, 4).count() == 0
    assert read.count(empty).first()["n"] == 0


def test_limits_and_tokens(people):
    assert read.list_records(people, "id").count() == 50
    assert read.list_records(people, "id", limit=1000).count() == 100
    assert read.list_records(people, "id", limit=3).count() == 3
    assert read.list_records(people, "id", token="not base64!").first()["id"] == "p000"


def test_typed_filters(people):
    assert read.count(people, {"even": False}).first()["n"] == 125
    assert read.count(people, {"n": "12"}).first()["n"] == 1
    assert read.count(people, {"n": "twelve"}).first()["n"] == 0
    assert read.count(people, {"n": None}).first()["n"] == 250


def test_index_modes(people):
    spec = TableSpec("people", (Field("id", primary=True), Field("n", "Int", indexed=True),
                                Field("even", "Boolean", indexed=True), Field("score", "Float")))
    both = {"even": True, "n": 3}
    assert read.index_filters(people, both).count() == 0
    with pytest.warns(UserWarning):
        loose = read.index_filters(people, {"score": 1.0, "even": True}, spec, strict=False)
    assert loose.count() == 125
    first = read.index_filters(people, both, spec, strict=False, first_only=True)
    assert [r["id"] for r in first.collect()] == ["p003"]


def test_operators(spark):
    df = spark.createDataFrame([(1, "abc", ["x", "y"]), (2, "b", ["z"]), (3, None, None)],
                               "k int, s string, l array<string>")

    def keys(field, operator, value):
        chosen = read.scan(df, [{"field": field, "operator": operator, "value": value}])
        return sorted(r["k"] for r in chosen.collect())

    assert keys("k", "ne", "2") == [1, 3]
    assert keys("k", "lte", 2) == [1, 2] and keys("k", "lt", 2) == [1]
    assert keys("k", "gte", 2) == [2, 3] and keys("k", "gt", 2) == [3]
    assert keys("s", "contains", "b") == [1, 2]
    assert keys("l", "contains", "z") == [2]
    with pytest.raises(ValueError):
        keys("k", "like", "2")
    with pytest.raises(KeyError):
        read.project(df, ["k", "nope"])


def test_query_direction_and_start(people):
    back = read.query(people, {"even": True}, "id", limit=3, forward=False, start_after="p100")
    assert [r["id"] for r in back.collect()] == ["p098", "p096", "p094"]


def _all_pages(page):
    token, seen = None, []
    while True:
        rows = page(token).collect()
        seen += rows
        token = rows[0]["next_token"] if rows else None
        if token is None:
            return seen


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", ["few", "x", "at", "n"])
def test_pages_by_a_field_that_repeats(spark, by, descending):
    rows = spark.range(240).selectExpr(
        "id AS n", "lpad(id, 4, '0') AS id", "CASE WHEN id % 3 > 0 THEN id % 4 END AS few",
        "CASE WHEN id % 5 = 1 THEN double('NaN') WHEN id % 5 > 1 THEN (id % 7) / 3 END AS x",
        "CASE WHEN id % 4 > 0 THEN timestamp_micros(1700000000000001 + id % 6) END AS at",
    )
    want = rows.orderBy(F.col(by).desc() if descending else F.col(by).asc(), "id").collect()
    got = _all_pages(lambda t: read.page(rows, "id", limit=37, token=t, by=by, descending=descending))
    assert [r["id"] for r in got] == [r["id"] for r in want]
    back = _all_pages(lambda t: read.query_page(rows, {}, by, "id", limit=37, token=t, forward=not descending))
    order = F.col(by).desc() if descending else F.col(by).asc()
    want = rows.orderBy(order, F.col("id").desc() if descending else F.col("id").asc()).collect()
    assert [r["id"] for r in back] == [r["id"] for r in want]
    second = read.list_sorted(rows, "id", by, descending, limit=37, token=got[0]["next_token"]).collect()
    assert [r["id"] for r in second] == [r["id"] for r in got[37:74]]


def test_query_continues_behind_a_pair(people):
    rows = people.withColumn("few", F.col("n") % 3)
    first = read.query(rows, {"even": True}, "few", limit=50, key="id")
    last = first.collect()[-1]
    rest = read.query(rows, {"even": True}, "few", key="id", start_after=(last["few"], last["id"]))
    assert len({r["id"] for r in first.unionByName(rest).collect()}) == first.count() + rest.count() == 125
    # a cursor of another order starts from the beginning
    assert read.query(rows, {"even": True}, "few", key="id", token="eyJuIjo1fQ==").count() == 125


def test_filters_reach_the_scan(spark, data):
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    orders = table(spark, data, "orders")
    assert "EqualTo(o_orderkey,7)" in text(read.get(orders, "o_orderkey", 7))
    listed = text(read.list_records(orders, "o_orderkey", {"o_orderstatus": "F"}))
    assert "EqualTo(o_orderstatus,F)" in listed and "TakeOrderedAndProject" in listed
    after = text(read.list_records(orders, "o_orderkey", token="eyJvX29yZGVya2V5Ijo1MH0="))
    assert "GreaterThan(o_orderkey,50)" in after
    narrow = text(read.project(orders, ["o_orderkey", "o_totalprice"]))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in narrow
    bulk = text(read.bulk_pages(orders, "o_orderkey"))
    rows_side = bulk.split("BroadcastExchange")[0]
    assert "SinglePartition" not in rows_side


def test_schema_changes_without_rewriting(spark, people):
    path = work_dir(spark, "evolve")
    people.write.parquet(path)
    spec = TableSpec("people", (Field("id", primary=True), Field("n", "Int"), Field("added", "String")))
    rows = scan(spark, path, spec)
    assert rows.columns == ["id", "n", "added"]
    assert rows.filter(F.col("added").isNotNull()).count() == 0 and rows.count() == 250


def test_table_spec_forces_id_and_timestamps():
    spec = table_spec("t", [{"name": "x", "type": "Int"}, {"name": "createdAt"}])
    assert spec.names == ["id", "x", "createdAt", "updatedAt"] and spec.key == "id"
    spec = table_spec("t", [{"name": "x"}, {"name": "id", "type": "Int", "indexed": True}])
    assert spec.names == ["x", "id", "createdAt", "updatedAt"]
    assert (spec["id"].type, spec["id"].indexed, spec.key) == ("String", False, "id")


BASE = [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
COLUMNS = "k int, s string, v double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_put_replaces_whole_and_keeps_the_last(spark):
    base = spark.createDataFrame(BASE, COLUMNS)
    new = spark.createDataFrame([(2, "x", None, 1), (4, "d", 4.0, 1), (4, "e", 5.0, 2)], COLUMNS + ", o int")
    assert rows(write.put(base, new, ["k"], "o").table) == [
        (1, "a", 1.0), (2, "x", None), (3, "c", 3.0), (4, "e", 5.0)
    ]


def test_put_if_absent_and_condition(spark):
    base = spark.createDataFrame(BASE, COLUMNS)
    new = spark.createDataFrame([(2, "x", 9.0), (4, "d", 4.0)], COLUMNS)
    done = write.put_if_absent(base, new, ["k"])
    assert rows(done.rejected) == [(2, "x", 9.0)] and rows(done.new) == [(4, "d", 4.0)]
    done = write.put_if(base, new, ["k"], lambda old, fresh: fresh["v"] > old["v"])
    assert rows(done.rejected) == [(4, "d", 4.0)]
    assert rows(done.table) == [(1, "a", 1.0), (2, "x", 9.0), (3, "c", 3.0)]


def test_update_merges_rejects_and_sets_null(spark):
    base = spark.createDataFrame(BASE, COLUMNS)
    new = spark.createDataFrame(
        [(1, None, None, True, False), (3, "z", None, True, True), (9, "q", 1.0, True, True)],
        COLUMNS + ", has_s boolean, has_v boolean",
    )
    done = write.update(base, new, ["k"], {"s": F.col("has_s"), "v": F.col("has_v")})
    assert rows(done.table) == [(1, None, 1.0), (2, "b", 2.0), (3, "z", None)]
    assert [r["k"] for r in done.rejected.collect()] == [9]


def test_update_expr_returns_all_new(spark):
    base = spark.createDataFrame(BASE, COLUMNS)
    done = write.update_expr(base, {"v": F.col("v") * 10}, F.col("s") != "b")
    assert rows(done.new) == [(1, "a", 10.0), (3, "c", 30.0)]
    assert rows(done.table) == [(1, "a", 10.0), (2, "b", 2.0), (3, "c", 30.0)]


def test_delete_returns_old_and_ignores_unknown(spark):
    base = spark.createDataFrame(BASE, COLUMNS)
    done = write.delete(base, spark.createDataFrame([(2,), (2,), (7,)], "k int"), ["k"])
    assert rows(done.old) == [(2, "b", 2.0)] and rows(done.table) == [(1, "a", 1.0), (3, "c", 3.0)]


def test_batch_write_applies_in_order(spark):
    base = spark.createDataFrame(BASE, COLUMNS)
    puts = spark.createDataFrame([(2, "x", 9.0, 5), (4, "d", 4.0, 1)], COLUMNS + ", o int")
    deletes = spark.createDataFrame([(2, 4), (4, 2), (1, 3)], "k int, o int")
    assert rows(write.batch_write(base, puts, deletes, ["k"], "o").table) == [
        (2, "x", 9.0), (3, "c", 3.0)
    ]


def test_system_fields_fill_only_missing_ids(spark):
    df = spark.createDataFrame([("a", "mine"), (None, None), ("", None)], "id string, createdAt string")
    at = F.lit("2024-05-06 07:08:09.123").cast("timestamp_ntz")
    done = write.with_system_fields(df, now=at).collect()
    assert {r["createdAt"] for r in done} == {"2024-05-06T07:08:09.123Z"}
    assert sum(r["id"] == "a" for r in done) == 1 and len({r["id"] for r in done}) == 3
    assert all(r["id"] for r in done)


def test_snapshot_versions_stay_readable(spark, people):
    store = Snapshot(spark, work_dir(spark, "versions"), people.schema, ("id",), 8, ("n",))
    assert store.head() is None and store.read().count() == 0
    store.create(people).create(people.limit(0))
    changes = people.filter("n < 3").withColumn("score", F.lit(-1.0))
    buckets = store.touched(changes)
    store.commit(write.put(store.read(buckets=buckets), changes, ["id"]).table, buckets)
    assert store.read(0).filter("score < 0").count() == 0
    assert store.read().filter("score < 0").count() == 3 and store.read().count() == 250
    everything = store.read(buckets=buckets).limit(0)
    store.commit(everything, buckets)
    assert store.read().count() == 250 - people.count() + store.read().count()
    assert set(store.head().held).isdisjoint(buckets)
