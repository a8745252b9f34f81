"""Deltas of batches against the fold of the whole log; records as they were against a loop."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keyfold.operators import asof, feed, fold
from keyfold.session import work_dir
from keyfold.sources.log import LogSpec
from keyfold.streaming.deltas import DeltaTable

SPEC = LogSpec(("a", "b"), ("x", "y"))
SCHEMA = "a string, b long, seq long, ts timestamp_ntz, op string, x double, y string, present_x boolean, present_y boolean"


def rows_of(seed, n, hot=0.4):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        key = ("hot", 0) if rng.random() < hot else (rng.choice("pq"), rng.randrange(6))
        op = rng.choice(["create", "update", "update", "update", "delete", "publish"])
        out.append((*key, seq, None, op, rng.choice([None, rng.random()]), rng.choice([None, "u", "v"]), rng.random() < 0.7, rng.random() < 0.5))
    return out


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_compose_in_any_order(spark, seed):
    rows = rows_of(seed, 400)
    log = spark.createDataFrame(rows, SCHEMA)
    want = plain(fold.fold(log, SPEC))
    rng = random.Random(seed)
    parts = [[] for _ in range(5)]
    for row in rows:
        parts[rng.randrange(5)].append(row)
    placed = [fold.placed_deltas(spark.createDataFrame(p, SCHEMA), SPEC) for p in parts]
    rng.shuffle(placed)
    nested = fold.combine(fold.combine(placed[0].union(placed[1]), SPEC).union(placed[2]).union(placed[0]), SPEC)
    assert plain(fold.settle_placed(nested.union(placed[3]).union(placed[4]), SPEC)) == want


def size_of(path):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_batches_write_what_they_touch(spark):
    root = work_dir(spark, "deltas").removeprefix("file:")
    schema = spark.createDataFrame([], SCHEMA).schema
    deltas = DeltaTable(spark, root, SPEC, schema)
    assert deltas.table().count() == 0 and deltas.merge() is None
    large = spark.range(30_000).select(
        F.lit("p").alias("a"), F.col("id").alias("b"), F.col("id").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit("create").alias("op"), F.rand(1).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("y"), F.lit(True).alias("present_x"), F.lit(True).alias("present_y"),
    )
    deltas.append(large, 0)
    before = size_of(f"{root}/deltas")
    few = spark.createDataFrame([("p", k, 40_000 + k, None, "update", 1.0, None, True, False) for k in range(20)], SCHEMA)
    for number in range(1, 6):
        deltas.append(few.withColumn("seq", F.col("seq") + 100 * number), number)
    assert size_of(f"{root}/deltas") - before < before / 50
    want = plain(deltas.state())
    # small parts are merged among themselves, the large one stays where it is
    part = deltas.merge()
    assert (part.first, part.last) == (1, 5) and [(p.first, p.last) for p in deltas.parts()] == [(0, 0), (1, 5)]
    assert plain(deltas.state()) == want and deltas.table().filter("x = 1").count() == 20
    # a replay of a merged batch, and of one that isn't, changes nothing
    deltas.append(few, 3)
    deltas.append(large, 0)
    assert plain(deltas.state()) == want
    deltas.merge()
    assert [(p.first, p.last) for p in deltas._all()] == [(0, 0), (1, 5)]


def test_feed_of_batches_is_the_feed_of_the_log(spark):
    rows = rows_of(3, 300)
    schema = spark.createDataFrame([], SCHEMA).schema
    deltas = DeltaTable(spark, work_dir(spark, "deltas"), SPEC, schema)
    for number in range(3):
        batch = spark.createDataFrame(rows[100 * number : 100 * number + 100], SCHEMA)
        for _ in range(2 if number == 1 else 1):
            deltas.append(batch, number, with_feed=True)
    log = spark.createDataFrame(rows, SCHEMA)
    columns = ["a", "b", "seq", "op", "kind", "old", "new"]
    assert plain(deltas.feed().select(columns)) == plain(feed.images(log, SPEC).select(columns))


@pytest.mark.parametrize("group_rows", [10, 1_000_000])
def test_records_as_they_were(spark, group_rows):
    rows = rows_of(4, 300)
    rng = random.Random(4)
    asked = [(*rng.choice(rows)[:2], rng.randrange(-5, 310)) for _ in range(120)]
    asked += asked[:10] + [("nobody", 1, 5), (None, None, None)]
    got = asof.records_as_of(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "a string, b long, seq long"), SPEC, group_rows=group_rows
    ).collect()
    want = set()
    for a, b, at in set(asked):
        record = None
        for row in rows:
            if row[:2] != (a, b) or at is None or row[2] > at:
                continue
            op, x, y, has_x, has_y = row[4:]
            if op == "create":
                record = {"x": x if has_x else None, "y": y if has_y else None}
            elif op == "delete":
                record = None
            elif op == "update" and record is not None:
                record |= ({"x": x} if has_x else {}) | ({"y": y} if has_y else {})
        if record is not None:
            want.add((a, b, at, record["x"], record["y"]))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
