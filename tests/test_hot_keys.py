"""Hot keys beyond the list's capacity, sparse orders and pairs that repeat."""

import random

import pytest
from pyspark.sql import functions as F

from keyfold.operators import feed
from keyfold.plans import skew
from keyfold.sources.log import LogSpec

SPEC = LogSpec(("k",), ("x",))
SCHEMA = "k string, seq long, ts timestamp_ntz, op string, x long, present_x boolean"


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


def log_rows(seed, keys, n, spread):
    r = random.Random(seed)
    out = []
    for seq in sorted(r.sample(range(-spread, spread), n)):
        op = r.choice(["create", "update", "update", "update", "delete"])
        row = (r.choice(keys), seq, None, op, r.randrange(99), r.random() < 0.6)
        out += [row] * (3 if r.random() < 0.1 else 1)
    return out


@pytest.mark.parametrize(("width", "spread"), [(30, 400), (1 << 16, 1 << 40)])
def test_pieces_give_the_plain_scan(spark, width, spread):
    log = spark.createDataFrame(log_rows(1, ["a", "a", "a", "b", None], 300, spread), SCHEMA)
    values = {"reset": SPEC.reset(), "x": SPEC.assignment("x")}
    want = skew.running_last(log, ["k"], "seq", values, ("op",))
    pieces = skew.Pieces(skew.find_pieces(log, ["k"], 20).hot, width)
    got = skew.running_last(log, ["k"], "seq", values, ("op",), pieces)
    assert plain(got.select(want.columns)) == plain(want)


def test_more_hot_keys_than_the_list_names(spark, monkeypatch):
    monkeypatch.setattr(skew, "REPORTED", 4)
    log = spark.createDataFrame(log_rows(2, [f"k{i}" for i in range(12)] + ["rare"], 600, 900), SCHEMA)
    slices = skew.find_slices(log, ["k"], "seq", 40)
    assert isinstance(slices, skew.Pieces) and slices.hot.count() > 4
    assert plain(feed.images(log, SPEC, slices=slices)) == plain(feed.images(log, SPEC, slices=None))
    state = spark.createDataFrame([("k1", -5000, True, None, None, 7)], "k string, last_seq long, live boolean, created_at timestamp_ntz, updated_at timestamp_ntz, x long")
    assert plain(feed.images(log, SPEC, state, slices=skew.Pieces(slices.hot, 500))) == plain(feed.images(log, SPEC, state, slices=None))


def test_more_hot_keys_than_the_default_list(spark):
    """5,000 hot keys; the list names 4,096."""
    log = spark.range(60_000).select(
        F.concat(F.lit("k"), F.col("id") % 5000).alias("k"), F.col("id").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") < 5000, "create").otherwise("update").alias("op"), F.col("id").alias("x"), F.lit(True).alias("present_x"),
    )
    slices = skew.find_slices(log, ["k"], "seq", 5)
    assert isinstance(slices, skew.Pieces) and slices.hot.count() == 5000
    got = feed.images(log, SPEC, slices=skew.Pieces(slices.hot, 40_000))
    assert got.count() == 60_000 and got.filter("kind = 'MODIFY' and old.x <> new.x - 5000").count() == 0


def test_one_pair_repeated_many_times(spark):
    repeated = spark.range(2_000_000).select(
        F.lit("hot").alias("k"), F.lit(7).cast("long").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit("create").alias("op"), F.lit(1).cast("long").alias("x"), F.lit(True).alias("present_x"),
    )
    few = spark.createDataFrame([("hot", 8, None, "update", 2, True), ("cold", 9, None, "create", 3, True)], SCHEMA)
    log = repeated.unionByName(few)
    slices = skew.find_slices(log, ["k"], "seq", 1000)
    assert slices.repeats
    got = plain(feed.images(log, SPEC, slices=slices).select("k", "seq", "kind"))
    assert got == ["('cold', 9, 'INSERT')", "('hot', 7, 'INSERT')", "('hot', 8, 'MODIFY')"]
    # the pair is thinned out by each task before it is dealt to one
    thin = skew._once(log, ["k"], "seq", ("op",))
    assert "partial_min_by" in thin._jdf.queryExecution().executedPlan().toString()
    assert thin.count() == 3
