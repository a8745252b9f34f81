"""The sequential model: a plain loop over a log, the meaning all operators must keep."""

import random

from pyspark.sql import types as T

from keyfold.sources.log import LogSpec

SPEC = LogSpec(("id",), ("a", "b"))
SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("op", T.StringType()),
        T.StructField("a", T.LongType()),
        T.StructField("b", T.StringType()),
        T.StructField("present_a", T.BooleanType()),
        T.StructField("present_b", T.BooleanType()),
    ]
)


def at(seq):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seq)


def row(key, seq, op, a=None, b=None, has_a=None, has_b=None):
    full = op == "create"
    return (
        key, seq, at(seq), op, a, b,
        full if has_a is None else has_a,
        full if has_b is None else has_b,
    )


def random_log(seed, n, keys, hot=0.4, explicit_null=0.2):
    """Random rows; key 'hot' takes a share of them, updates may set NULL or give nothing."""
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        key = "hot" if r.random() < hot else f"k{r.randrange(keys)}"
        op = r.choices(["create", "update", "delete"], [2, 5, 1])[0]
        a = None if r.random() < explicit_null else r.randrange(100)
        b = None if r.random() < explicit_null else f"v{r.randrange(100)}"
        if op == "delete":
            rows.append(row(key, seq, op))
        elif op == "create":
            has_a, has_b = r.random() < 0.8, r.random() < 0.8
            rows.append(row(key, seq, op, a if has_a else None, b if has_b else None, has_a, has_b))
        else:
            rows.append(row(key, seq, op, a, b, r.random() < 0.6, r.random() < 0.6))
    return rows


def run(rows):
    """(live records, accepted events) of a log applied in order."""
    table, events = {}, []
    for key, seq, ts, op, a, b, has_a, has_b in sorted(rows, key=lambda x: x[1]):
        old = table.get(key)
        if op == "create":
            new = {"a": a if has_a else None, "b": b if has_b else None, "created": ts, "updated": ts}
        elif old is None:
            continue
        elif op == "update":
            new = dict(old, updated=ts)
            if has_a:
                new["a"] = a
            if has_b:
                new["b"] = b
        else:
            new = None
        kind = "REMOVE" if op == "delete" else "INSERT" if old is None else "MODIFY"
        strip = lambda r: None if r is None else (r["a"], r["b"])
        events.append((key, seq, op, kind, strip(old), strip(new)))
        if new is None:
            del table[key]
        else:
            table[key] = new
    return table, events


def live(df):
    return {r["id"]: (r["a"], r["b"], r["created_at"], r["updated_at"]) for r in df.collect()}


def expected_live(table):
    return {k: (v["a"], v["b"], v["created"], v["updated"]) for k, v in table.items()}


def events_of(df):
    strip = lambda r: None if r is None else (r["a"], r["b"])
    return sorted(
        (r["id"], r["seq"], r["op"], r["kind"], strip(r["old"]), strip(r["new"])) for r in df.collect()
    )
