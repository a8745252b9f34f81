"""Ordered per-key work that survives hot keys.

A window partitioned by key puts all rows of a key into one task. When one key
holds a third of a change log that task never ends. Here the rows of hot keys are
cut into consecutive pieces of the order column, every piece is scanned on its
own, and the state at the end of a piece is handed to the next one. Other keys
keep the plain window, so a log without hot keys costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: rows of one key a single task may sort; beyond it the key is cut into pieces
GROUP_ROWS = 4_000_000
#: sketch capacity; every key above about 1/4,000 of all rows is reported
TRACKED, REPORTED = 16_384, 4_096
#: sketches of tasks are merged in this many groups before the last merge
MERGE_GROUPS = 256
MAX_PIECES = 16_384
#: rows a sample for cut points may bring to the driver
MAX_SAMPLE = 262_144
SLICE = "_slice"


@dataclass(frozen=True)
class Slices:
    """Hash values of the hot keys and the order values their rows are cut at."""

    hot: tuple[int, ...]
    cuts: tuple[int, ...]
    #: whether many hot rows repeat a (key, order) pair; they are thinned out before anything is cut
    repeats: bool = False

    def is_hot(self, keys: Sequence[str]) -> Column:
        return F.xxhash64(*keys).isin(list(self.hot))

    def column(self, keys: Sequence[str], order: str) -> Column:
        """0 for ordinary keys, 1..n for the pieces of hot keys."""
        piece = locate(F.col(order), self.cuts) + 1
        return F.when(self.is_hot(keys), piece).otherwise(F.lit(0))


@dataclass(frozen=True)
class Pieces:
    """Any number of hot keys, as a table, and the width of the pieces of order values that they are cut into.

    Used where there are more hot keys than a list can name. A piece holds at most ``width`` order values,
    whatever their distribution, and the states at the ends of pieces are scanned the same way.
    """

    hot: DataFrame
    width: int


def locate(value: Column, cuts: Sequence) -> Column:
    """Number of sorted ``cuts`` that are <= value: a binary search inside the JVM."""
    if not cuts:
        return F.lit(0)
    steps, step = [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    array, last = F.lit(list(cuts)), len(cuts)

    def probe(found: Column, step: Column) -> Column:
        at = found + step
        hit = (at <= last) & (F.element_at(array, F.least(at, F.lit(last))) <= value)
        return F.when(hit, at).otherwise(found)

    return F.aggregate(F.lit(steps), F.lit(0), probe)


def find_slices(
    df: DataFrame, keys: Sequence[str], order: str, group_rows: int = GROUP_ROWS
) -> Slices | Pieces | None:
    """Hot keys of ``df`` and cut points for them, or None when there are none.

    One pass over the key columns with a frequent-items sketch: no row is shuffled, and
    sketches are merged in groups before the last merge. Only if a key is hot, a second
    pass takes a sample of its order column. What comes back is bounded by constants
    and only steers how work is divided: results never depend on it.
    """
    hashed = df.select(F.xxhash64(*keys).alias("h"), F.col(order).alias("o"))
    merged = hashed.groupBy(F.expr(f"spark_partition_id() % {MERGE_GROUPS}")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("s")
    )
    # grouped by a constant: sketches of an empty frame cannot be merged, no group can be empty
    top = merged.groupBy(F.lit(1)).agg(
        F.sum("n").alias("n"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {TRACKED}), {REPORTED})").alias("top"),
    ).first()
    found = [] if top is None else top["top"]
    large = {i["item"]: i["count"] for i in found if i["count"] > group_rows}
    if not large:
        return None
    if len(large) >= REPORTED:
        return find_pieces(df, keys, group_rows)
    hot = tuple(sorted(large))
    pieces = max(2, min(MAX_PIECES, -(-top["n"] // group_rows)))
    rows = hashed.filter(F.col("h").isin(list(hot)))
    cuts = _sampled_cuts(rows.select("o", "h"), sum(large.values()), pieces)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct("h", "o")).alias("d")).first()
    return Slices(hot, tuple(cuts), repeats=seen["n"] > 2 * seen["d"])


def find_pieces(df: DataFrame, keys: Sequence[str], group_rows: int = GROUP_ROWS) -> Pieces:
    """All keys with more than ``group_rows`` rows, however many; partial counts absorb the hot ones."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return Pieces(counts.filter(F.col("_n") > group_rows).select(*keys), group_rows)


def _sampled_cuts(df: DataFrame, rows: int, parts: int, per_part: int = 64) -> list:
    """At most ``parts - 1`` values of the first column that cut the rows evenly.

    Rows are sampled by their hash, the same ones on every run; about
    ``parts * per_part`` of them, at most ``MAX_SAMPLE``, come to the driver.
    """
    want = min(parts * per_part, MAX_SAMPLE)
    share = int(2**31 * min(1.0, want / max(1, rows)))
    mixed = F.xxhash64(*df.columns).bitwiseAND(F.lit(2**31 - 1))
    sample = df.filter(mixed < share).select(df.columns[0])
    values = sorted(row[0] for row in sample.collect())
    at = (round(i * len(values) / parts) for i in range(1, parts))
    return sorted({values[i] for i in at if i < len(values)})


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    ties: Sequence[str] = (),
    slices: Slices | Pieces | None = None,
) -> DataFrame:
    """Add ``before_<name>`` and ``after_<name>`` for every value, per key in order.

    They are the last non-NULL value in the rows before the row, without and with
    the row itself. Wrap values in a struct where NULL is a value of its own.
    Rows that repeat a (key, order) pair are dropped first; the one kept is the
    first by ``ties`` and then by a hash of the row, so it is always the same.
    """
    keys, names = list(keys), list(values)
    if slices is None:
        return _scan(df, keys, order, values, ties)
    if isinstance(slices, Pieces):
        same = [F.col(f"_hot_{k}").eqNullSafe(F.col(k)) for k in keys]
        hot = slices.hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
        rest = _scan(df.join(hot, same, "left_anti"), keys, order, values, ties)
        rows = _once(df.join(hot, same, "left_semi"), keys, order, ties)
        return rest.unionByName(_segmented(rows, keys, order, values, slices.width))

    if slices.repeats:
        hot = slices.is_hot(keys)
        df = df.filter(~hot).unionByName(_once(df.filter(hot), keys, order, ties))
    sliced = df.withColumn(SLICE, slices.column(keys, order))
    part = keys + [SLICE]
    local = _scan(sliced, part, order, values, ties)
    # one row per hot key and piece; the rows of other keys never enter this branch
    state = F.struct(*[F.col(f"after_{n}").alias(n) for n in names])
    tails = (
        _scan(sliced.filter(slices.is_hot(keys)), part, order, values, ties)
        .groupBy(*part)
        .agg(F.max_by(state, F.col(order)).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *part,
        *[
            F.last(F.col(f"_tail.{n}"), ignorenulls=True).over(earlier).alias(f"_carry_{n}")
            for n in names
        ],
    )
    # local is already partitioned and sorted by (key, slice): only the carry moves
    joined = local.join(carried, part, "left")
    filled = {
        f"{side}_{n}": F.coalesce(F.col(f"{side}_{n}"), F.col(f"_carry_{n}"))
        for n in names
        for side in ("before", "after")
    }
    return joined.withColumns(filled).drop(SLICE, *[f"_carry_{n}" for n in names])


def _once(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str]) -> DataFrame:
    """One row per (key, order), the one that :func:`_scan` keeps; a pair that repeats is thinned out by each task."""
    rest = [c for c in df.columns if c not in keys and c != order and c not in ties]
    others = [*ties, *rest]
    if not others:
        return df.select(*keys, order).distinct().select(*df.columns)
    first = F.struct(*ties, F.xxhash64(*rest) if rest else F.lit(0))
    kept = df.groupBy(*keys, order).agg(F.min_by(F.struct(*others), first).alias("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) if c in others else F.col(c) for c in df.columns])


def _segmented(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], width: int
) -> DataFrame:
    """Running state as in :func:`running_last`, with at most ``width`` rows of a key in one group.

    ``df`` has one row per (key, order). Rows are scanned in pieces of ``width`` order values; the state
    at the end of each piece is a row again, and these rows are scanned the same way with the piece as
    their order, until the order values of a key span no more than a piece. With pieces of millions
    that takes three levels for any 64-bit order.
    """
    keys, names, piece = list(keys), list(values), f"_piece_{order}"
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    if ends["low"] is None or ends["high"] - ends["low"] < width:
        return _scan(df, keys, order, values, ())
    cut = df.withColumn(piece, F.expr(f"`{order}` div {width} - if(`{order}` % {width} < 0, 1, 0)"))
    local = _scan(cut, [*keys, piece], order, values, ())
    state = F.struct(*[F.col(f"after_{n}").alias(n) for n in names])
    tails = local.groupBy(*keys, piece).agg(F.max_by(state, F.col(order)).alias("_tail"))
    carried = _segmented(tails, keys, piece, {n: F.col(f"_tail.{n}") for n in names}, width)
    carried = carried.select(*[F.col(c).alias(f"_to_{c}") for c in (*keys, piece)], *[F.col(f"before_{n}").alias(f"_carry_{n}") for n in names])
    joined = local.join(carried, [F.col(f"_to_{c}").eqNullSafe(F.col(c)) for c in (*keys, piece)], "left")
    filled = {
        f"{side}_{n}": F.coalesce(F.col(f"{side}_{n}"), F.col(f"_carry_{n}")) for n in names for side in ("before", "after")
    }
    return joined.withColumns(filled).drop(piece, *[c for c in carried.columns])


def _scan(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    ties: Sequence[str],
) -> DataFrame:
    """Running state inside each partition; both windows share one exchange and sort."""
    rest = [c for c in df.columns if c not in part and c != order and c not in ties]
    tie = F.xxhash64(*rest) if rest else F.lit(0)
    ordered = Window.partitionBy(*part).orderBy(order, *ties, "_tie")
    once = (
        df.withColumn("_tie", tie)
        .withColumn("_previous", F.lag(order).over(ordered))
        .filter(F.col("_previous").isNull() | (F.col("_previous") != F.col(order)))
    )
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    before = {f"before_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in values.items()}
    after = {f"after_{n}": F.coalesce(c, F.col(f"before_{n}")) for n, c in values.items()}
    return once.withColumns(before).withColumns(after).drop("_tie", "_previous")


def lookup(
    df: DataFrame, one_per_key: DataFrame, keys: Sequence[str], slices: Slices | Pieces | None = None
) -> DataFrame:
    """Left join with a table that has one row per key, without a hot reduce task.

    At most ``REPORTED`` keys are hot, so their rows of the table are few by
    construction and are broadcast; all other keys join by shuffle as usual.
    """
    keys = list(keys)
    if slices is None or isinstance(slices, Pieces):
        # with too many hot keys for a broadcast, AQE splits the rows of theirs
        return df.join(one_per_key, keys, "left")
    hot = slices.is_hot(keys)
    few = F.broadcast(one_per_key.filter(hot))
    return (
        df.filter(~hot)
        .join(one_per_key.filter(~hot), keys, "left")
        .unionByName(df.filter(hot).join(few, keys, "left"))
    )


def key_cuts(df: DataFrame, key: str, parts: int, rows: int | None = None) -> list:
    """At most ``parts - 1`` sorted key values that cut unique keys into even ranges."""
    return _sampled_cuts(df.select(key), df.count() if rows is None else rows, parts)
