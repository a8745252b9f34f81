"""Reads: point lookups, filtered lists, pages and counts.

Everything is a filter, a projection and an ordered limit, so key and filter
predicates reach the Parquet scan and a page costs one top-k per task.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyfold.functions.predicates import all_of, typed_equal, typed_literal
from keyfold.functions.tokens import cursor, cursor_value, cursor_values
from keyfold.model import DEFAULT_PAGE, MAX_PAGE, TableSpec
from keyfold.plans.skew import key_cuts, locate

#: records that one task numbers when a whole table is cut into pages
RANGE_ROWS = 2_000_000


def page_limit(limit: int | None) -> int:
    return min(DEFAULT_PAGE if limit is None else int(limit), MAX_PAGE)


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named fields; an unknown name is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"unknown fields: {missing}")
    return df.select(*names)


def get(df: DataFrame, key: str, value: object) -> DataFrame:
    """The record with the key, or no row."""
    return df.filter(typed_equal(df, key, value))


def batch_get(df: DataFrame, keys: DataFrame, key: str, keys_column: str | None = None) -> DataFrame:
    """The records whose key is in ``keys``; repeated and unknown keys add nothing.

    Keys are made distinct with map-side partials, which removes a hot key before
    the shuffle. Spark broadcasts them when its size estimate allows.
    """
    wanted = keys.select(F.col(keys_column or key).alias(key)).distinct()
    return df.join(wanted, key, "left_semi").select(*df.columns)


def index_filters(
    df: DataFrame,
    filters: Mapping[str, object] | None,
    spec: TableSpec | None = None,
    strict: bool = True,
    first_only: bool = False,
) -> DataFrame:
    """Equality filters.

    Strict mode applies every filter. Otherwise only indexed fields count, others
    are ignored with a warning. ``first_only`` applies just the first declared one.
    """
    wanted = {n: v for n, v in (filters or {}).items() if v is not None}
    if not strict:
        if spec is None:
            raise ValueError("strict=False needs a table definition")
        ignored = sorted(set(wanted) - set(spec.indexed))
        if ignored:
            warnings.warn(f"filters on fields without an index are ignored: {ignored}")
        wanted = {n: wanted[n] for n in spec.indexed if n in wanted}
    if first_only and wanted:
        first = next((n for n in (spec.names if spec else wanted) if n in wanted))
        wanted = {first: wanted[first]}
    for name, value in wanted.items():
        df = df.filter(typed_equal(df, name, value))
    return df


def list_records(
    df: DataFrame,
    key: str,
    filters: Mapping[str, object] | None = None,
    limit: int | None = None,
    token: str | None = None,
    spec: TableSpec | None = None,
    strict: bool = True,
    first_only: bool = False,
) -> DataFrame:
    """One page in ascending key order, at most ``MAX_PAGE`` records."""
    chosen = _after(index_filters(df, filters, spec, strict, first_only), key, token)
    if spec is not None:
        chosen = project(chosen, spec.names)
    return chosen.orderBy(key).limit(page_limit(limit))


def _after(df: DataFrame, key: str, token: str | None) -> DataFrame:
    last = cursor_value(token, key)
    if last is None:
        return df
    return df.filter(F.col(key) > typed_literal(last, df.schema[key].dataType))


#: a column and whether it ascends; ascending puts NULL first, descending last
Order = Sequence[tuple[str, bool]]


def _sorted_by(order: Order) -> list[Column]:
    return [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in order]


def beyond(df: DataFrame, order: Order, values: Mapping[str, object]) -> Column:
    """Whether a row comes after the one with ``values``: by the first column, ties by the next ones.

    Only the last column has to tell all rows apart; the others may repeat and be NULL.
    """
    (name, up), rest = order[0], order[1:]
    column, value = F.col(name), values[name]
    if value is None:
        same, later = column.isNull(), column.isNotNull() if up else F.lit(False)
    else:
        bound = typed_literal(value, df.schema[name].dataType)
        same = column == bound
        later = column > bound if up else (column < bound) | column.isNull()
    return later | (same & beyond(df, rest, values)) if rest else later


def _continued(df: DataFrame, order: Order, token: str | None) -> DataFrame:
    last = cursor_values(token, [n for n, _ in order])
    return df if last is None else df.filter(beyond(df, order, last))


def page(
    df: DataFrame,
    key: str,
    filters: Mapping[str, object] | None = None,
    limit: int | None = None,
    token: str | None = None,
    by: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """A page with its record count and the cursor of the next page on every row.

    In key order, or sorted ``by`` a field that may repeat and be NULL, ties in key order: its cursor
    holds both, so that pages neither lose nor repeat a record.
    """
    chosen = index_filters(df, filters)
    if by is None or by == key:
        return _enveloped(_after(chosen, key, token), [(key, True)], limit)
    order = [(by, not descending), (key, True)]
    return _enveloped(_continued(chosen, order, token), order, limit)


def _enveloped(df: DataFrame, order: Order, limit: int | None) -> DataFrame:
    """The first page of ``df``.

    One record more than the page is fetched; it only tells whether there is a next
    page. The windows below see at most ``MAX_PAGE + 1`` rows.
    """
    size, ordered = page_limit(limit), _sorted_by(order)
    fetched = df.orderBy(*ordered).limit(size + 1)
    whole = Window.partitionBy(F.lit(0))
    ranked = fetched.withColumn("_n", F.row_number().over(whole.orderBy(*ordered))).withColumn(
        "_more", F.max("_n").over(whole) > size
    )
    last = F.when(F.col("_more") & (F.col("_n") == size), cursor(*[n for n, _ in order]))
    return (
        ranked.withColumn("_token", last)
        .filter(F.col("_n") <= size)
        .withColumn("page_count", F.count(F.lit(1)).over(whole))
        .withColumn("next_token", F.max("_token").over(whole))
        .select(*df.columns, "page_count", "next_token")
    )


def scan(
    df: DataFrame,
    filters: Iterable[Mapping] = (),
    where: Column | None = None,
    fields: Sequence[str] | None = None,
    key: str | None = None,
    limit: int | None = None,
    start_after: object | None = None,
) -> DataFrame:
    """Scan with a filter, a projection, and optionally a limit and a start key."""
    chosen = df.filter(all_of(df, filters))
    if where is not None:
        chosen = chosen.filter(where)
    if start_after is not None:
        chosen = chosen.filter(F.col(key) > typed_literal(start_after, df.schema[key].dataType))
    if limit is not None:
        chosen = chosen.orderBy(key).limit(limit)
    return chosen if fields is None else project(chosen, fields)


def query(
    df: DataFrame,
    key_condition: Mapping[str, object],
    order_key: str,
    filters: Iterable[Mapping] = (),
    fields: Sequence[str] | None = None,
    limit: int | None = None,
    start_after: object | None = None,
    forward: bool = True,
    key: str | None = None,
    token: str | None = None,
) -> DataFrame:
    """Key query: equality on the key or an indexed field, residual filters, direction.

    ``start_after`` is a value of ``order_key``, which must not repeat then. With the record ``key``,
    records with the same value come in key order and ``start_after`` is a pair, or ``token`` the cursor of
    :func:`query_page`.
    """
    chosen = index_filters(df, key_condition).filter(all_of(df, filters))
    if key is not None:
        order = [(order_key, forward), (key, forward)]
        chosen = _continued(chosen, order, token)
        if start_after is not None:
            chosen = chosen.filter(beyond(df, order, dict(zip((order_key, key), start_after, strict=True))))
        ordered = chosen.orderBy(*_sorted_by(order))
        ordered = ordered if limit is None else ordered.limit(limit)
        return ordered if fields is None else project(ordered, fields)
    if start_after is not None:
        bound = typed_literal(start_after, df.schema[order_key].dataType)
        chosen = chosen.filter(F.col(order_key) > bound if forward else F.col(order_key) < bound)
    ordered = chosen.orderBy(F.col(order_key).asc() if forward else F.col(order_key).desc())
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered if fields is None else project(ordered, fields)


def query_page(
    df: DataFrame,
    key_condition: Mapping[str, object],
    order_key: str,
    key: str,
    filters: Iterable[Mapping] = (),
    limit: int | None = None,
    token: str | None = None,
    forward: bool = True,
) -> DataFrame:
    """One page of a key query with its record count and the cursor of the next page on every row."""
    chosen = index_filters(df, key_condition).filter(all_of(df, filters))
    order = [(order_key, forward), (key, forward)]
    return _enveloped(_continued(chosen, order, token), order, limit)


def list_sorted(
    df: DataFrame,
    key: str,
    by: str,
    descending: bool = False,
    limit: int | None = None,
    token: str | None = None,
) -> DataFrame:
    """A page sorted by any field, ties in key order; ``token`` is the cursor of a :func:`page` in this order."""
    order = [(by, not descending), (key, True)]
    return _continued(df, order, token).orderBy(*_sorted_by(order)).limit(page_limit(limit))


def count(df: DataFrame, filters: Mapping[str, object] | None = None) -> DataFrame:
    return index_filters(df, filters).agg(F.count(F.lit(1)).alias("n"))


def bulk_pages(df: DataFrame, key: str, size: int = MAX_PAGE, ranges: int | None = None) -> DataFrame:
    """All records with ``page_no`` (from 0) and ``position`` in the page.

    The concatenated pages are the table in key order. Keys are cut into ranges at
    fixed values, ranges are numbered in parallel, and the sizes of the ranges, one
    row each, are the only thing summed up in a single task.
    """
    numbered = _numbered(df, key, ranges)
    return numbered.select(
        *df.columns,
        F.expr(f"_position div {int(size)}").alias("page_no"),
        F.pmod("_position", F.lit(size).cast("bigint")).alias("position"),
    )


def page_index(df: DataFrame, key: str, size: int = MAX_PAGE, ranges: int | None = None) -> DataFrame:
    """One row per page: its first and last key, record count and next cursor."""
    pages = (
        _numbered(df.select(key), key, ranges)
        .groupBy(F.expr(f"_position div {int(size)}").alias("page_no"))
        .agg(
            F.min(key).alias("first_key"),
            F.max(key).alias(key),
            F.count(F.lit(1)).alias("page_count"),
            F.max("_total").alias("_total"),
        )
    )
    more = (F.col("page_no") + 1) * size < F.col("_total")
    return pages.select(
        "page_no",
        "first_key",
        F.col(key).alias("last_key"),
        "page_count",
        F.when(more, cursor(key)).alias("next_token"),
    )


def _numbered(df: DataFrame, key: str, ranges: int | None) -> DataFrame:
    # as many ranges as the table needs, and one for every core
    rows = df.count()
    parts = ranges or max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // RANGE_ROWS))
    cuts = key_cuts(df, key, parts, rows)
    piece = locate(F.col(key), cuts).alias("_range")
    sizes = df.select(piece).groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # at most len(cuts) + 1 rows
    inorder = Window.partitionBy(F.lit(0)).orderBy("_range")
    earlier = F.sum("_size").over(inorder.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        "_range",
        F.coalesce(earlier, F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(key)
    return (
        df.select("*", piece)
        # a count and no row number, which is an int
        .withColumn("_rank", F.count(F.lit(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn("_position", F.col("_offset") + F.col("_rank") - 1)
    )
