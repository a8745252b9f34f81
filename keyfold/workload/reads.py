"""Read queries over the test tables."""

from __future__ import annotations

from keyfold.functions.tokens import cursor_value
from keyfold.model import Field, TableSpec
from keyfold.operators import read
from keyfold.sources.tables import scan, table
from pyspark.sql import functions as F

ORDERS = TableSpec(
    "orders",
    (
        Field("o_orderkey", "Int", True, False, True),
        Field("o_custkey", "Int", True, True),
        Field("o_orderstatus", "String", True, True),
        Field("o_totalprice", "Float", True),
        Field("o_orderpriority", "String"),
    ),
)
EVENT_FILTERS = [
    {"field": "event_type", "operator": "ne", "value": "view"},
    {"field": "value", "operator": "gte", "value": "10"},
    {"field": "value", "operator": "lt", "value": 180},
    {"field": "props", "operator": "contains", "value": "8"},
]
# the cursor of the record with key 50
TOKEN = "eyJvX29yZGVya2V5Ijo1MH0="
assert cursor_value(TOKEN, "o_orderkey") == 50


def _orders(spark, d):
    return table(spark, d, "orders")


def _micros(spark, d):
    """Orders with a time of their own, a microsecond apart."""
    return _orders(spark, d).select(
        "o_orderkey", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("o_orderkey")).alias("at")
    )


def _micros_token(spark, d):
    """The cursor behind the first 40 of them."""
    return read.page(_micros(spark, d), "at", limit=40).first()["next_token"]


def _ranked(spark, d):
    """Orders with a rank that repeats, and that a seventh of them doesn't have."""
    return _orders(spark, d).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("rank")
    )


def _third_page(first_pages):
    """Follows the cursors of two pages; ``first_pages`` takes a cursor and gives a page."""
    token = first_pages(None).first()["next_token"]
    return first_pages(first_pages(token).first()["next_token"])


def sorted_next_page(s, d):
    """The third page of orders by descending rank; the ranks of all three are the same."""
    rows = _ranked(s, d)
    return _third_page(
        lambda token: read.page(rows, "o_orderkey", limit=70, token=token, by="rank", descending=True)
    )


def query_next_page(s, d):
    """The third page of a user's events by kind, backwards."""
    rows = table(s, d, "events").select("event_id", "user_id", "event_type")
    return _third_page(
        lambda token: read.query_page(
            rows, {"user_id": 12}, "event_type", "event_id", limit=2, token=token, forward=False
        )
    ).drop("next_token")


FRACTIONS = [
    {"field": "o_orderkey", "operator": "gte", "value": 3.5},
    {"field": "o_orderkey", "operator": "lt", "value": "1200.5"},
    {"field": "o_custkey", "operator": "gt", "value": 9.99},
    {"field": "o_custkey", "operator": "lte", "value": 140.2},
]

QUERIES = {
    "scan_table": lambda s, d: scan(s, f"{d}/orders.parquet", ORDERS),
    "scan_filter": lambda s, d: read.scan(
        table(s, d, "events"), EVENT_FILTERS, fields=["event_id", "user_id", "value"]
    ),
    "filter_ops": lambda s, d: read.scan(table(s, d, "events"), EVENT_FILTERS, fields=["event_id"]),
    "filter_fractional": lambda s, d: read.scan(
        _orders(s, d), FRACTIONS, fields=["o_orderkey", "o_custkey"]
    ),
    "filter_out_of_range": lambda s, d: read.scan(
        _orders(s, d),
        [
            {"field": "o_custkey", "operator": "lt", "value": 2**70},
            {"field": "o_orderkey", "operator": "ne", "value": "7.5"},
            {"field": "o_orderkey", "operator": "gt", "value": -1e30},
        ],
        fields=["o_orderkey"],
    ),
    "page_by_timestamp": lambda s, d: read.page(
        _micros(s, d), "at", token=_micros_token(s, d), limit=40
    ).select("o_orderkey", F.unix_micros("at").alias("at_us"), "page_count"),
    "record_get": lambda s, d: read.get(_orders(s, d), "o_orderkey", 7),
    "record_batch_get": lambda s, d: read.batch_get(
        _orders(s, d),
        table(s, d, "lineitem").filter(F.col("l_quantity") >= 50),
        "o_orderkey",
        "l_orderkey",
    ),
    "list_default": lambda s, d: read.list_records(_orders(s, d), "o_orderkey"),
    "list_index_eq": lambda s, d: read.list_records(
        _orders(s, d), "o_orderkey", {"o_orderstatus": "F"}, limit=1000
    ),
    "list_filters_all": lambda s, d: read.list_records(
        _orders(s, d), "o_orderkey", {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}, limit=100
    ),
    "list_filters_first": lambda s, d: read.list_records(
        _orders(s, d),
        "o_orderkey",
        {"o_orderstatus": "F", "o_custkey": "77", "o_orderpriority": "5-LOW"},
        limit=100,
        spec=ORDERS,
        strict=False,
        first_only=True,
    ),
    "list_next_page": lambda s, d: read.list_records(_orders(s, d), "o_orderkey", limit=50, token=TOKEN),
    "page_envelope": lambda s, d: read.page(
        _orders(s, d), "o_orderkey", {"o_orderstatus": "F"}, limit=100, token=TOKEN
    ),
    "bulk_pages": lambda s, d: read.bulk_pages(_orders(s, d), "o_orderkey"),
    "page_index": lambda s, d: read.page_index(_orders(s, d), "o_orderkey"),
    "query_desc_project": lambda s, d: read.query(
        table(s, d, "events"),
        {"user_id": 12},
        "event_id",
        filters=[{"field": "value", "operator": "gt", "value": 100}],
        fields=["event_id", "user_id", "value"],
        limit=20,
        forward=False,
    ),
    "project_fields": lambda s, d: read.project(
        table(s, d, "part"), ["p_partkey", "p_name", "p_retailprice"]
    ),
    "list_sorted": lambda s, d: read.list_sorted(
        _orders(s, d), "o_orderkey", "o_totalprice", descending=True
    ),
    "sorted_next_page": sorted_next_page,
    "query_next_page": query_next_page,
    "count_records": lambda s, d: read.count(_orders(s, d)),
    "count_filtered": lambda s, d: read.count(_orders(s, d), {"o_orderstatus": "P"}),
}

def _token(key: str) -> str:
    return f"""base64(encode('{{"o_orderkey":' || {key} || '}}'))"""


_FILTER = "event_type<>'view' and value>=10 and value<180 and contains(props,'8')"

ORACLES = {
    "scan_table": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
    "scan_filter": f"select event_id, user_id, value from events where {_FILTER}",
    "filter_ops": f"select event_id from events where {_FILTER}",
    "filter_fractional": "select o_orderkey, o_custkey from orders where o_orderkey >= 3.5 and o_orderkey < 1200.5 "
    "and o_custkey > 9.99 and o_custkey <= 140.2",
    "filter_out_of_range": "select o_orderkey from orders where o_custkey is not null and o_orderkey is not null",
    "page_by_timestamp": """
        with p as (select o_orderkey, row_number() over (order by o_orderkey) rn from orders)
        select o_orderkey, 1700000000000000 + o_orderkey as at_us,
               (select count(*) from p where rn between 41 and 80) as page_count
        from p where rn between 41 and 80""",
    "record_get": "select * from orders where o_orderkey=7",
    "record_batch_get": "select * from orders where o_orderkey in "
    "(select l_orderkey from lineitem where l_quantity>=50)",
    "list_default": "select * from orders order by o_orderkey limit 50",
    "list_index_eq": "select * from orders where o_orderstatus='F' order by o_orderkey limit 100",
    "list_filters_all": "select * from orders where o_orderstatus='F' and o_orderpriority='5-LOW' "
    "order by o_orderkey limit 100",
    "list_filters_first": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority "
    "from orders where o_custkey=77 order by o_orderkey limit 100",
    "list_next_page": "select * from orders where o_orderkey>50 order by o_orderkey limit 50",
    "page_envelope": f"""
        with p as (select * from orders where o_orderstatus='F' and o_orderkey>50
                   order by o_orderkey limit 101),
        n as (select *, row_number() over (order by o_orderkey) rn, count(*) over () c from p)
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
               least(c, 100) as page_count,
               case when c > 100 then (select {_token('o_orderkey')} from n where rn = 100) end
                 as next_token
        from n where rn <= 100""",
    "bulk_pages": """
        select *, (row_number() over (order by o_orderkey) - 1) // 100 as page_no,
               (row_number() over (order by o_orderkey) - 1) % 100 as position
        from orders""",
    "page_index": f"""
        with n as (select o_orderkey k, (row_number() over (order by o_orderkey) - 1) // 100 as page_no,
                          count(*) over () total from orders)
        select page_no, min(k) as first_key, max(k) as last_key, count(*) as page_count,
               case when (page_no + 1) * 100 < max(total) then {_token('max(k)')} end as next_token
        from n group by page_no""",
    "query_desc_project": "select event_id, user_id, value from events where user_id=12 and value>100 "
    "order by event_id desc limit 20",
    "project_fields": "select p_partkey, p_name, p_retailprice from part",
    "list_sorted": "select * from orders order by o_totalprice desc, o_orderkey limit 50",
    "sorted_next_page": """
        with r as (select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderpriority end as rank from orders),
        n as (select *, row_number() over (order by rank desc nulls last, o_orderkey) rn from r)
        select o_orderkey, rank, (select count(*) from n where rn between 141 and 210) as page_count,
               case when (select count(*) from n) > 210 then
                 (select base64(encode('{"rank":' || coalesce('"' || rank || '"', 'null') || ',"o_orderkey":' || o_orderkey || '}'))
                  from n where rn = 210) end as next_token
        from n where rn between 141 and 210""",
    "query_next_page": """
        with n as (select event_id, user_id, event_type,
                          row_number() over (order by event_type desc, event_id desc) rn from events where user_id = 12)
        select event_id, user_id, event_type, (select count(*) from n where rn between 5 and 6) as page_count
        from n where rn between 5 and 6""",
    "count_records": "select count(*) as n from orders",
    "count_filtered": "select count(*) as n from orders where o_orderstatus='P'",
}
