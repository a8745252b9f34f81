"""Write and fold queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from keyfold.functions.rules import record_rules, with_status
from keyfold.model import Field
from keyfold.operators import fold, schemas, write
from keyfold.session import work_dir
from keyfold.sources.log import EVENT_LOG, events_as_log
from keyfold.sources.snapshot import Snapshot
from keyfold.sources.tables import table
from keyfold.workload.common import LOG

C = "c_custkey"


def _order_puts(s, d):
    """Every order as a put of a customer record, every supplier as a new customer."""
    orders = table(s, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias("c_name"),
        F.lit(-1).alias("c_nationkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderstatus").alias("c_mktsegment"),
        F.col("o_orderkey").alias("ord"),
    )
    suppliers = table(s, d, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
        F.col("s_suppkey").alias("ord"),
    )
    return orders.unionByName(suppliers)


def put_upsert(s, d):
    return write.put(table(s, d, "customer"), _order_puts(s, d), [C], order="ord").table


PARTS = [
    Field("part_id", "Int", True, False, True, T.LongType()),
    Field("phone", "String", True, dtype=T.StringType()),
    Field("age", "Int", True, dtype=T.IntegerType()),
    Field("price", "Float", True, dtype=T.DoubleType()),
]


def _part_records(s, d):
    """Parts under field names that carry shape rules."""
    return table(s, d, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("phone"),
        F.col("p_size").alias("age"),
        (F.col("p_retailprice") - 950).alias("price"),
    )


def create_many(s, d):
    base = table(s, d, "supplier").select(
        F.col("s_suppkey").alias("part_id"),
        F.col("s_name").alias("phone"),
        F.col("s_nationkey").alias("age"),
        F.col("s_acctbal").alias("price"),
    )
    return schemas.create_many(base, _part_records(s, d), ["part_id"], record_rules(PARTS)).table


def create_many_status(s, d):
    judged = with_status(_part_records(s, d), record_rules(PARTS))
    return judged.select("part_id", "ok", "error_field", "error_rule")


def _customers_as_suppliers(s, d):
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("s_suppkey"),
        F.col("c_name").alias("s_name"),
        F.col("c_nationkey").alias("s_nationkey"),
        F.col("c_acctbal").alias("s_acctbal"),
    )


def put_if_absent(s, d):
    return write.put_if_absent(
        table(s, d, "supplier"), _customers_as_suppliers(s, d), ["s_suppkey"]
    ).table


def put_if_rejected(s, d):
    return write.put_if_absent(
        table(s, d, "supplier"), _customers_as_suppliers(s, d), ["s_suppkey"]
    ).rejected


def put_conditional(s, d):
    def richer(old, new):
        return old.isNull() | (new["s_acctbal"] > old["s_acctbal"])

    return write.put_if(
        table(s, d, "supplier"), _customers_as_suppliers(s, d), ["s_suppkey"], richer
    ).table


def _order_updates(s, d, key, balance, segment=None):
    """Per customer the last delivered price and the last open priority, where there is one."""
    orders = table(s, d, "orders")
    status, seq = F.col("o_orderstatus"), F.col("o_orderkey")

    def last(value, when):
        return F.max_by(F.when(when, F.col(value)), F.when(when, seq))

    aggregates = [last("o_totalprice", status == "F").alias(balance)]
    if segment:
        aggregates.append(last("o_orderpriority", status == "O").alias(segment))
    return orders.groupBy(F.col("o_custkey").alias(key)).agg(*aggregates)


def update_partial(s, d):
    updates = _order_updates(s, d, C, "c_acctbal", "c_mktsegment")
    present = {c: F.col(c).isNotNull() for c in ("c_acctbal", "c_mktsegment")}
    return write.update(table(s, d, "customer"), updates, [C], present).table


def update_mixed(s, d):
    """Every row gives its own field, and some an explicit NULL; the last row of a key counts."""
    status = F.col("o_orderstatus")
    updates = table(s, d, "orders").select(
        F.col("o_custkey").alias(C),
        F.when(status != "P", F.col("o_totalprice")).alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        status,
        "o_orderkey",
    )
    present = {"c_acctbal": status.isin("F", "P"), "c_mktsegment": status == "O"}
    return write.update(table(s, d, "customer"), updates, [C], present, order="o_orderkey").table


def update_repeated_keys(s, d):
    """Rows that share a key change nothing; those alone on theirs do."""
    updates = table(s, d, "orders").select(F.col("o_custkey").alias(C), F.col("o_totalprice").alias("c_acctbal"))
    return write.update(table(s, d, "customer"), updates, [C]).table


def update_rejected(s, d):
    updates = _order_updates(s, d, "s_suppkey", "s_acctbal")
    return write.update(table(s, d, "supplier"), updates, ["s_suppkey"]).rejected


def update_expr(s, d):
    using = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.max("l_extendedprice").alias("top")
    )
    return write.update_expr(
        table(s, d, "supplier"),
        {"s_acctbal": F.col("s_acctbal") + F.col("top")},
        condition=F.col("s_acctbal") >= 0,
        using=using,
        keys=["s_suppkey"],
    ).new


def _doomed(s, d):
    return (
        table(s, d, "orders")
        .filter(F.col("o_orderstatus") == "P")
        .select(F.col("o_custkey").alias(C))
    )


def delete_old_image(s, d):
    return write.delete(table(s, d, "customer"), _doomed(s, d), [C]).old


def delete_survivors(s, d):
    return write.delete(table(s, d, "customer"), _doomed(s, d), [C]).table


def batch_write(s, d):
    writes = _order_puts(s, d)
    return write.batch_write(
        table(s, d, "customer"),
        writes.filter(F.col("c_mktsegment") != "P"),
        writes.filter(F.col("c_mktsegment") == "P"),
        [C],
        "ord",
    ).table


def _messages(s, d):
    return table(s, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("conv_id").cast("string").alias("chatId"),
        F.col("role").alias("username"),
        F.col("text").alias("content"),
    )


def seed_table(s, d):
    """Create the messages table if absent and load the first records."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    records = write.with_system_fields(_messages(s, d), now=at)
    store = Snapshot(s, work_dir(s, "seed"), records.schema, ("id",), 8, ("chatId", "username"))
    return store.create(records).create(records).read()


def materialize_table(s, d):
    rows = table(s, d, "customer")
    store = Snapshot(s, work_dir(s, "customer"), rows.schema, (C,), 8, ("c_mktsegment",))
    return store.create(rows).read()


def put_versions(s, d):
    """A put committed as a table version that rewrites only the touched buckets."""
    base = table(s, d, "customer")
    store = Snapshot(s, work_dir(s, "put"), base.schema, (C,), 8).create(base)
    incoming = write.last_per_key(_order_puts(s, d), [C], "ord").select(*base.columns)
    buckets = store.touched(incoming)
    store.commit(write.put(store.read(buckets=buckets), incoming, [C]).table, buckets)
    return store.read()


def snapshot_fold(s, d):
    log = events_as_log(table(s, d, "events"))
    return fold.records(fold.fold(log, EVENT_LOG), EVENT_LOG)


def system_fields(s, d):
    log = events_as_log(table(s, d, "events"))
    return fold.fold(log, EVENT_LOG).filter(F.col("live")).select("id", "created_at", "updated_at")


def tombstones(s, d):
    log = events_as_log(table(s, d, "events"))
    return fold.fold(log, EVENT_LOG).filter(~F.col("live")).select("id", "last_seq")


def fold_incremental(s, d):
    """The log folded in two stretches, the second onto the state after the first."""
    log = events_as_log(table(s, d, "events"))
    middle = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    state = fold.fold(log.filter(F.col("ts") < middle), EVENT_LOG)
    after = fold.advance(state, log.filter(F.col("ts") >= middle), EVENT_LOG)
    return fold.records(after, EVENT_LOG, system_fields=True)


QUERIES = {
    f.__name__: f
    for f in (
        put_upsert, create_many, create_many_status, put_if_absent, put_if_rejected, put_conditional,
        update_partial, update_mixed, update_repeated_keys, update_rejected, update_expr, delete_old_image, delete_survivors, batch_write,
        seed_table, materialize_table, put_versions, snapshot_fold, system_fields, tombstones,
        fold_incremental,
    )
}

_PUTS = """
    with src as (
      select o_custkey c_custkey, o_orderpriority c_name, cast(-1 as integer) c_nationkey,
             o_totalprice c_acctbal, o_orderstatus c_mktsegment, o_orderkey ord from orders
      union all
      select -1 - s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLIER', s_suppkey from supplier),
    inc as (
      select c_custkey, arg_max(c_name, ord) c_name, arg_max(c_nationkey, ord) c_nationkey,
             arg_max(c_acctbal, ord) c_acctbal, arg_max(c_mktsegment, ord) c_mktsegment
      from src group by c_custkey)"""
_PUT_RESULT = (
    _PUTS
    + """
    select * from inc
    union all
    select * from customer c where not exists (select 1 from inc where inc.c_custkey = c.c_custkey)"""
)
_STATUS = """
    with r as (select p_partkey part_id, p_name phone, p_size age, p_retailprice - 950 price from part),
    j as (select *, case when phone is null or phone = '' then 'phone' when age is null then 'age'
                         when price is null then 'price' when isnan(price) then 'price'
                         when length(phone) < 10 then 'phone'
                         when age not between 0 and 150 then 'age' when price < 0 then 'price' end f,
                   case when phone is null or phone = '' or age is null or price is null then 'required'
                        when isnan(price) then 'type'
                        when length(phone) < 10 then 'min_len'
                        when age not between 0 and 150 then 'range'
                        when price < 0 then 'non_negative' end e from r)"""
_AS_SUPPLIER = (
    "select c_custkey s_suppkey, c_name s_name, c_nationkey s_nationkey, c_acctbal s_acctbal from customer"
)

ORACLES = {
    "put_upsert": _PUT_RESULT,
    "put_versions": _PUT_RESULT,
    "create_many": _STATUS
    + """
    select part_id, phone, age, price from j where f is null
    union all
    select s_suppkey, s_name, s_nationkey, s_acctbal from supplier
    where s_suppkey not in (select part_id from j where f is null)""",
    "create_many_status": _STATUS
    + " select part_id, f is null as ok, f as error_field, e as error_rule from j",
    "put_if_absent": f"""
    select * from supplier union all
    select * from ({_AS_SUPPLIER}) i where i.s_suppkey not in (select s_suppkey from supplier)""",
    "put_if_rejected": f"""
    select * from ({_AS_SUPPLIER}) i where i.s_suppkey in (select s_suppkey from supplier)""",
    "put_conditional": f"""
    with i as ({_AS_SUPPLIER}),
    good as (select i.* from i left join supplier s on s.s_suppkey = i.s_suppkey
             where s.s_suppkey is null or i.s_acctbal > s.s_acctbal)
    select * from good union all
    select * from supplier where s_suppkey not in (select s_suppkey from good)""",
    "update_partial": """
    with u as (select o_custkey,
                 arg_max(o_totalprice, o_orderkey) filter (where o_orderstatus = 'F') bal,
                 arg_max(o_orderpriority, o_orderkey) filter (where o_orderstatus = 'O') seg
               from orders group by o_custkey)
    select c_custkey, c_name, c_nationkey, coalesce(bal, c_acctbal) as c_acctbal,
           coalesce(seg, c_mktsegment) as c_mktsegment
    from customer left join u on o_custkey = c_custkey""",
    "update_mixed": """
    with u as (select o_custkey, arg_max(o_orderstatus, o_orderkey) st, arg_max(o_totalprice, o_orderkey) p,
                 arg_max(o_orderpriority, o_orderkey) pr from orders group by o_custkey)
    select c_custkey, c_name, c_nationkey,
           case when st = 'F' then p when st = 'P' then null else c_acctbal end as c_acctbal,
           case when st = 'O' then pr else c_mktsegment end as c_mktsegment
    from customer left join u on o_custkey = c_custkey""",
    "update_repeated_keys": """
    with u as (select o_custkey, max(o_totalprice) p from orders group by o_custkey having count(*) = 1)
    select c_custkey, c_name, c_nationkey, coalesce(p, c_acctbal) as c_acctbal, c_mktsegment
    from customer left join u on o_custkey = c_custkey""",
    "update_rejected": """
    select o_custkey as s_suppkey,
           arg_max(o_totalprice, o_orderkey) filter (where o_orderstatus = 'F') as s_acctbal
    from orders where o_custkey not in (select s_suppkey from supplier) group by o_custkey""",
    "update_expr": """
    select s_suppkey, s_name, s_nationkey, s_acctbal + top as s_acctbal
    from supplier join (select l_suppkey, max(l_extendedprice) top from lineitem group by 1)
      on l_suppkey = s_suppkey where s_acctbal >= 0""",
    "delete_old_image": "select * from customer where c_custkey in "
    "(select o_custkey from orders where o_orderstatus='P')",
    "delete_survivors": "select * from customer where c_custkey not in "
    "(select o_custkey from orders where o_orderstatus='P')",
    "batch_write": _PUTS
    + """
    select * from inc where c_mktsegment <> 'P'
    union all
    select * from customer c where not exists (select 1 from inc where inc.c_custkey = c.c_custkey)""",
    "seed_table": """
    select conv_id || '-' || turn as id, cast(conv_id as varchar) as "chatId", role as username,
           text as content, '2024-01-01T00:00:00.000Z' as "createdAt",
           '2024-01-01T00:00:00.000Z' as "updatedAt" from conversations""",
    "materialize_table": "select * from customer",
    "snapshot_fold": LOG
    + """, r as (select id, max(seq) rseq, arg_max(op, seq) rop from l where op <> 'update' group by id)
    select l.id, arg_max_null(value, seq) filter (where sv) as value,
           arg_max_null(props, seq) filter (where sp) as props
    from l join r using (id) where rop = 'create' and seq >= rseq group by l.id""",
    "system_fields": LOG
    + """, r as (select id, max(seq) rseq, arg_max(op, seq) rop from l where op <> 'update' group by id)
    select l.id, arg_min(ts, seq) as created_at, arg_max(ts, seq) as updated_at
    from l join r using (id) where rop = 'create' and seq >= rseq group by l.id""",
    "tombstones": LOG
    + """, r as (select id, arg_max(op, seq) rop from l where op <> 'update' group by id)
    select l.id, max(seq) as last_seq from l join r using (id) where rop = 'delete' group by l.id""",
    "fold_incremental": LOG
    + """, r as (select id, max(seq) rseq, arg_max(op, seq) rop from l where op <> 'update' group by id)
    select l.id, arg_max_null(value, seq) filter (where sv) as value,
           arg_max_null(props, seq) filter (where sp) as props,
           arg_min(ts, seq) as created_at, arg_max(ts, seq) as updated_at
    from l join r using (id) where rop = 'create' and seq >= rseq group by l.id""",
}
