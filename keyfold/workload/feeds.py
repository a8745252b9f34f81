"""Feed and subscription queries over the events table read as a change log."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from keyfold.operators import asof, fanout as fan, feed
from keyfold.session import work_dir
from keyfold.sources.log import EVENT_LOG, events_as_log
from keyfold.sources.tables import table
from keyfold.workload.common import ACCEPTED, IMAGES

FIELDS = {"id": T.LongType(), "value": T.DoubleType(), "props": T.StringType()}


def _log(s, d):
    return events_as_log(table(s, d, "events"))


def _feed(s, d):
    return feed.images(_log(s, d), EVENT_LOG)


def payload_of(s, d):
    return feed.payload(_feed(s, d), EVENT_LOG).select("id", "seq", "op", "value", "props")


def accepted(s, d):
    return feed.accepted(_log(s, d), EVENT_LOG)


def flat_images(df):
    """Images with their structs as columns."""
    return df.select(
        "id",
        "seq",
        "op",
        "kind",
        F.col("old.value").alias("old_value"),
        F.col("old.props").alias("old_props"),
        F.col("new.value").alias("new_value"),
        F.col("new.props").alias("new_props"),
    )


def images(s, d):
    return flat_images(_feed(s, d))


def sub_create(s, d):
    return feed.subscribe(payload_of(s, d), "create")


def sub_update(s, d):
    return feed.subscribe(payload_of(s, d), "update")


def sub_delete(s, d):
    return feed.subscribe(payload_of(s, d), "delete")


def sub_update_filtered(s, d):
    """Declared filters only: ``props`` is not declared and so ignored, ``value`` has no value."""
    return feed.subscribe(
        payload_of(s, d),
        "update",
        {"id": "12", "value": None, "props": "ignored"},
        declared=["id", "value"],
    ).select("id", "seq", "value")


def edit_history(s, d):
    edits = feed.edit_history(_feed(s, d), EVENT_LOG)
    return edits.select(
        "id",
        "seq",
        "ts",
        F.col("old.value").alias("old_value"),
        F.col("new.value").alias("new_value"),
        F.col("old.props").alias("old_props"),
        F.col("new.props").alias("new_props"),
    )


def record_as_of(s, d):
    """Users as they were at the positions that orders name."""
    asked = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return asof.records_as_of(_log(s, d), asked, EVENT_LOG)


def _published(s, d):
    """Pending orders as events about a user; nothing of them is stored."""
    orders = table(s, d, "orders").filter(F.col("o_orderstatus") == "P")
    renamed = orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value")
    )
    return feed.publish(renamed, EVENT_LOG, ["value"])


def publish_events(s, d):
    return _published(s, d)


def publish_union(s, d):
    updates = feed.subscribe(payload_of(s, d), "update").drop("op")
    return feed.update_channel(updates, _published(s, d).drop("op"), origin="origin")


def own_excluded(s, d):
    """Every message, for a listener who speaks as 'user'."""
    return feed.without_own(table(s, d, "conversations"), "role", "user")


def _filter(field, operator, value):
    return F.struct(
        F.lit(field).alias("field"), F.lit(operator).alias("operator"), value.cast("string").alias("value")
    )


def subscriptions(s, d):
    """Customers as subscribers, and one unfiltered watcher per region.

    The market segment picks the event, the balance picks what is bound: the record,
    a ``props`` value, both, or a record with a lowest value.
    """
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    event = F.when(segment == "BUILDING", "create").when(segment == "MACHINERY", "delete").otherwise("update")
    by_id = _filter("id", "eq", F.col("c_custkey"))
    props = F.format_string('{"k": %d}', F.col("c_nationkey"))
    customers = table(s, d, "customer").select(
        F.col("c_custkey").alias("sub_id"),
        event.alias("event"),
        F.when(balance < 0, F.array(_filter("props", "eq", props)))
        .when(balance < 3000, F.array(by_id))
        .when(balance < 6000, F.array(by_id, _filter("value", "gt", F.col("c_nationkey") * 10)))
        .otherwise(F.array(by_id, _filter("props", "contains", F.lit("1"))))
        .alias("filters"),
        (F.col("c_custkey") + 1).alias("owner"),
    )
    regions = table(s, d, "region").select(
        (-1 - F.col("r_regionkey")).cast("bigint").alias("sub_id"),
        F.lit("update").alias("event"),
        F.array(_filter("value", "eq", F.lit(None))).alias("filters"),
        F.col("r_regionkey").cast("bigint").alias("owner"),
    )
    return customers.unionByName(regions)


def subscription_changes(s, d):
    """The customers' subscriptions as changes of a hundred subscribers, who come, change their mind and leave."""
    asked = subscriptions(s, d).filter("sub_id > 0")
    leaves = table(s, d, "customer").filter(F.col("c_mktsegment") == "FURNITURE").select(F.col("c_custkey").alias("sub_id"))
    leaving = asked.join(leaves.withColumn("_leaves", F.lit(True)), "sub_id", "left")
    return leaving.select(
        (F.col("sub_id") % 100).alias("sub_id"),
        (F.col("sub_id") * 6).alias("seq"),
        F.when(F.col("_leaves"), fan.UNSUBSCRIBE).otherwise(fan.SUBSCRIBE).alias("op"),
        "event",
        "filters",
    )


def fanout_live(s, d):
    """Events with the subscriptions that held when they came."""
    return fan.fanout_live(payload_of(s, d), subscription_changes(s, d), FIELDS).select("seq", "sub_id")


def _topics(s, d):
    return fan.store_topics(subscriptions(s, d), FIELDS, work_dir(s, "topics"))


def fanout(s, d):
    pairs = fan.fanout(payload_of(s, d), _topics(s, d), FIELDS, author_column="id")
    return pairs.select("seq", "sub_id")


def range_subscriptions(s, d):
    """Parts as watchers of a stretch of values, of a lowest or highest one, of all but one, or of a piece of ``props``."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    low = F.round(price % 490, 1)
    kind = F.col("p_partkey") % 8
    return table(s, d, "part").select(
        F.col("p_partkey").alias("sub_id"),
        F.when(size % 2 == 0, "update").otherwise("create").alias("event"),
        F.when(kind == 0, F.array(_filter("value", "gt", F.lit(480) + low / 49)))
        .when(kind == 1, F.array(_filter("value", "lte", low / 49)))
        .when(kind == 2, F.array(_filter("value", "ne", low), _filter("id", "eq", size)))
        .when(kind == 3, F.array(_filter("props", "contains", F.concat(F.lit(" "), size.cast("string"), F.lit("}")))))
        .when(kind == 4, F.array(_filter("value", "gte", low), _filter("id", "eq", size)))
        .otherwise(F.array(_filter("value", "gte", low), _filter("value", "lt", low + 2)))
        .alias("filters"),
    )


def fanout_ranges(s, d):
    """Events with every subscription to a range of values, to other values, or to a piece of text."""
    subscribed = fan.store_topics(range_subscriptions(s, d), FIELDS, work_dir(s, "topics"))
    return fan.fanout(payload_of(s, d), subscribed, FIELDS).select("seq", "sub_id")


def fanout_channel(s, d):
    """The whole channel: stored changes and published events, to everyone who wants them."""
    published = _published(s, d).withColumn("props", F.lit(None).cast("string"))
    channel = payload_of(s, d).unionByName(published)
    pairs = fan.fanout(channel, _topics(s, d), FIELDS, author_column="id")
    return pairs.select("seq", "op", "sub_id")


def delivery_counts_own(s, d):
    """Deliveries per subscription without the subscriber's own events."""
    return fan.delivery_counts(payload_of(s, d), _topics(s, d), FIELDS, author_column="id")


def delivery_counts(s, d):
    return fan.delivery_counts(payload_of(s, d), _topics(s, d), FIELDS)


QUERIES = {
    f.__name__: f
    for f in (
        accepted, images, sub_create, sub_update, sub_delete, sub_update_filtered, edit_history, record_as_of,
        publish_events, publish_union, own_excluded, fanout, fanout_ranges, fanout_live, fanout_channel, delivery_counts,
        delivery_counts_own,
    )
}

_PAYLOAD = (
    IMAGES
    + """,
    pay as (select id, seq, op, case when op = 'delete' then old_value else new_value end as value,
                   case when op = 'delete' then old_props else new_props end as props from img)"""
)
_SUBS = (
    _PAYLOAD
    + """,
    subs as (
      select c_custkey sub_id, case c_mktsegment when 'BUILDING' then 'create' when 'MACHINERY' then 'delete'
                               else 'update' end event,
             case when c_acctbal >= 0 then c_custkey end f_id,
             case when c_acctbal < 0 then '{"k": ' || c_nationkey || '}' end f_props,
             case when c_acctbal >= 3000 and c_acctbal < 6000 then c_nationkey * 10 end f_min,
             case when c_acctbal >= 6000 then '1' end f_has, c_custkey + 1 as owner from customer
      union all
      select -1 - r_regionkey, 'update', null, null, null, null, r_regionkey from region),
    pairs as (select seq, sub_id, id = owner own from pay join subs on op = event
              where (f_id is null or f_id = id) and (f_props is null or f_props = props)
                and (f_min is null or value > f_min) and (f_has is null or contains(props, f_has)))"""
)

ORACLES = {
    "accepted": ACCEPTED + " select id, seq, op from acc",
    "images": IMAGES
    + " select id, seq, op, kind, old_value, old_props, new_value, new_props from img",
    "sub_create": _PAYLOAD + " select * from pay where op = 'create'",
    "sub_update": _PAYLOAD + " select * from pay where op = 'update'",
    "sub_delete": _PAYLOAD + " select * from pay where op = 'delete'",
    "sub_update_filtered": _PAYLOAD + " select id, seq, value from pay where op = 'update' and id = 12",
    "edit_history": IMAGES
    + """ select id, seq, ts, old_value, new_value, old_props, new_props from img where op = 'update'""",
    "record_as_of": IMAGES
    + """, asked as (select distinct o_custkey as id, o_orderkey as seq from orders)
    select asked.id, asked.seq, new_value as value, new_props as props
    from asked asof join img on asked.id = img.id and asked.seq >= img.seq where op <> 'delete'""",
    "publish_events": """
    select o_custkey as id, o_orderkey as seq, 'publish' as op, o_totalprice as value
    from orders where o_orderstatus = 'P'""",
    "publish_union": _PAYLOAD
    + """
    select id, seq, value, props, 'store' as origin from pay where op = 'update'
    union all
    select o_custkey, o_orderkey, o_totalprice, null, 'publish' from orders where o_orderstatus = 'P'""",
    "own_excluded": "select * from conversations where role <> 'user'",
    "fanout": _SUBS + " select seq, sub_id from pairs where not own",
    "fanout_live": _SUBS
    + """,
    life as (select sub_id % 100 sub_id, sub_id * 6 as since, c_mktsegment = 'FURNITURE' as leaves, event, f_id, f_props, f_min, f_has,
                    lead(sub_id * 6) over (partition by sub_id % 100 order by sub_id) as until
             from subs join customer on sub_id = c_custkey)
    select seq, sub_id from pay join life on op = event and seq > since and (until is null or seq <= until)
    where not leaves and (f_id is null or f_id = id) and (f_props is null or f_props = props)
      and (f_min is null or value > f_min) and (f_has is null or contains(props, f_has))""",
    "fanout_ranges": _PAYLOAD
    + """,
    watch as (select p_partkey sub_id, case when p_size % 2 = 0 then 'update' else 'create' end event,
                     p_partkey % 8 kind, p_size, round(p_retailprice % 490, 1) low from part)
    select seq, sub_id from pay join watch on op = event and case
      when kind = 0 then value > 480 + low / 49 when kind = 1 then value <= low / 49
      when kind = 2 then value <> low and id = p_size when kind = 3 then contains(props, ' ' || p_size || '}')
      when kind = 4 then value >= low and id = p_size else value >= low and value < low + 2 end""",
    "fanout_channel": _SUBS
    + """, ev as (select id, seq, op, op as event, value, props from pay
               union all select o_custkey, o_orderkey, 'publish', 'update', o_totalprice, null
                         from orders where o_orderstatus = 'P')
    select seq, op, sub_id from ev join subs using (event)
    where id <> owner and (f_id is null or f_id = id) and (f_props is null or f_props = props)
      and (f_min is null or value > f_min) and (f_has is null or contains(props, f_has))""",
    "delivery_counts_own": _SUBS
    + """ select sub_id, coalesce(n, 0) as events from subs
          left join (select sub_id, count(*) n from pairs where not own group by 1) using (sub_id)""",
    "delivery_counts": _SUBS
    + """ select sub_id, coalesce(n, 0) as events from subs
          left join (select sub_id, count(*) n from pairs group by 1) using (sub_id)""",
}
