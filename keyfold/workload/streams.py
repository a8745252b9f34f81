"""Streaming queries: the log arrives in stretches, the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.operators import fanout as fan, feed
from keyfold.session import work_dir
from keyfold.sources.log import EVENT_LOG, events_as_log
from keyfold.sources.tables import table
from keyfold.streaming import channels
from keyfold.streaming.delivery import Deliveries, Subscription
from keyfold.streaming.deltas import DeltaTable
from keyfold.streaming.pipeline import ChangePipeline, split_by_order
from keyfold.workload import feeds, writes
from keyfold.workload.common import IMAGES, LOG


def _log(s, d):
    return events_as_log(table(s, d, "events"))


def stream_sink(s, d):
    """A stateless channel straight from the table's files into a Parquet sink."""
    root = work_dir(s, "sink")
    events = channels.read_stream(s, d, table(s, d, "events").schema, pattern="events.parquet")
    chosen = feed.subscribe(events_as_log(events), "update").select("id", "seq", "value", "props")
    query = channels.sink(chosen, f"{root}/out", f"{root}/checkpoint", available_now=True)
    query.awaitTermination()
    return s.read.parquet(f"{root}/out")


def stream_resume(s, d):
    """The channel stopped and started again between the arrival of three files."""
    root = work_dir(s, "resume")
    log = _log(s, d)
    split_by_order(log, "seq", 3, f"{root}/parts")
    for part in range(3):
        arrived = s.read.parquet(f"{root}/parts").filter(F.col("part") == part).drop("part")
        arrived.write.mode("append").parquet(f"{root}/in")
        stream = channels.read_stream(s, f"{root}/in", log.schema)
        chosen = feed.subscribe(stream, "delete").select("id", "seq")
        query = channels.sink(chosen, f"{root}/out", f"{root}/checkpoint", available_now=True)
        query.awaitTermination()
    return s.read.parquet(f"{root}/out")


def _run_pipeline(s, d):
    """The stateful stream over three stretches of the log, restarted between them."""
    root = work_dir(s, "pipeline")
    log = _log(s, d)
    split_by_order(log, "seq", 3, f"{root}/parts")
    pipeline = ChangePipeline(s, root, EVENT_LOG, log.schema, buckets=8)
    for part in range(3):
        arrived = s.read.parquet(f"{root}/parts").filter(F.col("part") == part).drop("part")
        arrived.write.mode("append").parquet(f"{root}/in")
        stream = channels.read_stream(s, f"{root}/in", log.schema)
        pipeline.start(stream, available_now=True).awaitTermination()
    return pipeline


def stream_feed(s, d):
    return feeds.flat_images(_run_pipeline(s, d).feed())


def stream_table(s, d):
    return _run_pipeline(s, d).table()


def changes_between(s, d):
    """What the last two of three stretches changed on balance, from the buckets they touched."""
    return _run_pipeline(s, d).changes_between(0, 2).select(
        "id", "kind", F.col("old.value").alias("old_value"), F.col("old.props").alias("old_props"),
        F.col("new.value").alias("new_value"), F.col("new.props").alias("new_props"),
    )


def stream_handlers(s, d):
    """The feed given to two handlers, each with its own ledger, as its files come in."""
    root = work_dir(s, "handlers")
    feeds.payload_of(s, d).repartitionByRange(3, "seq").write.parquet(f"{root}/feed")

    def handler(name):
        def write(events, batch):
            chosen = events.select(F.lit(name).alias("handler"), "id", "seq", "value")
            chosen.write.mode("overwrite").parquet(f"{root}/out/name={name}/batch={batch}")
        return write

    large = [{"field": "value", "operator": "gte", "value": 50}, {"field": "props", "operator": "contains", "value": "1"}]
    listeners = [
        Subscription("removals", "delete", handler("removals")),
        Subscription("large", "update", handler("large"), large),
    ]
    stream = channels.read_stream(s, f"{root}/feed", s.read.parquet(f"{root}/feed").schema, files_per_trigger=1)
    Deliveries(s, root, listeners).start(stream, available_now=True).awaitTermination()
    return s.read.parquet(f"{root}/out").select("handler", "id", "seq", "value")


def _run_deltas(s, d):
    """The log as deltas of three batches, merged behind the second."""
    root = work_dir(s, "deltas")
    log = _log(s, d)
    split_by_order(log, "seq", 3, f"{root}/parts")
    deltas = DeltaTable(s, root, EVENT_LOG, log.schema)
    for part in range(3):
        arrived = s.read.parquet(f"{root}/parts").filter(F.col("part") == part).drop("part")
        arrived.write.mode("append").parquet(f"{root}/in")
        stream = channels.read_stream(s, f"{root}/in", log.schema)
        deltas.start(stream, with_feed=True, available_now=True).awaitTermination()
        if part == 1:
            deltas.merge()
    return deltas


def delta_table(s, d):
    return _run_deltas(s, d).table()


def delta_feed(s, d):
    return feeds.flat_images(_run_deltas(s, d).feed())


def stream_fanout(s, d):
    """Deliveries to all subscribers as the feed's files come in."""
    root = work_dir(s, "fanout")
    feeds.payload_of(s, d).write.parquet(f"{root}/feed")
    subscribed = fan.store_topics(feeds.subscriptions(s, d), feeds.FIELDS, f"{root}/topics")
    stream = channels.read_stream(s, f"{root}/feed", s.read.parquet(f"{root}/feed").schema)
    pairs = fan.fanout(stream, subscribed, feeds.FIELDS, author_column="id").select("seq", "sub_id")
    channels.sink(pairs, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    return s.read.parquet(f"{root}/out")


def stream_fanout_live(s, d):
    """The same as the feed arrives file by file, with subscriptions that come and go."""
    root = work_dir(s, "live")
    feeds.payload_of(s, d).repartitionByRange(3, "seq").write.parquet(f"{root}/feed")
    feeds.subscription_changes(s, d).write.parquet(f"{root}/changes")
    schema = s.read.parquet(f"{root}/feed").schema
    stream = channels.read_stream(s, f"{root}/feed", schema, files_per_trigger=1)
    channels.live_fanout(
        stream, f"{root}/changes", feeds.FIELDS, f"{root}/out", f"{root}/checkpoint", available_now=True
    ).awaitTermination()
    return s.read.parquet(f"{root}/out").select("seq", "sub_id")


def stream_updates(s, d):
    """The update channel as a stream: stored updates together with published events."""
    root = work_dir(s, "updates")
    feeds.payload_of(s, d).write.parquet(f"{root}/feed")
    feeds.publish_events(s, d).write.parquet(f"{root}/published")

    def stream(name):
        return channels.read_stream(s, f"{root}/{name}", s.read.parquet(f"{root}/{name}").schema)

    updates = feed.subscribe(stream("feed"), "update").drop("op")
    channel = feed.update_channel(updates, stream("published").drop("op"), origin="origin")
    channels.sink(channel, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    return s.read.parquet(f"{root}/out")


QUERIES = {f.__name__: f for f in (stream_sink, stream_resume, stream_feed, stream_table, changes_between, stream_handlers, delta_table, delta_feed, stream_fanout, stream_fanout_live, stream_updates)}

ORACLES = {
    "stream_sink": LOG + " select id, seq, value, props from l where op = 'update'",
    "stream_resume": LOG + " select id, seq from l where op = 'delete'",
    "stream_fanout": feeds.ORACLES["fanout"],
    "stream_fanout_live": feeds.ORACLES["fanout_live"],
    "stream_updates": feeds.ORACLES["publish_union"],
    "stream_feed": feeds.ORACLES["images"],
    "stream_table": writes.ORACLES["fold_incremental"],
    "changes_between": IMAGES
    + """,
    cut as (select min(seq) + cast(ceil((max(seq) - min(seq) + 1) / 3.0) as bigint) as edge from l),
    early as (select * from (select *, row_number() over (partition by id order by seq desc) rn from img
                         where seq < (select edge from cut)) where rn = 1 and op <> 'delete'),
    final as (select * from (select *, row_number() over (partition by id order by seq desc) rn from img)
          where rn = 1 and op <> 'delete')
    select coalesce(early.id, final.id) as id,
           case when early.id is null then 'INSERT' when final.id is null then 'REMOVE' else 'MODIFY' end as kind,
           early.new_value as old_value, early.new_props as old_props, final.new_value, final.new_props
    from early full join final on early.id = final.id where early.seq is distinct from final.seq""",
    "stream_handlers": IMAGES
    + """ select 'removals' as handler, id, seq, old_value as value from img where op = 'delete'
          union all select 'large', id, seq, new_value from img
          where op = 'update' and new_value >= 50 and contains(new_props, '1')""",
    "delta_table": writes.ORACLES["fold_incremental"],
    "delta_feed": feeds.ORACLES["images"],
}
