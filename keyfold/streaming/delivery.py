"""Events to the handlers of an application, each subscription on its own.

A ledger says for every subscription which batch it was given last. A batch is offered to all
whose ledger is behind it, so a handler that fails is asked again, also by a later run, while the
others are not given anything twice. The ledger belongs to the stream's checkpoint, whose batches it
numbers; both are kept in the same folder.

A handler gets a DataFrame: it decides what to write, send or count, and nothing is collected
for it. One that dies between its work and the ledger's entry is asked again: at least once per handler, exactly
once if it writes by the number of its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyfold.functions.predicates import all_of
from keyfold.operators.feed import subscribe
from keyfold.sources.snapshot import remove


@dataclass(frozen=True)
class Subscription:
    """A named listener of one channel.

    ``filters`` are declarations (field, operator, value), AND-ed. ``on_data`` is called with the events of a
    batch and its number, ``on_error`` with the exception of the last try.
    """

    name: str
    event: str
    on_data: Callable[[DataFrame, int], None]
    filters: Sequence[Mapping] = ()
    on_error: Callable[[Exception], None] | None = None


class DeliveryFailed(Exception):
    """Some subscriptions were not given a batch; the next run offers it to them again."""

    def __init__(self, batch: int, names: Sequence[str]):
        super().__init__(f"batch {batch} was not delivered to {sorted(names)}")
        self.batch, self.names = batch, sorted(names)


class Deliveries:
    """Deliver the batches of a feed to subscriptions under a folder of their own."""

    def __init__(self, spark: SparkSession, root: str, subscriptions: Sequence[Subscription], tries: int = 3):
        names = [s.name for s in subscriptions]
        if len(set(names)) != len(names):
            raise ValueError("subscriptions need names of their own")
        self.spark, self.root, self.subscriptions, self.tries = spark, root, list(subscriptions), tries

    # --- the ledger: one empty folder per subscription that bears the number ------

    def _ledger(self, name: str) -> str:
        return f"{self.root}/ledger/{hashlib.sha256(name.encode()).hexdigest()[:32]}"

    def _numbers(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._ledger(name))
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.listStatus(path) if system.exists(path) else []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in found)

    def delivered(self, name: str) -> int:
        """The last batch a subscription was given, -1 before the first."""
        return max(self._numbers(name), default=-1)

    def _enter(self, name: str, batch: int) -> None:
        """The new number appears before the old one goes, so there is always one."""
        older = self._numbers(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._ledger(name)}/batch={batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        for number in older:
            if number < batch:
                remove(self.spark, f"{self._ledger(name)}/batch={number}")

    # --- delivery -----------------------------------------------------------------

    def deliver(self, events: DataFrame, batch: int) -> None:
        """Offer one batch to all that were not given it; safe to call again.

        All others are served before :class:`DeliveryFailed` tells of those whose handler failed every try.
        """
        waiting = [s for s in self.subscriptions if self.delivered(s.name) < batch]
        if not waiting:
            return
        events = events.persist()  # one read for all handlers; lost blocks are computed again
        failed = []
        try:
            for one in waiting:
                channel = subscribe(events, one.event)
                channel = channel.filter(all_of(events, one.filters))
                if self._given(one, channel, batch):
                    self._enter(one.name, batch)
                else:
                    failed.append(one.name)
        finally:
            events.unpersist()
        if failed:
            raise DeliveryFailed(batch, failed)

    def _given(self, one: Subscription, channel: DataFrame, batch: int) -> bool:
        error = None
        for _ in range(self.tries):
            try:
                one.on_data(channel, batch)
                return True
            except Exception as failure:  # a handler is the application's code: any failure of it is its own
                error = failure
        if one.on_error:
            one.on_error(error)
        return False

    def start(self, feed: DataFrame, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
        """Deliver a streaming feed. A run that ended by a failing handler starts again with its batch."""
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        return (
            feed.writeStream.foreachBatch(self.deliver)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**trigger)
            .start()
        )
