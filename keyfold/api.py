"""Tables of a tenant as objects: define, read, write, publish and subscribe.

This is the surface an application uses; all work is done by the operators. A write
is a batch of change-log rows: it is validated, stored as a log batch, and applied
by the same step that applies a micro-batch of the stream, so every write leaves the
log, the next table version and the change feed behind. One writer per table.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from keyfold.functions.naming import NAMESPACE_DIGITS
from keyfold.functions.predicates import all_of
from keyfold.functions.rules import record_rules, with_status
from keyfold.model import SYSTEM_FIELDS, Field, TableSpec, table_spec
from keyfold.operators import feed as feeds, read, registry as reg
from keyfold.operators.write import iso_utc, repeated
from keyfold.sources.log import CREATE, DELETE, UPDATE, LogSpec
from keyfold.sources.snapshot import Conflict, Head, Snapshot, path_exists, remove
from keyfold.streaming.delivery import Deliveries, Subscription
from keyfold.streaming.pipeline import ChangePipeline

KEY = "id"
ORDER = "_order"
#: names of the fields that a row of a list gives
GIVEN = "_given"
#: names of the fields whose value does not fit their type
MISFIT = "_misfit"


#: bits of a position inside a batch; the batch number is above them
ORDER_BITS = 36
#: attempts at a change of definitions when other writers are faster
COMMIT_TRIES = 16
#: rows of a list that are stored as one file
ONE_FILE = 10_000


def _fits(value: object, dtype: T.DataType) -> bool:
    """Whether a Python value can stand in a column of the type."""
    if value is None:
        return True
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    if isinstance(dtype, T.ArrayType):
        return isinstance(value, (list, tuple)) and all(_fits(v, dtype.elementType) for v in value)
    return True


@dataclass(frozen=True)
class Result:
    """What a write did: accepted records as they are now (or were, for a delete), and rejects."""

    data: DataFrame
    rejected: DataFrame
    #: one row per row of a list, by its position: position, id, ok, error_field, error_rule
    outcome: DataFrame | None = None


def _now() -> Column:
    """The UTC time of the call as a literal, whatever time zone session and driver have."""
    text = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


class Database:
    """The tables of one tenant under a root folder shared by all tenants.

    A tenant's definitions are in one bucket: reads and changes of definitions leave those of most other tenants
    alone, and any number of writers may change them at once.
    """

    def __init__(self, spark: SparkSession, root: str, tenant_key: str):
        self.spark, self.root = spark, root
        self.tenant = hashlib.sha256(tenant_key.encode()).hexdigest()[:NAMESPACE_DIGITS]
        self._store = Snapshot(spark, f"{root}/registry", reg.SCHEMA, ("tenant",), 64)
        self._places: dict[int | None, list[int]] = {}

    # --- definitions ------------------------------------------------------------

    def registry(self) -> DataFrame:
        """The definitions of all tenants."""
        return self._store.read()

    def _buckets(self, head: Head | None) -> list[int]:
        """The bucket of this tenant's definitions."""
        count = head.buckets if head is not None else None
        if count not in self._places:
            self._places[count] = self._store.touched(self.spark.createDataFrame([(self.tenant,)], "tenant string"), head)
        return self._places[count]

    def _mine(self) -> DataFrame:
        """This tenant's definitions."""
        head = self._store.head()
        return self._store.read(buckets=self._buckets(head), head=head).filter(F.col("tenant") == self.tenant)

    def _change(self, decide: Callable[[DataFrame], tuple[DataFrame | None, object]]):
        """Commit what ``decide`` makes of the definitions in this tenant's bucket, and return its answer.

        ``decide`` gives the bucket's new content, None if it stays as it is. If another writer was faster,
        it decides again on what that one left, so a name that was taken meanwhile is seen as taken.
        """
        for last in [False] * (COMMIT_TRIES - 1) + [True]:
            head = self._store.head()
            buckets = self._buckets(head)
            after, answer = decide(self._store.read(buckets=buckets, head=head))
            if after is None:
                return answer
            try:
                self._store.commit(after, buckets, head=head, shared=True)
                return answer
            except Conflict:
                if last:
                    raise
                time.sleep(random.random() / 5)

    def _definitions(self, specs: Sequence[TableSpec], subscriptions: Mapping[str, list]) -> DataFrame:
        rows = [
            (
                self.tenant,
                spec.name,
                i,
                str(uuid.uuid4()),
                [f.as_row() for f in spec.fields],
                subscriptions.get(spec.name),
                spec.description,
            )
            for i, spec in enumerate(specs)
        ]
        schema = T.StructType(
            [
                reg.SCHEMA["tenant"],
                reg.SCHEMA["table_name"],
                T.StructField("ordinal", T.LongType()),
                reg.SCHEMA["table_id"],
                reg.SCHEMA["fields"],
                reg.SCHEMA["subscriptions"],
                reg.SCHEMA["description"],
            ]
        )
        return self.spark.createDataFrame(rows, schema)

    def create_tables(
        self,
        specs: Sequence[TableSpec],
        subscriptions: Mapping[str, list] | None = None,
        if_absent: bool = False,
    ) -> list[Row]:
        """Register tables; one status row each, a taken name does not stop the others.

        With ``if_absent`` a name that exists counts as success and stays as it is.
        """
        if any(not s.name or not s.fields for s in specs) or not specs:
            raise ValueError("every table needs a name and fields")
        definitions = self._definitions(specs, subscriptions or {})

        def decide(current: DataFrame):
            statuses = reg.register(current, definitions, idempotent=if_absent)
            outcome = statuses.orderBy("ordinal").collect()  # one row per requested table
            if all(row["status"] != "created" for row in outcome):
                return None, outcome
            after = reg.registered(current, definitions, statuses, _now(), table_id=F.col("table_id"))
            return after, outcome

        return self._change(decide)

    def create_table(
        self, name: str, fields: Sequence[Field | Mapping], subscriptions: list | None = None,
        description: str = "", if_absent: bool = False,
    ) -> "Table":
        spec = table_spec(name, fields, description)
        status = self.create_tables([spec], {name: subscriptions} if subscriptions else None, if_absent)[0]
        if status["status"] == "failed":
            raise ValueError(f"table {name!r}: {status['error']}")
        return self.table(name)

    def list_tables(self) -> DataFrame:
        return reg.list_tables(self._mine(), self.tenant)

    def table_counts(self) -> DataFrame:
        """Tables of this tenant, counted."""
        return reg.table_counts(self._mine())

    def table_schema(self, name: str) -> DataFrame:
        """The field dictionary of a table, system fields included."""
        return reg.table_schema(self._row(name)).drop(*reg.KEY)

    def table_metadata(self, name: str) -> DataFrame:
        """The registry row of a table: fields, subscriptions, description, names, stamps."""
        return self._row(name)

    def _row(self, name: str) -> DataFrame:
        return self._mine().filter(F.col("table_name") == name)

    def update_table(
        self, name: str, fields: Sequence[Field | Mapping] | None = None,
        subscriptions: list | None = None, description: str | None = None,
    ) -> "Table":
        """Replace what is given; the records stay as they are."""
        row = (
            self.tenant, name,
            None if fields is None else [f.as_row() for f in table_spec(name, fields).fields],
            subscriptions, description,
        )
        schema = T.StructType([reg.SCHEMA[c] for c in (*reg.KEY, "fields", "subscriptions", "description")])
        updates = self.spark.createDataFrame([row], schema)

        def decide(current: DataFrame):
            changed, rejected = reg.evolve(current, updates, _now())
            if not rejected.isEmpty():
                raise KeyError(f"no table {name!r}")
            return changed, None

        self._change(decide)
        return self.table(name)

    def delete_table(self, name: str, keep_data: bool = False) -> None:
        """Retire a definition and, unless ``keep_data``, remove its records, log and feed.

        The definition goes first, so that no reader finds a table without its data. Safe to repeat.
        """

        def decide(current: DataFrame):
            named = current.filter((F.col("tenant") == self.tenant) & (F.col("table_name") == name))
            found = named.select("table_id").first()
            return None if found is None else reg.retire(current, named), found

        found = self._change(decide)
        if found is not None and not keep_data:
            remove(self.spark, f"{self.root}/tables/{found['table_id']}")

    def subscription_rows(self) -> DataFrame:
        """Declared subscriptions of this tenant's tables."""
        return reg.subscription_rows(self._mine())

    def table(self, name: str) -> "Table":
        found = self._row(name).first()
        if found is None:
            raise KeyError(f"no table {name!r}")
        spec = TableSpec(
            name, tuple(Field(*f) for f in found["fields"]), found["description"]
        )
        # declared filters of all subscriptions; of a field that several declare the first one counts
        declared: dict[str, dict] = {}
        for f in (f for s in found["subscriptions"] or [] for f in s["filters"] or []):
            declared.setdefault(f["field"], {"operator": f["operator"] or "eq", "value": f["value"]})
        return Table(self.spark, f"{self.root}/tables/{found['table_id']}", spec, declared)


class Table:
    """One table: reads on its newest version, writes as log batches, live channels."""

    def __init__(self, spark: SparkSession, root: str, spec: TableSpec, declared: Mapping[str, Mapping] | None = None):
        self.spark, self.root, self.spec, self._filters = spark, root, spec, dict(declared or {})
        #: the fields that the table's subscriptions declare filters on
        self.declared = list(self._filters)
        self.fields = [f for f in spec.fields if f.name not in SYSTEM_FIELDS]
        self.log_spec = LogSpec((KEY,), tuple(f.name for f in self.fields))
        self.log_schema = T.StructType(
            [
                T.StructField(KEY, T.StringType()),
                T.StructField("seq", T.LongType()),
                T.StructField("ts", T.TimestampNTZType()),
                T.StructField("op", T.StringType()),
                *[T.StructField(f.name, f.spark_type) for f in self.fields],
                *[T.StructField(f"present_{f.name}", T.BooleanType()) for f in self.fields],
            ]
        )
        self.pipeline = ChangePipeline(spark, root, self.log_spec, self.log_schema, buckets=16, indexed=self._indexed())

    def _indexed(self) -> tuple[str, ...]:
        """Fields declared as indexed whose type can have a bloom filter."""
        plain = (T.StringType, T.LongType, T.DoubleType)
        return tuple(f.name for f in self.fields if f.indexed and isinstance(f.spark_type, plain))

    # --- reads ------------------------------------------------------------------

    def records(self, version: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """All records in the current definition; fields added later are NULL in old ones.

        ``ids`` limits the read to the buckets that can hold them.
        """
        return self.pipeline.table(version, ids).select(
            KEY,
            *[f.name for f in self.fields],
            iso_utc(F.col("created_at")).alias("createdAt"),
            iso_utc(F.col("updated_at")).alias("updatedAt"),
        )

    def get(self, record_id: str) -> DataFrame:
        ids = self._frame([{KEY: record_id}], [KEY])
        return read.get(self.records(ids=ids), KEY, record_id)

    def get_many(self, ids: DataFrame, column: str = KEY) -> DataFrame:
        wanted = ids.select(F.col(column).cast("string").alias(KEY))
        return read.batch_get(self.records(ids=wanted), wanted, KEY)

    def list(self, filters: Mapping | None = None, limit: int | None = None, token: str | None = None,
             **options) -> DataFrame:
        return read.list_records(self.records(), KEY, filters, limit, token, **options)

    def page(self, filters: Mapping | None = None, limit: int | None = None, token: str | None = None,
             by: str | None = None, descending: bool = False) -> DataFrame:
        """A page in key order, or in the order of any field, with the cursor of the next one."""
        return read.page(self.records(), KEY, filters, limit, token, by=by, descending=descending)

    def query_page(self, key_condition: Mapping, order_key: str, **options) -> DataFrame:
        """A page of a key query with the cursor of the next one."""
        return read.query_page(self.records(), key_condition, order_key, KEY, **options)

    def pages(self, size: int = read.MAX_PAGE) -> DataFrame:
        return read.bulk_pages(self.records(), KEY, size)

    def sorted(self, by: str, descending: bool = False, limit: int | None = None,
               token: str | None = None) -> DataFrame:
        return read.list_sorted(self.records(), KEY, by, descending, limit, token)

    def scan(self, **options) -> DataFrame:
        return read.scan(self.records(), key=KEY, **options)

    def query(self, key_condition: Mapping, **options) -> DataFrame:
        return read.query(self.records(), key_condition, KEY, **options)

    def count(self, filters: Mapping | None = None) -> int:
        return read.count(self.records(), filters).first()["n"]

    # --- writes -----------------------------------------------------------------

    def _frame(self, rows: DataFrame | Sequence[Mapping], names: Sequence[str]) -> DataFrame:
        """Rows in the types of their fields. A value that does not fit is NULL and named in ``MISFIT``."""
        if isinstance(rows, DataFrame):
            found = [f for f in self.fields if f.name in rows.columns and rows.schema[f.name].dataType != f.spark_type]
            if not found:
                return rows
            misfit = F.array_compact(
                F.array(
                    *[
                        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.spark_type).isNull(), F.lit(f.name))
                        for f in found
                    ]
                )
            )
            return rows.withColumn(MISFIT, misfit).withColumns(
                {f.name: F.col(f.name).try_cast(f.spark_type) for f in found}
            )
        types = {KEY: T.StringType(), **{f.name: f.spark_type for f in self.fields}}
        schema = T.StructType(
            [
                *[T.StructField(n, types[n]) for n in names],
                T.StructField(ORDER, T.LongType()),
                T.StructField(GIVEN, T.ArrayType(T.StringType())),
                T.StructField(MISFIT, T.ArrayType(T.StringType())),
            ]
        )
        values = []
        for i, r in enumerate(rows):
            misfit = [n for n in names if not _fits(r.get(n), types[n])]
            own = [None if n in misfit else r.get(n) for n in names]
            own = [float(v) if isinstance(types[n], T.DoubleType) and v is not None else v for n, v in zip(names, own)]
            values.append((*own, i, [n for n in names if n in r], misfit))
        return self.spark.createDataFrame(values, schema)

    def _log(
        self, df: DataFrame, op: str, given: Sequence[str], batch: int, order: str | None = None
    ) -> DataFrame:
        order = order or (ORDER if ORDER in df.columns else None)
        position = F.lit(0) if order is None else F.col(order)
        types = {f.name: f.spark_type for f in self.fields}
        return df.select(
            F.col(KEY).cast("string").alias(KEY),
            (F.lit(batch << ORDER_BITS).cast("bigint") + position).alias("seq"),
            _now().alias("ts"),
            F.lit(op).alias("op"),
            *[
                (F.col(n) if n in given else F.lit(None)).cast(types[n]).alias(n)
                for n in self.log_spec.fields
            ],
            *[
                (F.array_contains(GIVEN, n) if GIVEN in df.columns and op == UPDATE else F.lit(n in given or op == CREATE))
                .alias(f"present_{n}")
                for n in self.log_spec.fields
            ],
        )

    def _placed(self, judged: DataFrame, order: str | None) -> DataFrame:
        """Rejects rows with misfitting values, positions out of range, and ids that repeat without any."""
        if MISFIT in judged.columns:
            bad = F.coalesce(F.size(MISFIT) > 0, F.lit(False))
            reasons = {"ok": F.lit(False), "error_field": F.get(F.col(MISFIT), F.lit(0)), "error_rule": F.lit("type")}
            judged = judged.withColumns({n: F.when(bad, c).otherwise(F.col(n)) for n, c in reasons.items()}).drop(MISFIT)
        order = order or (ORDER if ORDER in judged.columns else None)
        rejected = {"ok": F.lit(False), "error_field": F.lit(order or KEY), "error_rule": F.lit("position" if order else "repeated")}
        if order:
            fits = F.coalesce(F.col(order).between(0, (1 << ORDER_BITS) - 1), F.lit(False))
            return judged.withColumns({n: F.when(F.col("ok") & ~fits, c).otherwise(F.col(n)) for n, c in rejected.items()})
        twice = repeated(judged.filter(F.col("ok") & (F.coalesce(F.col(KEY).cast("string"), F.lit("")) != "")), [KEY])
        marked = judged.join(twice.withColumn("_twice", F.lit(True)), KEY, "left")
        again = F.coalesce("_twice", F.lit(False)) & F.col("ok")
        return marked.withColumns(
            {n: F.when(again, c).otherwise(F.col(n)) for n, c in rejected.items()}
        ).select(*judged.columns)

    def _apply(self, log: DataFrame, batch: int, rows: int | None = None) -> DataFrame:
        """Store the batch first: generated ids and stamps are fixed before they are used.

        ``rows`` bounds the number of rows of a batch that came as a list; a small one is one file.
        """
        path = f"{self.root}/log/batch={batch}"
        if rows is not None and rows <= ONE_FILE:
            log = log.coalesce(1)
        log.write.mode("overwrite").parquet(path)
        stored = self.spark.read.schema(self.log_schema).parquet(path)
        self.pipeline.process(stored, batch, rows)
        changed = f"{self.pipeline.feed_path}/batch={batch}"
        if not path_exists(self.spark, changed):
            return self.spark.createDataFrame([], self.payload_schema())
        return feeds.payload(self.spark.read.parquet(changed), self.log_spec)

    def payload_schema(self) -> T.StructType:
        return T.StructType([f for f in self.log_schema.fields if not f.name.startswith("present_")])

    def _next_batch(self) -> int:
        head = self.pipeline.snapshot.head()
        return 0 if head is None else head.batch_id + 1

    def create_many(self, rows: DataFrame | Sequence[Mapping], order: str | None = None) -> Result:
        """Create or replace records; bad ones are rejected with their first error.

        Rows given as a list are applied in order. A DataFrame in which ids repeat needs
        ``order``, a column of positions from 0 to below 2**36: rows out of that range are rejected,
        and without ``order`` all rows of an id that repeats are.
        """
        n = None if isinstance(rows, DataFrame) else len(rows)
        df = self._frame(rows, [KEY, *self.log_spec.fields])
        given = [n for n in self.log_spec.fields if n in df.columns]
        if KEY not in df.columns:
            df = df.withColumn(KEY, F.lit(None).cast("string"))
        missing = {f.name: F.lit(None).cast(f.spark_type) for f in self.fields if f.name not in df.columns}
        judged = self._placed(with_status(df.withColumns(missing), record_rules(self.fields)), order)
        good = judged.filter("ok")
        filled = good.withColumn(
            KEY, F.when(F.coalesce(F.col(KEY), F.lit("")) == "", F.expr("uuid()")).otherwise(F.col(KEY))
        )
        batch = self._next_batch()
        data = self._apply(self._log(filled, CREATE, given, batch, order), batch, n)
        return Result(data, judged.filter("not ok").drop(ORDER, GIVEN), self._outcome(judged, batch))

    def _outcome(self, judged: DataFrame, batch: int) -> DataFrame | None:
        """What became of every row of a list; the ids are those that were stored."""
        if ORDER not in judged.columns:
            return None
        log = self.spark.read.schema(self.log_schema).parquet(f"{self.root}/log/batch={batch}")
        made = log.select((F.col("seq") - (batch << ORDER_BITS)).alias("position"), F.col(KEY).alias("_id"))
        return (
            judged.select(F.col(ORDER).alias("position"), KEY, "ok", "error_field", "error_rule")
            .join(made, "position", "left")
            .select("position", F.coalesce("_id", KEY).alias(KEY), "ok", "error_field", "error_rule")
        )

    def create(self, record: Mapping) -> Result:
        return self.create_many([record])

    def update_many(self, rows: DataFrame | Sequence[Mapping], order: str | None = None) -> Result:
        """Merge the given fields; bad values and unknown ids are rejected.

        Every row of a list gives its own fields, and those of a DataFrame all of its columns; the
        system fields are never taken from them. Order as in :meth:`create_many`.
        """
        count = None if isinstance(rows, DataFrame) else len(rows)
        if not isinstance(rows, DataFrame):
            names = [n for n in self.log_spec.fields if any(n in r for r in rows)]
        else:
            names = []
        rows = self._frame(rows, [KEY, *names])
        given = [n for n in self.log_spec.fields if n in rows.columns]
        declared = [f for f in self.fields if f.name in given]
        rules = record_rules(
            declared,
            partial=True,
            present={n: F.array_contains(GIVEN, n) for n in given} if GIVEN in rows.columns else None,
        )
        judged = with_status(rows, rules) if rules else rows.selectExpr(
            "*", "true as ok", "cast(null as string) error_field", "cast(null as string) error_rule"
        )
        judged = self._placed(judged, order)
        good = judged.filter("ok")
        known = self.records(ids=good).select(KEY)
        unknown = good.join(known, KEY, "left_anti").withColumns(
            {"ok": F.lit(False), "error_field": F.lit(KEY), "error_rule": F.lit("not_found")}
        )
        rejected = judged.filter("not ok").unionByName(unknown.select(*judged.columns))
        batch = self._next_batch()
        data = self._apply(self._log(good, UPDATE, given, batch, order), batch, count)
        outcome = None
        if ORDER in judged.columns:
            failed = rejected.select(F.col(ORDER).alias("position"), KEY, "ok", "error_field", "error_rule")
            done = judged.select(F.col(ORDER).alias("position"), KEY, "ok", "error_field", "error_rule")
            outcome = done.join(failed.select("position"), "position", "left_anti").unionByName(failed)
        return Result(data, rejected.drop(ORDER, GIVEN), outcome)

    def update(self, record_id: str, changes: Mapping) -> Result:
        return self.update_many([{**changes, KEY: record_id}])

    def delete_many(self, ids: DataFrame | Sequence[str]) -> Result:
        """Remove records; ``data`` has them as they were. Unknown ids are no error."""
        count = None if isinstance(ids, DataFrame) else len(ids)
        if not isinstance(ids, DataFrame):
            ids = self._frame([{KEY: i} for i in ids], [KEY]).select(KEY)
        batch = self._next_batch()
        log = self._log(ids.select(KEY).distinct(), DELETE, [], batch)
        return Result(self._apply(log, batch, count), ids.select(KEY).limit(0))

    def delete(self, record_id: str) -> Result:
        return self.delete_many([record_id])

    # --- live channels ----------------------------------------------------------

    def publish(self, events: DataFrame | Sequence[Mapping]) -> None:
        """Send events to the update channel without storing a record."""
        if not isinstance(events, DataFrame):
            names = [n for n in (KEY, *self.log_spec.fields) if any(n in e for e in events)]
            events = self._frame(events, names).drop(ORDER, GIVEN, MISFIT)
        stamped = events.withColumns(
            {"seq": F.lit(None).cast("bigint"), "ts": _now()}
        )
        given = [n for n in self.log_spec.fields if n in events.columns]
        sent = feeds.publish(stamped, self.log_spec, given)
        types = {f.name: f.dataType for f in self.payload_schema().fields}
        whole = sent.select(
            *[
                F.col(n).cast(t).alias(n) if n in sent.columns else F.lit(None).cast(t).alias(n)
                for n, t in types.items()
            ]
        )
        whole.write.mode("append").parquet(f"{self.root}/published")

    def feed_schema(self) -> T.StructType:
        record = T.StructType([T.StructField(f.name, f.spark_type) for f in self.fields])
        return T.StructType(
            [
                *self.log_schema.fields[:4],
                T.StructField("kind", T.StringType()),
                T.StructField("old", record),
                T.StructField("new", record),
            ]
        )

    def subscribe(
        self, event: str, filters: Mapping | Sequence[Mapping] | None = None, new_only: bool = False
    ) -> DataFrame:
        """A streaming DataFrame of one channel; end it in any sink.

        The update channel also carries published events. ``filters`` are values by field, compared by the
        operator the table declares for the field (``eq`` where it declares none), or declarations (field,
        operator, value) with operators of their own; all are AND-ed. A field without a value takes the
        declared constant, and constrains nothing if there is none. Only declared filter fields
        count where the table declares some. With ``new_only`` events of before the call are
        left out; otherwise a new listener hears the whole history.
        """
        started = _now()
        channel = feeds.subscribe(self.events(), event)
        if new_only:
            channel = channel.filter(F.col("ts") >= started)
        return channel.filter(all_of(channel, self._chosen(filters)))

    def _chosen(self, filters: Mapping | Sequence[Mapping] | None) -> list[dict]:
        """Filters of a listener with what the table declares for their fields."""
        if filters is None or isinstance(filters, Mapping):
            filters = [{"field": n, "value": v} for n, v in (filters or {}).items()]
        chosen = []
        for given in filters:
            declared = self._filters.get(given["field"], {})
            if self.declared and not declared:
                continue
            value = given.get("value")
            chosen.append(
                {
                    "field": given["field"],
                    "operator": given.get("operator") or declared.get("operator"),
                    "value": declared.get("value") if value is None else value,
                }
            )
        return chosen

    def events(self) -> DataFrame:
        """All events of the table as a stream: accepted changes, and what was published."""
        self._make_folders()
        stored = self.spark.readStream.schema(self.feed_schema()).parquet(self.pipeline.feed_path)
        published = self.spark.readStream.schema(self.payload_schema()).parquet(f"{self.root}/published")
        return feeds.update_channel(feeds.payload(stored, self.log_spec), published)

    def listen(
        self, subscriptions: Sequence[Subscription], folder: str, available_now: bool = False, tries: int = 3
    ) -> StreamingQuery:
        """Call the handlers of subscriptions with their events; ``folder`` keeps how far each of them is."""
        chosen = [replace(s, filters=self._chosen(s.filters)) for s in subscriptions]
        return Deliveries(self.spark, folder, chosen, tries).start(self.events(), available_now)

    def _make_folders(self) -> None:
        """Both ends of the channels exist before the first event."""
        for path, schema in (
            (f"{self.pipeline.feed_path}/batch=-1", self.feed_schema()),
            (f"{self.root}/published", self.payload_schema()),
        ):
            if not path_exists(self.spark, path):
                self.spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def history(self, record_id: str | None = None) -> DataFrame:
        """Edits with the values before and after, of one record or of all."""
        edits = feeds.edit_history(self.pipeline.feed(), self.log_spec)
        return edits if record_id is None else edits.filter(F.col(KEY) == record_id)

    def by_filter(self, condition: Column) -> DataFrame:
        return self.records().filter(condition)
