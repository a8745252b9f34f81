"""The application surface, end to end: a chat with listeners."""

import pytest
from pyspark.sql import functions as F

from keyfold.api import Database
from keyfold.model import Field, table_spec
from keyfold.operators import registry as reg
from keyfold.session import work_dir
from keyfold.sources.snapshot import path_exists
from keyfold.streaming import channels

FIELDS = [
    {"name": "chatId", "required": True, "indexed": True},
    {"name": "content", "required": True},
    {"name": "username", "required": True, "indexed": True},
    {"name": "isEdited", "type": "Boolean"},
]
FILTERS = [([("chatId", "String", None, None), ("username", "String", None, None)],)]


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark, work_dir(spark, "db"), "secret-key")


@pytest.fixture(scope="module")
def messages(db):
    return db.create_table("messages", FIELDS, FILTERS, "chat messages")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_definitions(spark, db, messages):
    assert [r["table_name"] for r in db.list_tables().collect()] == ["messages"]
    with pytest.raises(ValueError):
        db.create_table("messages", FIELDS)
    assert db.create_table("messages", FIELDS, if_absent=True).spec.description == "chat messages"
    names = {r["name"] for r in db.table_schema("messages").collect()}
    assert names == {"id", "createdAt", "updatedAt", "chatId", "content", "username", "isEdited"}
    assert db.subscription_rows().filter("event = 'update'").count() == 2
    with pytest.raises(KeyError):
        db.table("nope")
    other = Database(spark, db.root, "other-key")
    assert other.tenant != db.tenant and other.list_tables().count() == 0


def test_chat(spark, db, messages):
    made = messages.create_many(
        [
            {"id": "m1", "chatId": "general", "content": "hello", "username": "Alice"},
            {"id": "m2", "chatId": "general", "content": "hi", "username": "Bob"},
            {"chatId": "dev-team", "content": "new", "username": "Alice", "isEdited": False},
            {"id": "bad", "chatId": "general", "content": "", "username": "Bob"},
        ]
    )
    assert made.data.count() == 3 and made.rejected.first()["error_field"] == "content"
    assert messages.count() == 3 and messages.count({"chatId": "general"}) == 2
    generated = messages.list({"chatId": "dev-team"}).first()
    assert len(generated["id"]) == 36 and generated["createdAt"] == generated["updatedAt"]
    # the id that was returned is the id that was stored
    assert generated["id"] in ids(made.data)

    edited = messages.update("m1", {"content": "hello!", "isEdited": True})
    assert edited.data.first()["content"] == "hello!" and edited.data.first()["username"] == "Alice"
    row = messages.get("m1").first()
    assert row["content"] == "hello!" and row["updatedAt"] >= row["createdAt"]
    missing = messages.update("nope", {"content": "x"})
    assert missing.data.count() == 0 and missing.rejected.first()["error_rule"] == "not_found"

    gone = messages.delete("m2")
    assert gone.data.first()["content"] == "hi"
    assert messages.delete("m2").data.count() == 0
    assert messages.get("m2").count() == 0 and messages.count() == 2

    assert messages.history("m1").first()["old"]["content"] == "hello"
    assert messages.page(limit=1).first()["next_token"] is not None
    assert messages.pages(1).count() == 2


def test_live_channels(spark, db, messages):
    root = work_dir(spark, "listen")
    before = messages.count()

    def listen(event, filters=None):
        chosen = messages.subscribe(event, filters)
        query = channels.sink(chosen, f"{root}/{event}", f"{root}/{event}-checkpoint", available_now=True)
        query.awaitTermination()
        return spark.read.parquet(f"{root}/{event}")

    messages.publish([{"id": "ghost", "chatId": "general", "content": "typing"}])
    updates = listen("update", {"chatId": "general", "content": "ignored"})
    assert ids(updates) == ["ghost", "m1"]
    messages.update("m1", {"content": "again"})
    assert ids(listen("update", {"chatId": "general"})) == ["ghost", "m1", "m1"]
    assert ids(listen("delete")) == ["m2"]
    assert listen("create", {"username": "Alice"}).count() == 2
    assert messages.count() == before and messages.get("ghost").count() == 0


def test_a_definition_changes_without_touching_records(spark, db, messages):
    changed = db.update_table("messages", FIELDS + [{"name": "mood", "type": "Int"}])
    assert changed.get("m1").first()["mood"] is None
    changed.update("m1", {"mood": 5})
    assert changed.get("m1").first()["mood"] == 5
    assert changed.records().filter(F.col("mood").isNotNull()).count() == 1
    assert changed.update("m1", {"mood": 2**40}).rejected.first()["error_rule"] == "int32_overflow"
    with pytest.raises(KeyError):
        db.update_table("nope", [Field("x")])


def test_rows_of_one_request_apply_in_order(spark, db):
    notes = db.create_table("notes", [{"name": "text"}, {"name": "n", "type": "Int"}])
    made = notes.create_many([{"id": "a", "text": "1", "n": 1}, {"id": "a", "text": "2"}, {"id": "b"}])
    assert made.data.count() == 3 and notes.count() == 2
    assert notes.get("a").select("text", "n").first() == ("2", None)
    notes.update_many([{"id": "a", "n": 5}, {"id": "a", "n": 6}])
    assert notes.get("a").select("text", "n").first() == ("2", 6)
    assert [r["new"]["n"] for r in notes.history("a").orderBy("seq").collect()][-2:] == [5, 6]
    frame = spark.createDataFrame([("c", "x", 2), ("c", "y", 1)], "id string, text string, at long")
    notes.create_many(frame, order="at")
    assert notes.get("c").first()["text"] == "x"
    many = notes.get_many(spark.createDataFrame([("a",), ("b",), ("b",), ("zz",)], "k string"), "k")
    assert ids(many) == ["a", "b"]
    # one key reads one bucket, and of it only the rows the pushed filter lets through
    assert len(notes.get("a").inputFiles()) == 1 and len(notes.records().inputFiles()) > 1
    metadata = db.table_metadata("notes").first()
    assert metadata["type_name"] == f"T{db.tenant}_notes" and len(metadata["fields"]) == 5


def test_no_row_of_a_request_is_lost(spark, db):
    rows = db.create_table("rows", [{"name": "a", "type": "Int"}, {"name": "b", "type": "Int"}, {"name": "_note"}])
    made = rows.create_many([{"id": "1", "a": 1, "b": 2, "_note": "n"}, {"id": "2", "a": 3, "b": "x"}, {"a": 4, "b": 4}])
    outcome = made.outcome.orderBy("position").collect()
    assert [r["ok"] for r in outcome] == [True, False, True]
    assert (outcome[1]["id"], outcome[1]["error_field"], outcome[1]["error_rule"]) == ("2", "b", "type")
    assert outcome[2]["id"] in ids(rows.records())

    # every row gives its own fields
    rows.create({"id": "2", "a": 3, "b": 4})
    changed = rows.update_many([{"id": "1", "a": 5}, {"id": "2", "b": 6}, {"id": "9", "a": 1}, {"id": "1", "_note": None}])
    assert [r["ok"] for r in changed.outcome.orderBy("position").collect()] == [True, True, False, True]
    assert rows.get("1").select("a", "b", "_note").first() == (5, 2, None)
    assert rows.get("2").select("a", "b").first() == (3, 6)

    # positions out of range, repeated ids without any, and values that don't fit
    frame = spark.createDataFrame([("p", 1, 2**50), ("q", 2, -1), ("r", 3, None), ("s", 4, 7)], "id string, a int, at long")
    assert sorted(r["id"] for r in rows.create_many(frame, order="at").rejected.collect()) == ["p", "q", "r"]
    twice = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "id string, a int")
    assert {(r["id"], r["error_rule"]) for r in rows.create_many(twice).rejected.collect()} == {("t", "repeated")}
    assert rows.get("u").first()["a"] == 3 and rows.get("t").count() == 0
    typed = spark.createDataFrame([("v", "12"), ("w", "x")], "id string, a string")
    assert [(r["id"], r["error_rule"]) for r in rows.create_many(typed).rejected.collect()] == [("w", "type")]
    assert rows.get("v").first()["a"] == 12
    rows.update("s", {"a": 8})
    assert rows.get("s").first()["a"] == 8


def test_all_declared_subscriptions_count_and_tenants_are_apart(spark, db):
    filters = [([("a", "String", None, None)],), ([("b", "String", None, None)],)]
    assert db.create_table("declared", [{"name": "a"}, {"name": "b"}], filters).declared == ["a", "b"]
    other = Database(spark, db.root, "third-key")
    other.create_table("mine", [{"name": "x"}])
    assert other.table_counts().count() == 1 and not {"mine"} & {r["table_name"] for r in db.list_tables().collect()}
    assert other.subscription_rows().filter(F.col("tenant") != other.tenant).count() == 0


def test_a_listener_can_start_now(spark, db):
    told = db.create_table("told", [{"name": "x", "type": "Int"}])
    told.create({"id": "old", "x": 1})
    channel, root = told.subscribe("create", new_only=True), work_dir(spark, "now")
    told.create({"id": "new", "x": 2})
    channels.sink(channel, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    assert ids(spark.read.parquet(f"{root}/out")) == ["new"]


def test_tables_retire(spark, db):
    doomed = db.create_table("temporary", [Field("x", "Int")])
    doomed.create({"x": 1})
    assert path_exists(spark, doomed.root)
    db.delete_table("temporary")
    assert not path_exists(spark, doomed.root)
    db.delete_table("temporary")
    with pytest.raises(KeyError):
        db.table("temporary")


def test_two_writers_of_definitions_both_count(spark, monkeypatch):
    """A second writer commits between the first one's read and its commit."""
    root = work_dir(spark, "writers")
    first, second = Database(spark, root, "key"), Database(spark, root, "key")
    register, meddled = reg.register, []

    def meddling(*args, **options):
        statuses = register(*args, **options)
        if not meddled:
            meddled.append(True)
            second.create_table("taken", FIELDS, description="of the second")
            second.create_table("other", FIELDS)
        return statuses

    monkeypatch.setattr(reg, "register", meddling)
    outcome = first.create_tables([table_spec("taken", FIELDS, "of the first"), table_spec("own", FIELDS)])
    assert [(r["table_name"], r["status"]) for r in outcome] == [("taken", "failed"), ("own", "created")]
    found = {r["table_name"]: r["description"] for r in second.list_tables().collect()}
    assert found == {"taken": "of the second", "other": "", "own": ""}


def test_definitions_leave_other_tenants_files_alone(spark):
    root = work_dir(spark, "tenants")
    ours, theirs = Database(spark, root, "a"), Database(spark, root, "b")
    ours.create_table("mine", FIELDS)
    theirs.create_table("theirs", FIELDS)
    before = ours._store.head()
    ours.update_table("mine", description="changed")
    after = ours._store.head()
    (own,), (other,) = ours._buckets(after), theirs._buckets(after)
    assert own != other and after.held[other] == before.held[other] and after.held[own] != before.held[own]
    ours.delete_table("mine")
    ours.delete_table("mine")
    assert ours._store.head().version == after.version + 1
    assert ours.list_tables().count() == 0 and theirs.list_tables().count() == 1


def test_pages_by_an_indexed_field(spark):
    db = Database(spark, work_dir(spark, "paged"), "key")
    fields = [{"name": "room", "indexed": True}, {"name": "size", "type": "Int", "indexed": True}, {"name": "on", "type": "Boolean", "indexed": True}]
    table = db.create_table("rooms", fields)
    table.create_many([{"id": f"r{i}", "room": f"room {i % 3}", "size": i % 2, "on": True} for i in range(7)])
    assert table.pipeline.snapshot.indexed == ("room", "size")
    token, seen = None, []
    while True:
        rows = table.page(limit=2, token=token, by="size", descending=True).collect()
        seen += [r["id"] for r in rows]
        token = rows[0]["next_token"]
        if token is None:
            break
    assert seen == ["r1", "r3", "r5", "r0", "r2", "r4", "r6"]
    first = table.query_page({"room": "room 0"}, "size", limit=2).collect()
    rest = table.query_page({"room": "room 0"}, "size", limit=2, token=first[0]["next_token"]).collect()
    assert [r["id"] for r in first + rest] == ["r0", "r6", "r3"]
    token = table.page(limit=3, by="size").first()["next_token"]
    assert [r["id"] for r in table.sorted("size", limit=2, token=token).collect()] == ["r6", "r1"]
    assert ids(table.list({"room": "room 1"})) == ["r1", "r4"]
