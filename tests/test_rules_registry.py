"""Rules, coercion, inference and the registry."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F, types as T

from keyfold.functions import coerce, naming, rules
from keyfold.model import ARRAY, BOOLEAN, FLOAT, INT, STRING, Field, fields_of, logical_of, logical_type
from keyfold.operators import registry as reg, schemas
from keyfold.workload import registry as workload

FIELDS = [
    Field("id", STRING, True, False, True),
    Field("name", STRING, True, dtype=T.StringType()),
    Field("contact_email", STRING, dtype=T.StringType()),
    Field("age", INT, True, dtype=T.LongType()),
    Field("unit_price", FLOAT, dtype=T.DoubleType()),
]
SCHEMA = "id string, name string, contact_email string, age long, unit_price double"


def broken(df):
    return sorted((r["id"], r["field"], r["rule"]) for r in df.collect())


def test_full_and_partial_checks(spark):
    df = spark.createDataFrame(
        [
            ("ok", "n", "a@b.com", 1, 2.0),
            ("blank", "", None, None, None),
            ("bad", "n", "a@b", 151, -1.0),
            ("nan", "n", None, 2**40, math.nan),
        ],
        SCHEMA,
    )
    assert broken(schemas.check(df, ["id"], FIELDS)) == [
        ("bad", "age", "range"),
        ("bad", "contact_email", "email"),
        ("bad", "unit_price", "non_negative"),
        ("blank", "age", "required"),
        ("blank", "name", "required"),
        ("nan", "age", "int32_overflow"),
        ("nan", "age", "range"),
        ("nan", "unit_price", "type"),
    ]
    partial = schemas.check(df, ["id"], FIELDS, partial=True, present={"age": F.lit(False)})
    assert broken(partial) == [
        ("bad", "contact_email", "email"), ("bad", "unit_price", "non_negative"), ("nan", "unit_price", "type")
    ]
    status = {r["id"]: (r["ok"], r["error_field"], r["error_rule"])
              for r in rules.with_status(df, rules.record_rules(FIELDS)).collect()}
    assert status["ok"] == (True, None, None)
    assert status["blank"] == (False, "name", "required")
    assert status["nan"] == (False, "age", "int32_overflow")


def test_first_matching_name_wins():
    def names(field):
        return [r.name for r in rules.shape(field)]

    assert names(Field("email_url")) == ["email"] and names(Field("url_phone")) == ["url"]
    assert names(Field("age_count", INT)) == ["range"] and names(Field("quantity", INT)) == ["non_negative"]
    assert names(Field("amount", FLOAT)) == ["non_negative"] and names(Field("email", INT)) == []
    assert names(Field("price", INT)) == []


def test_json_types(spark):
    record = '{"s":"x","i":5.0,"j":5.5,"f":1,"b":true,"l":[1],"n":null,"t":"7","u":1}'
    df = spark.createDataFrame([("r", record)], "id string, j string").withColumn("v", F.parse_json("j"))

    def bad(*fields):
        checked, found = rules.json_typed(df, "v", [Field(n, t) for n, t in fields])
        return [f for _, f, _ in broken(rules.violations(checked, ["id"], found))]

    good = [("s", "String"), ("i", "Int"), ("f", "float"), ("j", "double"), ("b", "bool"), ("l", "list")]
    assert bad(*good, ("absent", "Int"), ("u", "mystery"), ("s", "number")) == []
    wrong = [("s", "Int"), ("j", "integer"), ("b", "String"), ("l", "Float"), ("n", "String"), ("t", "Int"),
             ("i", "Boolean")]
    assert bad(*wrong) == sorted(n for n, _ in wrong)


def values(spark, value, kind, dtype, **options):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", dtype)]))
    return df.select(coerce.coerce(F.col("x"), dtype, kind, **options).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value,kind,dtype,expected",
    [
        ("12abc", INT, T.StringType(), 12),
        ("", INT, T.StringType(), None),
        ("12.7", INT, T.StringType(), 12),
        (" -3", INT, T.StringType(), -3),
        ("+4", INT, T.StringType(), 4),
        ("false", INT, T.StringType(), None),
        (5.5, INT, T.DoubleType(), 5),
        (-5.5, INT, T.DoubleType(), -6),
        (math.nan, INT, T.DoubleType(), None),
        (True, INT, T.BooleanType(), None),
        ("1.5e3x", FLOAT, T.StringType(), 1500.0),
        ("3.", FLOAT, T.StringType(), 3.0),
        (".5", FLOAT, T.StringType(), 0.5),
        ("x1", FLOAT, T.StringType(), None),
        (7, FLOAT, T.LongType(), 7.0),
        ("false", BOOLEAN, T.StringType(), True),
        ("", BOOLEAN, T.StringType(), False),
        (0, BOOLEAN, T.LongType(), False),
        (math.nan, BOOLEAN, T.DoubleType(), False),
        (None, BOOLEAN, T.StringType(), False),
        ([1], BOOLEAN, T.ArrayType(T.LongType()), True),
        ("a", ARRAY, T.StringType(), ["a"]),
        ([1, 2], ARRAY, T.ArrayType(T.LongType()), [1, 2]),
        (5.0, STRING, T.DoubleType(), "5"),
        (5.5, STRING, T.DoubleType(), "5.5"),
        (True, STRING, T.BooleanType(), "true"),
        ([1, 2], STRING, T.ArrayType(T.LongType()), "1,2"),
        (3, "int", T.LongType(), "3"),
    ],
)
def test_coercion(spark, value, kind, dtype, expected):
    assert values(spark, value, kind, dtype) == expected


def test_strict_boolean_and_timestamps(spark):
    assert values(spark, "false", BOOLEAN, T.StringType(), strict=True) is False
    df = spark.createDataFrame([("a", "old"), ("b", None)], "x string, createdAt string")
    done = coerce.sanitize(df, [], now=F.lit("now")).collect()
    assert [(r["createdAt"], r["updatedAt"]) for r in done] == [("old", "now"), ("now", "now")]


def test_types_and_aliases():
    assert logical_type("NUMBER") == INT and logical_type("Double") == FLOAT and logical_type("x") == STRING
    assert logical_type(None) == STRING
    assert logical_of(T.DateType()) == STRING and logical_of(T.DecimalType(10, 2)) == FLOAT
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("l", T.ArrayType(T.LongType()))])
    assert [(f.name, f.type, f.indexed) for f in fields_of(schema, ["a", "nope"])] == [
        ("a", INT, True), ("l", ARRAY, False)
    ]


def test_inference_and_defaults(spark):
    df = spark.createDataFrame([("1", 1, None), ("2", 2, 1.0)], "id string, n int, x double")
    found = {r["name"]: tuple(r)[1:] for r in schemas.infer_fields(df, ["n"]).collect()}
    assert found == {
        "id": (STRING, True, False, True),
        "n": (INT, True, True, False),
        "x": (FLOAT, False, False, False),
        "createdAt": (STRING, True, False, False),
        "updatedAt": (STRING, True, False, False),
    }
    assert [r["x"] for r in schemas.apply_defaults(df, {"x": 9}).collect()] == [9.0, 1.0]


def test_create_many_keeps_going(spark):
    base = spark.createDataFrame([("a", "old", None, 1, None)], SCHEMA)
    new = spark.createDataFrame([("a", "new", None, 2, None), ("b", "", None, 1, None)], SCHEMA)
    done = schemas.create_many(base, new, ["id"], rules.record_rules(FIELDS))
    assert [(r["id"], r["name"]) for r in done.table.collect()] == [("a", "new")]
    assert [(r["id"], r["error_field"]) for r in done.rejected.collect()] == [("b", "name")]


# --- registry -----------------------------------------------------------------

DEFS = T.StructType(
    [reg.SCHEMA["tenant"], reg.SCHEMA["table_name"], reg.SCHEMA["fields"], reg.SCHEMA["subscriptions"],
     reg.SCHEMA["description"], T.StructField("ordinal", T.LongType())]
)


def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def field(name, kind=None, primary=None):
    return (name, kind, None, None, primary)


def definitions(spark, *rows):
    full = [(t, n, f, s, None, i) for i, (t, n, f, s) in enumerate(rows)]
    return spark.createDataFrame(full, DEFS)


def empty(spark):
    return spark.createDataFrame([], reg.SCHEMA)


def test_registering_in_two_modes(spark):
    x = [field("x")]
    first = definitions(spark, ("t1", "users", x, None), ("t2", "users", x, None))
    one = reg.register(empty(spark), first)
    registry = reg.registered(empty(spark), first, one, at())
    assert {r["status"] for r in one.collect()} == {"created"}
    row = registry.filter("tenant = 't1'").first()
    assert row["fields"][0].asDict() == {
        "name": "x", "type": "String", "required": False, "indexed": False, "primary": False
    }
    assert row["type_name"] == "Tt1_users" and row["subscriptions"] == [] and row["description"] == ""
    again = definitions(
        spark, ("t1", "users", x, None), ("t1", "chats", x, None), ("t1", "chats", x, None),
        ("t1", "", x, None), ("t1", "none", [], None),
    )

    def statuses(idempotent):
        return [(r["status"], r["error"]) for r in
                reg.register(registry, again, idempotent).orderBy("ordinal").collect()]

    assert statuses(False) == [("failed", "exists"), ("created", None), ("failed", "exists"),
                               ("failed", "missing"), ("failed", "no_fields")]
    assert statuses(True) == [("exists", None), ("created", None), ("exists", None),
                              ("failed", "missing"), ("failed", "no_fields")]
    grown = reg.registered(registry, again, reg.register(registry, again), at())
    assert [r["table_name"] for r in reg.list_tables(grown, "t1").collect()] == ["chats", "users"]
    left = reg.retire(grown, grown.filter("table_name = 'users'"))
    assert left.count() == 1 and reg.retire(left, grown.filter("table_name = 'users'")).count() == 1
    assert reg.retire(grown, grown.filter("tenant = 't1'").select("tenant")).count() == 1


def test_evolution_replaces_only_what_is_given(spark):
    first = definitions(spark, ("t", "users", [field("x")], [([("x", "String", None, None)],)]))
    registry = reg.registered(empty(spark), first, reg.register(empty(spark), first), at())
    updates = spark.createDataFrame(
        [("t", "users", [field("y", "Int")], None, None), ("t", "nope", None, None, "d")],
        T.StructType([reg.SCHEMA[c] for c in ("tenant", "table_name", "fields", "subscriptions", "description")]),
    )
    later = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    changed, rejected = reg.evolve(registry, updates, later)
    row = changed.first()
    assert [f["name"] for f in row["fields"]] == ["y"] and len(row["subscriptions"]) == 1
    assert row["created_at"].month == 1 and row["updated_at"].month == 2
    assert [r["table_name"] for r in rejected.collect()] == ["nope"]


def test_schema_and_subscription_rows(spark):
    subs = [([("chatId", "string", None, None), ("n", "Int", "gt", "3")],), ([("id", "String", "eq", None)],)]
    first = definitions(
        spark, ("t", "a", [field("id", "Int", True), field("z")], subs), ("t", "b", [field("z")], None)
    )
    registry = reg.registered(empty(spark), first, reg.register(empty(spark), first), at())
    names = [(r["table_name"], r["name"], r["type"]) for r in reg.table_schema(registry).collect()]
    assert [n for t, n, _ in names if t == "a"] == ["createdAt", "updatedAt", "id", "z"]
    assert ("a", "id", "Int") in names
    assert [n for t, n, _ in names if t == "b"] == ["id", "createdAt", "updatedAt", "z"]
    got = reg.subscription_rows(registry).collect()
    assert len([r for r in got if r["table_name"] == "a"]) == 9
    b = [r for r in got if r["table_name"] == "b"]
    assert sorted(r["event"] for r in b) == ["create", "delete", "update"] and b[0]["field"] is None
    assert {r["operator"] for r in got if r["field"] == "chatId"} == {"eq"}


def test_definition_checks(spark):
    bad = definitions(
        spark,
        ("none", "ok", [], None),
        ("dup", "ok", [field("a", "String"), field("a", "bad")], None),
        ("two", "ok", [field("a", "Int", True), field("b", "Int", True)], None),
        ("dup_primary", "ok", [field("a", "Int", True), field("a", "Int", True)], None),
        ("type", "ok", [field("a", "int"), field("b", None)], None),
        ("name", "ok", [field(None, "Int"), field("", "Int")], None),
        ("good", "ok", [field("a", "Int", True), field("b", "Array")], None),
    )
    got = sorted((r["tenant"], r["field"] or "", r["rule"]) for r in reg.definition_violations(bad).collect())
    assert got == [
        ("dup", "a", "duplicate"), ("dup_primary", "a", "duplicate"), ("name", "", "name"),
        ("name", "", "name"), ("none", "", "no_fields"), ("two", "", "primary"), ("type", "a", "type"),
        ("type", "b", "type"),
    ]
    keys = bad.select("tenant", reg.primary_key(F.col("fields")).alias("k")).collect()
    assert {r["tenant"]: r["k"] for r in keys}["type"] == "a"


@pytest.mark.parametrize(
    "name,rule",
    [(None, "non_empty"), ("", "non_empty"), ("ab", "length"), ("a" * 51, "length"), ("1ab", "format"),
     ("a-b", "format"), ("abc", None), ("a" * 50, None), ("A_1", None)],
)
def test_names(spark, name, rule):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(naming.name_rule(F.col("n")).alias("r")).first()["r"] == rule


def test_namespaces(spark):
    df = spark.createDataFrame([("key-1",), ("key-1",), ("key-2",)], "k string")
    got = df.select(naming.namespace(F.col("k")).alias("n"), naming.capitalize(F.col("k")).alias("c")).first()
    assert got["n"] == hashlib.sha256(b"key-1").hexdigest()[:8] and got["c"] == "Key-1"
    assert naming.namespace_collisions(df, "k").count() == 0
    assert naming.namespace_collisions(df, "k", digits=0).first()["n_keys"] == 2


def test_broken_declarations_stop_no_other(spark):
    good = '{"table_name":"notes","fields":[{"name":"a","type":"Int"}],"subscriptions":[{"filters":[{"field":"a","value":"1"}]}]}'
    texts = [
        ("t1", good), ("t1", good[:-4]), ("t1", None), ("t1", ""), ("t1", "null"), ("t1", "[1]"), ("t1", "7"),
        ("t2", good), ("t2", '{"fields":[{"name":"a"}]}'), ("t2", '{"table_name":"x","fields":[]}'),
        ("t2", good.replace('"a","value"', '"b","value"')), ("t2", good.replace('"value"', '"operator":"like","value"')),
        ("t2", '{"table_name":"x","fields":[{"name":"a"},{"name":"a"}]}'), (None, good), ("t3", good),
        ("t3", '{"table_name":"x","fields":[{"name":"a"}],"subscriptions":[{"filters":null},{}]}'),
    ]
    rows = spark.createDataFrame([(*t, i, "kept") for i, t in enumerate(texts)], "tenant string, body string, at int, reason string")
    declared = reg.declarations(rows, "body")
    found = {r["at"]: r["reason"] for r in declared.collect()}
    assert found == {
        0: None, 1: "unreadable", 2: "unreadable", 3: "unreadable", 4: "unreadable", 5: "unreadable", 6: "unreadable",
        7: None, 8: "missing", 9: "no_fields", 10: "filter", 11: "operator", 12: "duplicate", 13: "tenant",
        14: None, 15: None,
    }
    usable, aside = reg.set_aside(declared)
    assert {r["at"] for r in usable.collect()} == {0, 7, 14, 15} and aside.count() == 12
    usable, aside = reg.set_aside(declared, whole_tenant=True)
    assert {r["at"] for r in usable.collect()} == {14, 15}
    assert {r["at"] for r in aside.filter("reason = 'tenant_broken'").collect()} == {0, 7}
    assert reg.subscription_rows(usable).count() == 9


def test_untyped_records_show_their_fields(spark):
    def fields(texts, **options):
        df = spark.createDataFrame([(t,) for t in texts], "r string")
        rows = schemas.infer_fields_untyped(df, "r", **options).collect()
        own = {r["name"]: (r["type"], r["required"]) for r in rows if r["name"] not in ("createdAt", "updatedAt")}
        assert len(rows) == len(own) + 2
        return own

    assert fields([]) == {"id": ("String", True)}
    found = fields(['{"id": 1, "a": 1, "b": 1.5, "c": 1}', '{"id": "x", "a": 2, "b": 1, "c": "1", "d": null, "e": {"f": 1}}'])
    assert found == {
        "id": ("String", True), "a": ("Int", True), "b": ("Float", True), "c": ("String", True),
        "d": ("String", False), "e": ("String", False),
    }
    assert fields(['{"a": true}', None]) == {"id": ("String", True), "a": ("Boolean", False)}
    assert fields(['{"a": [1]}', "{broken"]) == {"id": ("String", True), "a": ("Array", False)}
    assert fields(['{"a": 99999999999999999999}', "[1]"]) == {"id": ("String", True), "a": ("Float", False)}


def test_declarations_are_parsed_once_and_by_all_tasks(spark, data):
    rows = spark.createDataFrame([("t", "{}"), ("t", None)], "tenant string, body string")
    usable, aside = reg.set_aside(reg.declarations(rows, "body"))
    for found in (usable.select("tenant", "fields", "subscriptions"), aside.select("tenant", "reason")):
        assert found._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert workload.subscription_quarantine(spark, data).rdd.getNumPartitions() == tasks
