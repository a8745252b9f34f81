"""Registry queries. Every part is read as a table definition of its brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.functions.naming import namespace, namespace_collisions as collisions, type_name
from keyfold.model import FILTER_STRUCT, SUBSCRIPTION_STRUCT
from keyfold.operators import registry as reg
from keyfold.sources.tables import table
from pyspark.sql import types as T

AT = "2024-01-01 00:00:00"
LATER = "2024-02-01 00:00:00"


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


def _field(name, kind=None, required=None, indexed=None, primary=None):
    def flag(v):
        return v if v is not None else F.lit(None).cast("boolean")

    return F.struct(
        name.alias("name"),
        (F.lit(None).cast("string") if kind is None else kind).alias("type"),
        flag(required).alias("required"),
        flag(indexed).alias("indexed"),
        flag(primary).alias("primary"),
    )


def _definitions(s, d):
    parts = table(s, d, "part")
    kind = F.when(F.col("p_size") >= 25, "Int").otherwise("Float")
    fields = F.array_compact(
        F.array(
            _field(F.lit("label"), required=F.lit(True)),
            _field(F.lower("p_type"), kind, indexed=F.lit(True)),
            F.when(F.col("p_retailprice") >= 950, _field(F.lit("createdAt"), F.lit("String"))),
        )
    )
    one = F.struct(
        F.lower("p_type").alias("field"),
        kind.alias("type"),
        F.lit("gt").alias("operator"),
        F.col("p_size").cast("string").alias("value"),
    ).cast(FILTER_STRUCT)
    subscriptions = F.when(
        F.col("p_size") < 10, F.array(F.struct(F.array(one).alias("filters")))
    ).cast(T.ArrayType(SUBSCRIPTION_STRUCT))
    return parts.select(
        namespace(F.col("p_brand")).alias("tenant"),
        F.regexp_replace("p_name", " ", "_").alias("table_name"),
        fields.alias("fields"),
        subscriptions.alias("subscriptions"),
        F.col("p_brand").alias("description"),
        F.col("p_partkey").alias("ordinal"),
        "p_type",
    )


def _empty(definitions):
    return reg.items(definitions.filter(F.lit(False)), _at(AT), F.lit(""))


def _registered(s, d, definitions=None):
    """The registry after registering all (or the given) definitions at once."""
    definitions = _definitions(s, d) if definitions is None else definitions
    empty = _empty(definitions)
    statuses = reg.register(empty, definitions)
    return reg.registered(empty, definitions, statuses, _at(AT), table_id=F.col("ordinal").cast("string"))


def _two(s, d):
    definitions = _definitions(s, d)
    old = _registered(s, d, definitions.filter(F.col("p_type") == "ECONOMY"))
    return old, definitions.filter(F.col("p_type") != "ECONOMY")


def register_tables(s, d):
    return reg.register(*_two(s, d))


def register_idempotent(s, d):
    return reg.register(*_two(s, d), idempotent=True)


def register_fail_fast(s, d):
    """The same batch with the definitions of one brand left empty: all are refused."""
    old, batch = _two(s, d)
    none = F.filter("fields", lambda f: F.lit(False))
    batch = batch.withColumn("fields", F.when(F.col("description") == "Brand#7", none).otherwise(F.col("fields")))
    return reg.register(old, batch, fail_fast=True)


def register_summary(s, d):
    return reg.batch_summary(reg.register(*_two(s, d)))


def registered_tables(s, d):
    return _registered(s, d).select("tenant", "table_name", "table_id", "type_name", "created_at")


def list_tables(s, d):
    tenant = table(s, d, "part").filter(F.col("p_brand") == "Brand#1").select(
        namespace(F.col("p_brand")).alias("tenant")
    )
    name = tenant.first()["tenant"]
    return reg.list_tables(_registered(s, d), name).select(
        "table_name", "type_name", F.size("fields").alias("n_fields")
    )


def table_counts(s, d):
    return reg.table_counts(_registered(s, d))


def table_schema(s, d):
    return reg.table_schema(_registered(s, d))


def _renames(s, d):
    """Per table the last PROMO definition as an update of fields and description."""
    promo = _definitions(s, d).filter(F.col("p_type") == "PROMO")
    return promo.groupBy(*reg.KEY).agg(
        F.max_by("fields", "ordinal").alias("fields"),
        F.lit(None).cast(T.ArrayType(SUBSCRIPTION_STRUCT)).alias("subscriptions"),
        F.concat(F.lit("promo "), F.max("ordinal").cast("string")).alias("description"),
    )


def _without_promo(s, d):
    return _registered(s, d, _definitions(s, d).filter(F.col("p_type") != "PROMO"))


def evolve_schema(s, d):
    changed, _ = reg.evolve(_without_promo(s, d), _renames(s, d), _at(LATER))
    return changed.select(
        *reg.KEY,
        F.size("fields").alias("n_fields"),
        F.get("fields", F.lit(1))["name"].alias("second_field"),
        F.size("subscriptions").alias("n_subscriptions"),
        "description",
        "created_at",
        "updated_at",
    )


def evolve_rejected(s, d):
    _, rejected = reg.evolve(_without_promo(s, d), _renames(s, d), _at(LATER))
    return rejected.select(*reg.KEY, "description")


def retire_tables(s, d):
    promo = _definitions(s, d).filter(F.col("p_type") == "PROMO").select(*reg.KEY)
    return reg.retire(_registered(s, d), promo).select(*reg.KEY, "description")


def retire_tenants(s, d):
    """Whole tenants: the brands that have a part of more than 49 units."""
    doomed = table(s, d, "part").filter(F.col("p_size") > 49).select(
        namespace(F.col("p_brand")).alias("tenant")
    )
    return reg.retire(_registered(s, d), doomed).select(*reg.KEY, "description")


def subscription_rows(s, d):
    return reg.subscription_rows(_registered(s, d))


def _watched(s, d):
    """Every table with an ECONOMY definition gets one new subscription, by its brand."""
    text = F.lit(None).cast("string")
    one = F.struct(
        F.lit("label").alias("field"), text.alias("type"), F.lit("contains").alias("operator"),
        F.col("brand").alias("value"),
    ).cast(FILTER_STRUCT)
    economy = _definitions(s, d).filter(F.col("p_type") == "ECONOMY")
    named = economy.groupBy(*reg.KEY).agg(F.max("description").alias("brand"))
    return named.select(
        *reg.KEY,
        F.lit(None).cast(reg.SCHEMA["fields"].dataType).alias("fields"),
        F.array(F.struct(F.array(one).alias("filters"))).cast(T.ArrayType(SUBSCRIPTION_STRUCT)).alias("subscriptions"),
        text.alias("description"),
    )


def subscription_rows_after(s, d):
    """Subscription rows kept up to date through a registration, an evolution and a retirement."""
    before = _without_promo(s, d)
    rows = reg.subscription_rows(before)
    batch = _definitions(s, d).filter(F.col("p_type") == "PROMO")
    statuses = reg.register(before, batch)
    rows = reg.maintained_subscriptions(rows, reg.registered_changes(batch, statuses))
    now = reg.registered(before, batch, statuses, _at(LATER), table_id=F.col("ordinal").cast("string"))
    updates = _watched(s, d)
    rows = reg.maintained_subscriptions(rows, reg.evolved_changes(now, updates))
    doomed = _definitions(s, d).filter(F.col("p_type") == "STANDARD").select(*reg.KEY)
    return reg.maintained_subscriptions(rows, reg.retired_changes(now, doomed))


def _texts(s, d):
    """The definitions as JSON text, broken in some way for most sizes below 9.

    They are dealt over all tasks: the table is one small file, and reading JSON is the work, not the file's size.
    """
    size = F.col("p_size")
    definitions = _definitions(s, d).join(
        table(s, d, "part").select(F.col("p_partkey").alias("ordinal"), size), "ordinal"
    )
    whole = F.to_json(F.struct("table_name", "fields", "subscriptions", "description"))
    name, kind = F.get_json_object(whole, "$.table_name"), F.get_json_object(whole, "$.fields[1].type")
    text = (
        F.when(size == 1, F.substr(whole, F.lit(1), F.length(whole) - 3))
        .when(size == 2, F.replace(whole, F.lit('"table_name"'), F.lit('"title"')))
        .when(size == 3, F.concat(F.lit('{"table_name":"'), name, F.lit('","fields":[]}')))
        .when(size == 4, F.concat(F.lit('{"table_name":"'), name, F.lit('","fields":"none"}')))
        .when(size == 5, F.replace(whole, F.lit('"operator":"gt"'), F.lit('"operator":"near"')))
        .when(size == 6, F.replace(whole, F.lit('"filters":[{"field":"'), F.lit('"filters":[{"field":"no_')))
        .when(size == 7, F.replace(whole, F.concat(F.lit('"type":"'), kind, F.lit('","indexed"')), F.lit('"type":"Money","indexed"')))
        .when(size == 8, F.lit(None))
        .otherwise(whole)
    )
    tasks = int(s.conf.get("spark.sql.shuffle.partitions"))
    return definitions.select("tenant", "ordinal", text.alias("text")).repartition(tasks)


def subscription_quarantine(s, d):
    _, aside = reg.set_aside(reg.declarations(_texts(s, d)))
    return aside.select("tenant", "ordinal", "reason")


def subscription_rows_declared(s, d):
    """Subscription rows of the declarations that can be used; the broken ones stop no other."""
    usable, _ = reg.set_aside(reg.declarations(_texts(s, d)))
    return reg.subscription_rows(usable.select(*reg.KEY, "subscriptions"))


def namespace_rows(s, d):
    names = table(s, d, "customer").select(
        "c_name", namespace(F.col("c_name")).alias("ns"), F.lower("c_mktsegment").alias("t")
    )
    return names.select("c_name", "ns", type_name(F.col("ns"), F.col("t")).alias("type_name"))


def namespace_collisions(s, d):
    """Shortened to four digits, so that collisions are sure to show."""
    return collisions(table(s, d, "customer"), "c_name", digits=4)


def _odd_definitions(s, d):
    """Definitions with repeated names, several primaries and unknown types."""
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    third = F.when(F.col("p_retailprice") > 950, first).otherwise(F.lower("p_type"))
    kind = F.when(F.col("p_size") > 10, "Int").otherwise("number")
    no, short = F.lit(False), F.when(F.col("p_size") < 5, F.substring("p_name", 1, 2))
    return table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("tenant"),
        F.coalesce(short, F.when(F.col("p_size") < 30, F.regexp_replace("p_name", " ", "_")), "p_name").alias(
            "table_name"
        ),
        F.when(
            F.col("p_size") == 50,
            F.array().cast("array<struct<name:string,type:string,required:boolean,indexed:boolean,primary:boolean>>"),
        )
        .otherwise(
            F.array(
                _field(first, F.lit("String"), no, no, F.col("p_size") >= 25),
                _field(second, kind, no, no, F.col("p_size") >= 40),
                _field(third, F.lit("Float"), no, no, F.lit(True)),
            )
        )
        .alias("fields"),
    )


def violations_definitions(s, d):
    return reg.definition_violations(_odd_definitions(s, d))


def violations_names(s, d):
    return reg.name_violations(_odd_definitions(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        register_tables, register_idempotent, register_fail_fast, register_summary, registered_tables, list_tables,
        table_counts, table_schema, evolve_schema, evolve_rejected, retire_tables, retire_tenants,
        subscription_rows, subscription_rows_after, subscription_quarantine, subscription_rows_declared,
        namespace_collisions, violations_definitions, violations_names,
    )
}
QUERIES["namespace"] = namespace_rows

_DEFS = """
    with d as (select substr(sha256(p_brand), 1, 8) tenant, replace(p_name, ' ', '_') table_name,
                      p_partkey ordinal, p_type, p_brand, p_size, p_retailprice,
                      case when p_size >= 25 then 'Int' else 'Float' end kind from part)"""
_TWO = (
    _DEFS
    + """,
    r as (select distinct tenant, table_name from d where p_type = 'ECONOMY'),
    b as (select *, row_number() over (partition by tenant, table_name order by ordinal) rn
          from d where p_type <> 'ECONOMY'),
    st as (select b.*, rn = 1 and r.tenant is null ok from b left join r using (tenant, table_name))"""
)
_REG = (
    _DEFS
    + """,
    g as (select * from (select *, row_number() over (partition by tenant, table_name order by ordinal) rn
                         from d) where rn = 1)"""
)
_NO_PROMO = (
    _DEFS
    + """,
    g as (select * from (select *, row_number() over (partition by tenant, table_name order by ordinal) rn
                         from d where p_type <> 'PROMO') where rn = 1),
    u as (select tenant, table_name, max(ordinal) o, arg_max(p_retailprice, ordinal) price
          from d where p_type = 'PROMO' group by 1, 2)"""
)
_ODD = """
    with o as (select p_partkey, cast(p_partkey as varchar) tenant, p_size,
        case when p_size < 5 then substr(p_name, 1, 2) when p_size < 30 then replace(p_name, ' ', '_')
             else p_name end table_name,
        split_part(p_name, ' ', 1) f1, split_part(p_name, ' ', 2) f2,
        case when p_retailprice > 950 then split_part(p_name, ' ', 1) else lower(p_type) end f3 from part),
    x as (select *, f2 = f1 dup2, f3 = f1 or f3 = f2 dup3 from o)"""

ORACLES = {
    "register_tables": _TWO
    + """ select tenant, table_name, ordinal, case when ok then 'created' else 'failed' end as status,
                 case when not ok then 'exists' end as error from st""",
    "register_idempotent": _TWO
    + """ select tenant, table_name, ordinal, case when ok then 'created' else 'exists' end as status,
                 cast(null as varchar) as error from st""",
    "register_fail_fast": _DEFS
    + """ select tenant, table_name, ordinal, 'failed' as status,
                 case when p_brand = 'Brand#7' then 'no_fields' else 'batch_refused' end as error
          from d where p_type <> 'ECONOMY'""",
    "register_summary": _TWO
    + """ select tenant, count(*) filter (where ok) as created, count(*) filter (where not ok) as failed
          from st group by tenant""",
    "registered_tables": _REG
    + f""" select tenant, table_name, cast(ordinal as varchar) as table_id,
                  'T' || tenant || '_' || table_name as type_name, timestamp '{AT}' as created_at from g""",
    "list_tables": _REG
    + """ select table_name, 'T' || tenant || '_' || table_name as type_name,
                 cast(case when p_retailprice >= 950 then 3 else 2 end as integer) as n_fields
          from g where p_brand = 'Brand#1'""",
    "table_counts": _REG + " select tenant, count(*) as n_tables from g group by tenant",
    "table_schema": _REG
    + """
    select tenant, table_name, 'id' as name, 'String' as type, true as required, false as indexed,
           true as primary from g
    union all select tenant, table_name, 'createdAt', 'String', true, false, false from g
      where p_retailprice < 950
    union all select tenant, table_name, 'updatedAt', 'String', true, false, false from g
    union all select tenant, table_name, 'label', 'String', true, false, false from g
    union all select tenant, table_name, lower(p_type), kind, false, true, false from g
    union all select tenant, table_name, 'createdAt', 'String', false, false, false from g
      where p_retailprice >= 950""",
    "evolve_schema": _NO_PROMO
    + f"""
    select tenant, table_name,
           cast(case when coalesce(price, p_retailprice) >= 950 then 3 else 2 end as integer) as n_fields,
           case when u.o is not null then 'promo' else lower(p_type) end as second_field,
           cast(case when p_size < 10 then 1 else 0 end as integer) as n_subscriptions,
           case when u.o is not null then 'promo ' || u.o else p_brand end as description,
           timestamp '{AT}' as created_at,
           case when u.o is not null then timestamp '{LATER}' else timestamp '{AT}' end as updated_at
    from g left join u using (tenant, table_name)""",
    "evolve_rejected": _NO_PROMO
    + """ select tenant, table_name, 'promo ' || o as description from u
          where (tenant, table_name) not in (select tenant, table_name from g)""",
    "retire_tables": _REG
    + """ select tenant, table_name, p_brand as description from g
          where (tenant, table_name) not in (select tenant, table_name from d where p_type = 'PROMO')""",
    "retire_tenants": _REG
    + """ select tenant, table_name, p_brand as description from g
          where p_brand not in (select p_brand from part where p_size > 49)""",
    "subscription_rows": _REG
    + """,
    ev as (select unnest(['create', 'update', 'delete']) as event)
    select tenant, table_name, event, case when p_size < 10 then lower(p_type) end as field,
           case when p_size < 10 then kind end as type, case when p_size < 10 then 'gt' end as operator,
           case when p_size < 10 then cast(p_size as varchar) end as value
    from g cross join ev""",
    "subscription_rows_after": _DEFS
    + """,
    old as (select *, row_number() over (partition by tenant, table_name order by (p_type = 'PROMO'), ordinal) rn from d),
    e as (select tenant, table_name, max(p_brand) brand from d where p_type = 'ECONOMY' group by 1, 2),
    g as (select old.*, brand from old left join e using (tenant, table_name)
          where rn = 1 and (tenant, table_name) not in (select tenant, table_name from d where p_type = 'STANDARD')),
    ev as (select unnest(['create', 'update', 'delete']) as event)
    select tenant, table_name, event,
           case when brand is not null then 'label' when p_size < 10 then lower(p_type) end as field,
           case when brand is null and p_size < 10 then kind end as type,
           case when brand is not null then 'contains' when p_size < 10 then 'gt' end as operator,
           case when brand is not null then brand when p_size < 10 then cast(p_size as varchar) end as value
    from g cross join ev""",
    "subscription_quarantine": _DEFS
    + """
    select tenant, ordinal, case when p_size in (1, 4, 8) then 'unreadable' when p_size = 2 then 'missing'
        when p_size = 3 then 'no_fields' when p_size = 5 then 'operator' when p_size = 6 then 'filter'
        else 'type' end as reason
    from d where p_size < 9""",
    "subscription_rows_declared": _DEFS
    + """,
    ev as (select unnest(['create', 'update', 'delete']) as event)
    select tenant, table_name, event, case when p_size < 10 then lower(p_type) end as field,
           case when p_size < 10 then kind end as type, case when p_size < 10 then 'gt' end as operator,
           case when p_size < 10 then cast(p_size as varchar) end as value
    from d cross join ev where p_size >= 9""",
    "namespace": """
    select c_name, substr(sha256(c_name), 1, 8) as ns,
           'T' || substr(sha256(c_name), 1, 8) || '_' || lower(c_mktsegment) as type_name from customer""",
    "namespace_collisions": """
    select substr(sha256(c_name), 1, 4) as namespace, count(distinct c_name) as n_keys from customer
    group by 1 having count(distinct c_name) > 1""",
    "violations_definitions": _ODD
    + """
    select tenant, table_name, cast(null as varchar) as field, 'no_fields' as rule from x where p_size = 50
    union all select tenant, table_name, f2, 'duplicate' from x where p_size < 50 and dup2
    union all select tenant, table_name, f2, 'type' from x where p_size <= 10 and not dup2
    union all select tenant, table_name, f3, 'duplicate' from x where p_size < 50 and dup3
    union all select tenant, table_name, null, 'primary' from x
      where p_size < 50 and cast(p_size >= 25 as int) + cast(p_size >= 40 and not dup2 as int)
                            + cast(not dup3 as int) > 1""",
    "violations_names": _ODD
    + r"""
    select tenant, table_name, case when length(table_name) not between 3 and 50 then 'length'
                                    else 'format' end as rule
    from x where length(table_name) not between 3 and 50
              or not regexp_matches(table_name, '^[a-zA-Z][a-zA-Z0-9_]*$')""",
}
