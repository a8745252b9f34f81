"""Validation, inference and coercion queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from keyfold.functions import coerce, rules
from keyfold.model import Field, table_spec
from keyfold.operators import schemas
from keyfold.sources.log import EVENT_LOG, events_as_log
from keyfold.sources.tables import table
from keyfold.workload.common import LOG
from keyfold.workload.writes import PARTS, _part_records

STR, DBL, INT = T.StringType(), T.DoubleType(), T.LongType()


def violations_required(s, d):
    """Documents without a quality or toxicity label."""
    fields = [
        Field("text", "String", True, dtype=STR),
        Field("quality", "Int", True, dtype=T.IntegerType()),
        Field("toxic", "Int", True, dtype=T.IntegerType()),
    ]
    labelled = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return rules.violations(labelled, ["doc_id"], rules.required(fields))


def violations_type(s, d):
    """Events as untyped JSON records against a definition that does not fit them."""
    fields = [
        Field("event_id", "String"),
        Field("user_id", "integer"),
        Field("value", "Int"),
        Field("props", "list"),
        Field("event_type", "unknown"),
    ]
    raw = table(s, d, "events").select(
        F.col("event_id").alias("key"),
        F.parse_json(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))).alias(
            "record"
        ),
    )
    checked, type_rules = rules.json_typed(raw, "record", fields)
    return rules.violations(checked, ["key"], type_rules)


def violations_nan(s, d):
    """Int fields held as fractions, and NaN."""
    fields = [Field("l_quantity", "Int", dtype=DBL), Field("l_discount", "Int", dtype=DBL)]
    found = rules.violations(
        table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], rules.typed(fields)
    )
    return found.drop("value")


def validate_partial(s, d):
    """Updates of the log, only the fields they carry."""
    log = events_as_log(table(s, d, "events")).filter(F.col("op") == "update")
    updates = log.select(
        "seq",
        F.col("props").alias("phone"),
        (F.col("value") - 100).alias("price"),
        F.col("present_props").alias("has_phone"),
        F.col("present_value").alias("has_price"),
    )
    fields = [Field("phone", "String", True, dtype=STR), Field("price", "Float", True, dtype=DBL)]
    present = {"phone": F.col("has_phone"), "price": F.col("has_price")}
    return schemas.check(updates, ["seq"], fields, partial=True, present=present)


def violations(s, d):
    return schemas.check(_part_records(s, d), ["part_id"], PARTS).drop("value")


def violations_url(s, d):
    """URLs, a third-party link that lost its scheme, and an address that is none."""
    pages = table(s, d, "pages").select(
        "page_id",
        "url",
        F.regexp_replace("url", "^http://", "").alias("link_url"),
        F.regexp_replace("url", "^https://", "x@").alias("contact_email"),
    )
    fields = [Field(n, "String", True, dtype=STR) for n in ("url", "link_url", "contact_email")]
    return schemas.check(pages, ["page_id"], fields)


def infer_fields(s, d):
    """Field list of labelled documents; fields some records lack are optional."""
    joined = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return schemas.infer_fields(joined, indexed=["lang", "source"])


def fields_to_schema(s, d):
    """Records as JSON text, read through the definition."""
    raw = table(s, d, "documents").select(
        F.to_json(
            F.struct(
                F.col("doc_id").cast("string").alias("id"), "text", "lang", "n_chars", F.lit(1).alias("extra")
            )
        ).alias("j")
    )
    spec = table_spec(
        "documents",
        [
            {"name": "text", "required": True},
            {"name": "lang", "type": "String", "indexed": True},
            {"name": "n_chars", "type": "Int"},
        ],
    )
    return schemas.parse_records(raw, "j", spec)


def sanitize(s, d):
    fields = [
        Field("o_orderkey", "Int"),
        Field("o_custkey", "Boolean"),
        Field("o_totalprice", "Int"),
        Field("o_orderpriority", "Int"),
        Field("o_orderstatus", "Array"),
    ]
    at = F.lit("2024-01-01T00:00:00.000Z")
    clean = coerce.sanitize(table(s, d, "orders"), fields, now=at)
    return clean.withColumn("o_orderstatus", F.concat_ws("|", "o_orderstatus"))


def sanitize_unreadable(s, d):
    """Texts an Int field cannot take, over whole texts."""
    return coerce.unreadable(table(s, d, "documents"), ["doc_id"], [Field("text", "Int")])


def _untyped(s, d):
    """Every event as JSON text whose fields differ from record to record."""
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    inner = F.expr("substr(props, 2, length(props) - 2)")
    odd = F.col("event_id") % 2 == 1
    text = F.concat(
        F.lit("{"),
        inner,
        F.lit(', "kind": '), quoted,
        F.lit(', "mixed": '), F.when(odd, F.col("event_id").cast("string")).otherwise(quoted),
        F.lit(', "amount": '), F.when(odd, F.lit("2")).otherwise(F.lit("2.5")),
        F.lit(', "none": null, "flag": '), F.when(odd, F.lit("true")).otherwise(F.lit("null")),
        F.when(F.col("event_type") == "view", F.lit(', "tags": ["a", 1], "nested": {"x": 1}')).otherwise(F.lit("")),
        F.lit("}"),
    )
    return table(s, d, "events").select(text.alias("record"))


def infer_fields_untyped(s, d):
    return schemas.infer_fields_untyped(_untyped(s, d), "record", indexed=["kind", "id"])


QUERIES = {
    f.__name__: f
    for f in (
        violations_required, violations_type, violations_nan, validate_partial, violations,
        violations_url, infer_fields, infer_fields_untyped, fields_to_schema, sanitize, sanitize_unreadable,
    )
}

ORACLES = {
    "violations_required": """
    with j as (select d.doc_id, quality, toxic from documents d left join labels l using (doc_id))
    select doc_id, 'quality' as field, 'required' as rule, cast(quality as varchar) as value
    from j where quality is null
    union all
    select doc_id, 'toxic', 'required', cast(toxic as varchar) from j where toxic is null
    union all
    select doc_id, 'text', 'required', text from documents where text is null or text = ''""",
    "violations_type": """
    select event_id as key, 'event_id' as field, 'type' as rule, cast(event_id as varchar) as value
    from events
    union all select event_id, 'value', 'type', cast(value as varchar) from events
      where value <> floor(value)
    union all select event_id, 'props', 'type', props from events""",
    "violations_nan": """
    select l_orderkey, l_linenumber, 'l_quantity' as field, 'type' as rule from lineitem
      where isnan(l_quantity) or l_quantity <> floor(l_quantity)
    union all
    select l_orderkey, l_linenumber, 'l_discount', 'type' from lineitem
      where isnan(l_discount) or l_discount <> floor(l_discount)""",
    "validate_partial": LOG
    + """
    select seq, 'phone' as field, 'min_len' as rule, props as value from l
      where op = 'update' and sp and length(props) < 10
    union all
    select seq, 'price', 'non_negative', cast(value - 100 as varchar) from l
      where op = 'update' and sv and value - 100 < 0""",
    "violations": """
    select p_partkey as part_id, 'phone' as field, 'min_len' as rule from part where length(p_name) < 10
    union all
    select p_partkey, 'age', 'range' from part where p_size not between 0 and 150
    union all
    select p_partkey, 'price', 'non_negative' from part where p_retailprice - 950 < 0""",
    "violations_url": r"""
    with p as (select page_id, url, regexp_replace(url, '^http://', '') link_url,
                      regexp_replace(url, '^https://', 'x@') contact_email from pages)
    select page_id, 'url' as field, 'url' as rule, url as value from p
      where not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^ ]+')
    union all
    select page_id, 'link_url', 'url', link_url from p
      where not regexp_matches(link_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^ ]+')
    union all
    select page_id, 'contact_email', 'email', contact_email from p
      where not regexp_matches(contact_email, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$')""",
    "infer_fields_untyped": """
    with r as (select '{' || substr(props, 2, length(props) - 2) || ', "kind": "' || event_type || '", "mixed": '
          || case when event_id % 2 = 1 then cast(event_id as varchar) else '"' || event_type || '"' end
          || ', "amount": ' || case when event_id % 2 = 1 then '2' else '2.5' end || ', "none": null, "flag": '
          || case when event_id % 2 = 1 then 'true' else 'null' end
          || case when event_type = 'view' then ', "tags": ["a", 1], "nested": {"x": 1}' else '' end || '}' as j
        from events),
    k as (select unnest(json_keys(j)) as name, j from r),
    t as (select name, json_type(j, '$.' || name) as t from k),
    m as (select name, count(*) filter (where t <> 'NULL') as n,
                 count(*) filter (where t in ('UBIGINT', 'BIGINT')) as i, count(*) filter (where t = 'DOUBLE') as f,
                 count(*) filter (where t = 'BOOLEAN') as b, count(*) filter (where t = 'ARRAY') as a
          from t group by name)
    select name, case when n = 0 then 'String' when i = n then 'Int' when i + f = n then 'Float'
                      when b = n then 'Boolean' when a = n then 'Array' else 'String' end as type,
           n = (select count(*) from events) as required, name = 'kind' as indexed, false as "primary" from m
    union all select 'id', 'String', true, false, true
    union all select 'createdAt', 'String', true, false, false
    union all select 'updatedAt', 'String', true, false, false""",
    "infer_fields": """
    with j as (select d.*, quality, toxic from documents d left join labels l using (doc_id)),
    c as (select count(*) n, count(doc_id) doc_id, count(text) t, count(lang) lang, count(source) source,
                 count(n_chars) n_chars, count(quality) quality, count(toxic) toxic from j)
    select 'id' as name, 'String' as type, true as required, false as indexed, true as primary from c
    union all select 'doc_id', 'Int', doc_id = n, false, false from c
    union all select 'text', 'String', t = n, false, false from c
    union all select 'lang', 'String', lang = n, true, false from c
    union all select 'source', 'String', source = n, true, false from c
    union all select 'n_chars', 'Int', n_chars = n, false, false from c
    union all select 'quality', 'Int', quality = n, false, false from c
    union all select 'toxic', 'Int', toxic = n, false, false from c
    union all select 'createdAt', 'String', true, false, false from c
    union all select 'updatedAt', 'String', true, false, false from c""",
    "fields_to_schema": """
    select cast(doc_id as varchar) as id, text, lang, n_chars, cast(null as varchar) as "createdAt",
           cast(null as varchar) as "updatedAt" from documents""",
    "sanitize": r"""
    select o_orderkey, o_custkey <> 0 as o_custkey, o_orderstatus,
           cast(floor(o_totalprice) as bigint) as o_totalprice,
           cast(o_orderdate as varchar) as o_orderdate,
           try_cast(nullif(regexp_extract(o_orderpriority, '^\s*([+-]?[0-9]+)', 1), '') as bigint)
             as o_orderpriority,
           '2024-01-01T00:00:00.000Z' as "createdAt", '2024-01-01T00:00:00.000Z' as "updatedAt"
    from orders""",
    "sanitize_unreadable": r"""
    select doc_id, 'text' as field, 'unreadable' as rule, text as value from documents
    where try_cast(nullif(regexp_extract(text, '^\s*([+-]?[0-9]+)', 1), '') as bigint) is null""",
}
