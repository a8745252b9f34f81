"""Fields, table definitions and their mapping to Spark types."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field as dc_field, replace

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
STRING, INT, FLOAT, BOOLEAN, ARRAY = "String", "Int", "Float", "Boolean", "Array"
LOGICAL_TYPES = (STRING, INT, FLOAT, BOOLEAN, ARRAY)
TYPE_ALIASES = {
    "string": STRING,
    "int": INT,
    "integer": INT,
    "number": INT,
    "float": FLOAT,
    "double": FLOAT,
    "boolean": BOOLEAN,
    "bool": BOOLEAN,
    "array": ARRAY,
    "list": ARRAY,
}
SYSTEM_FIELDS = ("id", "createdAt", "updatedAt")
OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "contains")
EVENTS = ("create", "update", "delete")
DEFAULT_PAGE, MAX_PAGE = 50, 100
# -----------------------------------------------------------------------------

SPARK_TYPES: dict[str, T.DataType] = {
    STRING: T.StringType(),
    INT: T.LongType(),
    FLOAT: T.DoubleType(),
    BOOLEAN: T.BooleanType(),
    ARRAY: T.ArrayType(T.StringType()),
}

FIELD_STRUCT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("indexed", T.BooleanType()),
        T.StructField("primary", T.BooleanType()),
    ]
)
FILTER_STRUCT = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
SUBSCRIPTION_STRUCT = T.StructType([T.StructField("filters", T.ArrayType(FILTER_STRUCT))])


def logical_type(name: str | None) -> str:
    """Logical type of a declared name; unknown or missing names are strings."""
    return TYPE_ALIASES.get((name or "").lower(), STRING)


def spark_type(name: str | None) -> T.DataType:
    return SPARK_TYPES[logical_type(name)]


def logical_of(dtype: T.DataType) -> str:
    """Logical type a Spark column is declared as; dates and the like are strings."""
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.IntegralType):
        return INT
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, T.ArrayType):
        return ARRAY
    return STRING


@dataclass(frozen=True)
class Field:
    name: str
    type: str = STRING
    required: bool = False
    indexed: bool = False
    primary: bool = False
    dtype: T.DataType | None = dc_field(default=None, compare=False)

    @property
    def spark_type(self) -> T.DataType:
        return self.dtype or spark_type(self.type)

    def as_row(self) -> tuple:
        return (self.name, self.type, self.required, self.indexed, self.primary)

    @classmethod
    def of(cls, value: "Field | Mapping") -> "Field":
        """Field from a definition mapping; left-out attributes take their defaults."""
        if isinstance(value, Field):
            return value
        return cls(
            value["name"],
            value.get("type") or STRING,
            bool(value.get("required")),
            bool(value.get("indexed")),
            bool(value.get("primary")),
        )


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[Field, ...]
    description: str = ""

    @property
    def key(self) -> str:
        """The field flagged primary, else the first one."""
        return next((f.name for f in self.fields if f.primary), self.fields[0].name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def indexed(self) -> list[str]:
        return [f.name for f in self.fields if f.indexed and not f.primary]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def schema(self) -> T.StructType:
        """StructType for reads; the declaration travels in the field metadata."""
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    f.spark_type,
                    True,
                    {
                        "logical_type": logical_type(f.type),
                        "required": f.required,
                        "indexed": f.indexed,
                        "primary": f.primary,
                    },
                )
                for f in self.fields
            ]
        )


def fields_of(
    schema: T.StructType, indexed: Iterable[str] = (), optional: Iterable[str] = ()
) -> list[Field]:
    """Declared fields of a Spark schema; nullable=False or not named optional is required."""
    indexed, optional = set(indexed), set(optional)
    unknown = indexed - set(schema.names)
    if unknown:
        # not fatal by design: an unknown index name is only reported
        print(f"indexed fields not in the schema: {sorted(unknown)}")
    return [
        Field(f.name, logical_of(f.dataType), f.name not in optional, f.name in indexed, False, f.dataType)
        for f in schema.fields
    ]


def table_spec(name: str, fields: Sequence[Field | Mapping], description: str = "") -> TableSpec:
    """Full table definition: a String primary ``id`` first and both timestamps last."""
    declared = [Field.of(f) for f in fields]
    ids = [f for f in declared if f.name == "id"]
    if ids:
        declared = [
            replace(f, type=STRING, primary=True, indexed=False, dtype=None) if f.name == "id" else f
            for f in declared
        ]
    else:
        declared.insert(0, Field("id", STRING, True, False, True))
    present = {f.name for f in declared}
    declared += [Field(n, STRING, True) for n in ("createdAt", "updatedAt") if n not in present]
    return TableSpec(name, tuple(declared), description)
