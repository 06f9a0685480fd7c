"""Entity models: what a table's columns mean to the planner."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of attribute types and the Spark types they are stored as.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "enum": T.StringType(), "uuid": T.StringType(), "json": T.StringType(), "reference": T.StringType(),
    "number": T.LongType(), "integer": T.LongType(), "int": T.LongType(), "long": T.LongType(),
    "decimal": T.DoubleType(), "double": T.DoubleType(), "float": T.DoubleType(),
    "epoch": T.TimestampType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType()), "bytes": T.BinaryType(), "vector": T.ArrayType(T.FloatType()),
}


class ModelError(ValueError):
    pass


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "string"
    required: bool = False
    options: tuple[str, ...] = ()
    open: bool = False
    pattern: str | None = None
    ref: str | None = None
    sensitive: bool = False
    fts: bool = False
    dimension: bool = False
    metric: bool = False
    label: str | None = None
    option_labels: dict[str, str] = field(default_factory=dict, hash=False)
    default: Any = None
    history: bool = True
    many: bool = False

    def __post_init__(self):
        if self.type not in TYPES:
            raise ModelError(f"unknown attribute type {self.type!r}")

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(T.StringType()) if self.type == "reference" and self.many else TYPES[self.type]


@dataclass(frozen=True)
class EntityModel:
    name: str
    attributes: tuple[Attribute, ...]
    key: str = "id"
    time: str | None = None
    tenant: str | None = None
    owner: str | None = None
    assignees: str | None = None
    location: str | None = None
    constraints: tuple[dict, ...] = ()
    table: str | None = None

    def __getitem__(self, name: str) -> Attribute:
        for a in self.attributes:
            if a.name == name:
                return a
        raise ModelError(f"{self.name} has no attribute {name!r}")

    def schema(self) -> T.StructType:
        """Column flags go along as field metadata."""
        return T.StructType([T.StructField(a.name, a.spark_type, not a.required, {"type": a.type, **({"ref": a.ref} if a.ref else {}), **({"sensitive": True} if a.sensitive else {})}) for a in self.attributes])

    def sensitive(self) -> list[str]:
        return [a.name for a in self.attributes if a.sensitive]

    @classmethod
    def from_json(cls, text: str | dict) -> EntityModel:
        """A model from its JSON form: name, key and a list of attributes with the flags of :class:`Attribute`."""
        data = json.loads(text) if isinstance(text, str) else dict(text)
        known = Attribute.__dataclass_fields__
        attributes = tuple(Attribute(**{k: tuple(v) if isinstance(v, list) else v for k, v in a.items() if k in known}) for a in data.pop("attributes"))
        return cls(attributes=attributes, **{k: tuple(v) if k == "constraints" else v for k, v in data.items() if k in cls.__dataclass_fields__})


class Registry:
    """Models by entity name, and the tables that hold their rows."""

    def __init__(self, models: list[EntityModel] | None = None):
        self.models = {m.name: m for m in models or ()}

    def model(self, entity: str) -> EntityModel:
        if entity not in self.models:
            raise ModelError(f"unknown entity {entity!r}")
        return self.models[entity]

    def discovery(self, spark: SparkSession, entity: str | None = None) -> DataFrame:
        """The catalogue of attributes: labels, option labels, and what can be grouped by or aggregated."""
        rows = []
        for m in self.models.values():
            for a in m.attributes if entity in (None, m.name) else ():
                numeric = a.type in ("number", "integer", "int", "long", "decimal", "double", "float")
                rows.append((m.name, a.name, a.type, a.label or title_case(a.name), a.ref, [f"{o}={a.option_labels.get(o, title_case(o))}" for o in a.options], a.dimension or a.type in ("string", "enum", "reference", "boolean"), a.metric or numeric, a.sensitive))
        return spark.createDataFrame(rows, "entity string, attribute string, type string, label string, entity_ref string, options array<string>, groupable boolean, aggregatable boolean, sensitive boolean")


def title_case(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in name.replace("/", " ").replace("_", " ").split())


def resolve(df: DataFrame, name: str) -> str:
    """The column that a possibly namespaced name means: exact, bare, or one with the same tail."""
    if name in df.columns:
        return name
    bare = name.rsplit("/", 1)[-1]
    if bare in df.columns:
        return bare
    tails = [c for c in df.columns if c.rsplit("/", 1)[-1] == bare]
    if not tails:
        raise ModelError(f"no column {name!r} among {df.columns}")
    return tails[0]


def column(df: DataFrame, name: str):
    return F.col(f"`{resolve(df, name)}`")


def with_defaults(df: DataFrame, model: EntityModel) -> DataFrame:
    """Columns that an older table lacks, as their defaults."""
    have = set(df.columns)
    return df.select("*", *(F.lit(a.default).cast(a.spark_type).alias(a.name) for a in model.attributes if a.name not in have))
