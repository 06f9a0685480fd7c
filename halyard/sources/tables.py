"""Tables of a folder of Parquet files, and the models of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halyard.plans.model import Attribute as A
from halyard.plans.model import EntityModel, Registry


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def loader(spark: SparkSession, folder: str):
    return lambda name: load_table(spark, folder, name)


def _model(name: str, key: str, attributes: str, **options) -> EntityModel:
    """Attributes as ``name:type`` or ``name:reference>entity``."""
    made = []
    for spec in attributes.split():
        attr, _, kind = spec.partition(":")
        kind, _, ref = kind.partition(">")
        made.append(A(attr, kind, ref=ref or None, fts=attr.endswith("_name")))
    return EntityModel(name, tuple(made), key, **options)


REGISTRY = Registry([
    _model("region", "r_regionkey", "r_regionkey:integer r_name:string"),
    _model("nation", "n_nationkey", "n_nationkey:integer n_name:string n_regionkey:reference>region"),
    _model("customer", "c_custkey", "c_custkey:long c_name:string c_nationkey:reference>nation c_acctbal:double c_mktsegment:enum"),
    _model("supplier", "s_suppkey", "s_suppkey:long s_name:string s_nationkey:reference>nation s_acctbal:double"),
    _model("part", "p_partkey", "p_partkey:long p_name:string p_brand:string p_type:string p_size:integer p_retailprice:double"),
    _model("orders", "o_orderkey", "o_orderkey:long o_custkey:reference>customer o_orderstatus:enum o_totalprice:double o_orderdate:epoch o_orderpriority:enum", time="o_orderdate"),
    _model("lineitem", "l_orderkey", "l_orderkey:reference>orders l_partkey:reference>part l_suppkey:reference>supplier l_linenumber:integer l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:enum l_linestatus:enum l_shipdate:epoch", time="l_shipdate"),
    _model("events", "event_id", "event_id:long ts:epoch user_id:long event_type:enum value:double props:json", time="ts"),
    _model("documents", "doc_id", "doc_id:long text:string lang:enum source:string n_chars:long"),
    _model("pages", "page_id", "page_id:long url:string html:string"),
    _model("conversations", "conv_id", "conv_id:long turn:long role:enum text:string"),
])


def rows_from_json(spark: SparkSession, columns: list[str], rows: list[list], model: EntityModel) -> DataFrame:
    """A row set of JSON values (column names and lists of cells) as a typed DataFrame; cells that don't fit are null."""
    from pyspark.sql import functions as F

    from halyard.operators.validate import coerce

    text = lambda v: None if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)
    raw = spark.createDataFrame([[text(v) for v in r] for r in rows], ", ".join(f"`{c}` string" for c in columns))
    return raw.select(*(coerce(F.col(f"`{c}`"), model[c].type).alias(c) for c in columns))


def from_arrow(spark: SparkSession, blob: bytes) -> DataFrame:
    """An Arrow IPC stream as a DataFrame."""
    import pyarrow as pa

    return spark.createDataFrame(pa.ipc.open_stream(blob).read_all())


def to_arrow(df: DataFrame) -> bytes:
    """A bounded result as an Arrow IPC stream."""
    import pyarrow as pa

    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()
