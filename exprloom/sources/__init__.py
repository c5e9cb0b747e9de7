"""Where rows come from: context objects, tables of a folder, JSON columns."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import common_type


def infer_type(value: Any) -> T.DataType:
    """The Spark type of a context value; numbers are doubles.  Lists of mixed values have no one type."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, (int, float)):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(str(k), infer_type(v)) for k, v in value.items()])
    if isinstance(value, Sequence):
        return T.ArrayType(merged([infer_type(v) for v in value]))
    raise TypeError(f"a context can't hold {type(value).__name__}")


def merged(types: list[T.DataType]) -> T.DataType:
    """One type for several: records unite their fields."""
    rest = [t for t in types if not isinstance(t, T.NullType)]
    if rest and all(isinstance(t, T.StructType) for t in rest):
        names = dict.fromkeys(f.name for t in rest for f in t.fields)
        return T.StructType([T.StructField(k, merged([f.dataType for t in rest for f in t.fields if f.name == k])) for k in names])
    if rest and all(isinstance(t, T.ArrayType) for t in rest):
        return T.ArrayType(merged([t.elementType for t in rest]))
    found = common_type(rest)
    return T.VariantType() if found is None else found


def _shaped(value: Any, type_: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(type_, T.DoubleType):
        return float(value)
    if isinstance(type_, T.StructType):
        return tuple(_shaped(value.get(f.name), f.dataType) for f in type_.fields)
    if isinstance(type_, T.ArrayType):
        return [_shaped(v, type_.elementType) for v in value]
    return value


def _from_json(field: T.StructField):
    """A context's key out of its JSON, as the type that was inferred; what holds nulls only inside is read as null texts."""
    if isinstance(field.dataType, T.NullType):
        return F.lit(None)
    name = field.name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get("v", f"$['{name}']", field.dataType.simpleString().replace("void", "string"))


def from_contexts(spark: SparkSession, contexts: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row per context object, with all their keys as columns."""
    schema = merged([infer_type(c) for c in contexts])
    if not isinstance(schema, T.StructType) or not schema.fields:
        return spark.range(len(contexts)).select()
    if "variant" in schema.simpleString():
        import json

        text = spark.createDataFrame([(json.dumps(c),) for c in contexts], "j string").select(F.parse_json("j").alias("v"))
        return text.select(*[_from_json(f).alias(f.name) for f in schema.fields])
    return spark.createDataFrame([_shaped(c, schema) for c in contexts], schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder for files of our own: the one that ``spark.checkpoint.dir`` names, or a local one where all runs in one place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="exprloom-")


def with_json(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``df`` with a JSON text column parsed to VARIANT, whose members expressions can reach."""
    return df.withColumn(to or column, F.parse_json(F.col(column)))


def nested(df: DataFrame, child: DataFrame, parent_key: str, child_key: str, to: str) -> DataFrame:
    """``df`` with the child's rows of the same key as an array of structs, in the order of their columns.

    A parent's array is one value, so this is for children whose number per parent is bounded by their nature; parents
    without children have an empty array."""
    grouped = child.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in child.columns if c != child_key]))).alias(to))
    grouped = grouped.withColumnRenamed(child_key, "__key")
    joined = df.join(grouped, df[parent_key] == grouped["__key"], "left").drop("__key")
    item = grouped.schema[to].dataType
    return joined.withColumn(to, F.coalesce(to, F.array().cast(item)))
