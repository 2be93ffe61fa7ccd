"""Nested values: column-once arrays, pruning, schema rules, coordinates mapped at any depth.

Null arrays and structs hold nothing; empty parents go where a function prunes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.operators.lineage import cut
from strataflow.operators.windows import no_clash


def column_once(df: DataFrame, keys: list[str], order: list[str], columns: list[Column]) -> DataFrame:
    """keys, rows (JSON arrays of the columns' values, in order, without their names) and n."""
    values = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    listed = F.sort_array(F.collect_list(F.struct(*order, values.alias("__v"))))
    made = df.groupBy(*keys).agg(listed.alias("__l"), F.count("*").alias("n"))
    # Each value is written as {"v":...}, of which the middle stays.
    alone = lambda v: F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})
    value = lambda v: alone(v).substr(F.lit(6), F.char_length(alone(v)) - 6)
    text = F.transform("__l", lambda x: F.concat(F.lit("["), F.array_join(F.array(*(value(x["__v"][f"c{i}"]) for i in range(len(columns)))), ","), F.lit("]")))
    return made.select(*keys, F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("rows"), "n")


def pruned(df: DataFrame, column: str, drop: Callable[[Column], Column]) -> DataFrame:
    """df whose array lacks the values that drop tells, without rows left empty."""
    return df.withColumn(column, F.filter(column, lambda v: ~F.coalesce(drop(v), F.lit(False)))).where(F.size(column) > 0)


def mapped(column: Column, kind: T.DataType, f: Callable[[Column], Column]) -> Column:
    """Coordinates, arrays of two numbers at any depth, through f: a transform for each level of the type."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.ArrayType):
        return f(column)
    return F.transform(column, lambda inner: mapped(inner, kind.elementType, f))


def violations(schema: T.StructType, column: Column, path: str = "$", required: bool = True) -> Column:
    """The paths of required (not nullable) fields that are missing, as an array."""
    found = []
    for field in schema.fields:
        value, at = column[field.name], f"{path}.{field.name}"
        if not field.nullable:
            found.append(F.when(value.isNull(), F.array(F.lit(f"{at}: missing"))).otherwise(F.array().cast("array<string>")))
        if isinstance(field.dataType, T.StructType):
            found.append(F.when(value.isNotNull(), violations(field.dataType, value, at)).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*found)) if found else F.array().cast("array<string>")


def explode_values(df: DataFrame, json: str) -> DataFrame:
    """df with path and value of every leaf of a JSON text, through variants, one level a round until none is left, so of
    any depth. Texts that are no JSON, and empty objects and arrays, have no leaves; columns `path` and `value` must not be
    there."""
    no_clash(df, "path", "value")
    kept = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")
    rows = cut(df.select(kept, F.try_parse_json(json).alias("__v")).where("__v is not null").select("__row", F.lit("$").alias("path"), F.to_json("__v").alias("value")))
    found = None
    while True:
        v = F.parse_json("value")
        parsed = rows.withColumn("__v", v).withColumn("__inner", F.schema_of_variant("__v").rlike("^(OBJECT|ARRAY)"))
        leaves = parsed.where("not __inner").select("__row", "path", "value")
        found = leaves if found is None else found.union(leaves)
        each = df.sparkSession.tvf.variant_explode(F.col("__v").outer())
        inner = parsed.where("__inner").select("__row", "path", "__v").lateralJoin(each)
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), F.col("key")))
        rows = cut(inner.select("__row", step.alias("path"), F.to_json(inner["value"]).alias("value")))
        if rows.isEmpty():
            return found.select("__row.*", "path", "value")


def restored(column: Column, history: str, value: str, before: str) -> Column:
    """A struct whose value is again what its history says it was, without the history; as it is, less the history, where
    there is none."""
    kept = F.coalesce(column[history][before], column[value])
    return F.when(column.isNotNull(), column.withField(value, kept).dropFields(history))
