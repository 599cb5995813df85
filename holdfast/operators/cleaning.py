"""Cleaning raw customer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import known


def dedup_by_key(df: DataFrame, key: str = fixed.ID, order_col: str | None = None) -> DataFrame:
    """Keep the first row per key in ``order_col`` order; any row per key if there is no order.

    ``row_number() = 1`` is limited per task before the shuffle, so a key with
    very many copies sends one row per task.
    """
    if order_col is None:
        return df.dropDuplicates([key])
    first = Window.partitionBy(key).orderBy(order_col)
    return df.withColumn("_row", F.row_number().over(first)).where(F.col("_row") == 1).drop("_row")


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop whole-row duplicates."""
    return df.dropDuplicates()


def coerce_number(name: str) -> Column:
    """Number where the text parses, else null (surrounding white space allowed); NaN is missing."""
    return known(F.expr(f"try_cast(trim(`{name}`) as double)"))


def strip(text: Column) -> Column:
    """Remove all white space at both ends, tabs and line breaks included."""
    return F.regexp_replace(F.regexp_replace(text.cast("string"), "^\\s+", ""), "\\s+$", "")


def coerce_target(name: str = fixed.TARGET) -> Column:
    """Label as int; a label that is missing or does not parse stops the job."""
    number = F.expr(f"try_cast(`{name}` as double)")
    return F.when(number.isNull(), F.raise_error(F.lit(f"{name} is missing or not a number")).cast("int")).otherwise(
        number.cast("int")
    )


def coerce_types(df: DataFrame, numeric: Sequence[str] = tuple(fixed.NUMERICAL), categorical: Sequence[str] = tuple(fixed.CATEGORICAL), target: str = fixed.TARGET) -> DataFrame:
    kinds = dict(df.dtypes)
    changes: dict[str, Column] = {}
    for c in numeric:
        if kinds.get(c) == "string":
            changes[c] = coerce_number(c)
        elif kinds.get(c) in ("double", "float"):
            changes[c] = known(F.col(c))
    for c in categorical:
        if c in kinds:
            changes[c] = strip(F.col(c))
    if target in kinds:
        changes[target] = coerce_target(target)
    return df.withColumns(changes)


def clean_customers(df: DataFrame, key: str = fixed.ID, order_col: str | None = None, drop_duplicates: bool = True) -> DataFrame:
    """Deduplicate, coerce numbers, strip categories, check the label. Nulls stay null for the imputer."""
    if drop_duplicates:
        df = dedup_by_key(df, key, order_col) if key in df.columns else dedup_rows(df)
    return coerce_types(df)
