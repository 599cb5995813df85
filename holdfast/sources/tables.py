"""Customer tables on disk: typed reads, writes, reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import fixed

_INTEGERS = {
    "age", "tenure_months", "active_days_per_month", "login_frequency_30d", "support_tickets_30d",
    "support_tickets_90d", "complaints_opened", "resolution_satisfaction_score", "chat_interactions",
    "payment_failures_90d", "late_payments_12m", "nps_score", "marketing_emails_opened_30d",
}


def customer_schema(raw: bool = False, id_type: T.DataType | None = None) -> T.StructType:
    """The 37-column customer table. ``raw`` reads every field as text, for the cleaner to coerce."""
    fields = [T.StructField(fixed.ID, id_type or T.StringType())]
    for name in fixed.CATEGORICAL:
        fields.append(T.StructField(name, T.StringType()))
    for name in fixed.NUMERICAL:
        kind = T.StringType() if raw else T.IntegerType() if name in _INTEGERS else T.DoubleType()
        fields.append(T.StructField(name, kind))
    whole = T.StringType() if raw else T.IntegerType()
    fields += [
        T.StructField("cancellation_processed_date", T.StringType()),
        T.StructField("final_invoice_flag", whole),
        T.StructField("account_status_deactivated", whole),
        T.StructField("churn_reason_recorded", T.StringType()),
        T.StructField(fixed.TARGET, whole),
    ]
    return T.StructType(fields)


def read_customers(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Customer table by file type. CSV columns are matched by header name, never by inferred type."""
    if path.rstrip("/").endswith(".csv") or "csv" in path.rsplit("/", 1)[-1]:
        schema = customer_schema(raw=raw)
        header = spark.read.option("header", True).csv(path).columns
        by_name = {f.name: f for f in schema}
        ordered = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
        return spark.read.schema(ordered).csv(path, header=True, enforceSchema=False)
    return spark.read.parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet for further work, CSV with header for exchange."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports are long tables; JSON appears only here, one object per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_lines(df: DataFrame, path: str, order: str, line: str = "line", mode: str = "overwrite") -> None:
    """A text report of bounded length as one ordered file."""
    df.orderBy(order).select(F.col(line).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_call_list(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The call list is bounded by its top-n, so one ordered CSV file is enough."""
    df.orderBy("rank").coalesce(1).write.mode(mode).option("header", True).csv(path)


def records(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: T.StructType) -> DataFrame:
    """Request dictionaries as a table; absent fields become null."""
    names = [f.name for f in schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
