"""Dataset manifests and order-free checksums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed


def row_text(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """Unambiguous text of a row: every value prefixed by its length, doubles as decimals, null marked."""
    kinds = dict(df.dtypes)
    parts = []
    for c in cols or df.columns:
        value = F.col(c)
        if kinds[c] in ("double", "float"):
            value = value.cast("decimal(38,10)")
        text = value.cast("string") if not kinds[c].startswith(("array", "map", "struct")) else F.to_json(value)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def row_hash(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row count and a checksum that does not depend on row order or on how files are cut.

    Every row is hashed with SHA-256; the four 60-bit leading pieces are summed as
    decimals (map-side, one row per task leaves the executors) and hashed again.
    """
    digest = df.select(F.sha2(row_text(df, cols), 256).alias("digest"))
    pieces = [
        F.sum(F.conv(F.substring("digest", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{i}")
        for i in range(4)
    ]
    sums = digest.agg(F.count(F.lit(1)).alias("n_rows"), *pieces)
    text = F.concat_ws("-", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("n_rows", F.sha2(text, 256).alias("sha256_checksum"))


def dataset_manifest(df: DataFrame, target: str = fixed.TARGET, seed: int | None = None) -> DataFrame:
    """One row describing a customer table and the roles of its columns."""
    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.avg(target).alias("churn_rate")).select(
        "n_samples",
        F.lit(len(df.columns) - 1).alias("n_features"),
        "churn_rate",
        F.lit(seed).cast("int").alias("seed"),
        F.lit(target).alias("target_column"),
        names([fixed.ID]).alias("id_columns"),
        names(fixed.LEAKAGE).alias("leakage_fields"),
        names(fixed.CATEGORICAL).alias("categorical_features"),
        names(fixed.NUMERICAL).alias("numerical_features"),
    )


def write_dataset(df: DataFrame, path: str, target: str = fixed.TARGET, seed: int | None = None) -> DataFrame:
    """Write the table and its manifest; returns the manifest."""
    df.write.parquet(f"{path}/data")
    manifest = dataset_manifest(df.sparkSession.read.parquet(f"{path}/data"), target, seed)
    manifest.write.json(f"{path}/manifest")
    return manifest


def register_dataset_version(df: DataFrame, name: str, path: str, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """Write an immutable version of a table with a manifest over what was written."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    folder = f"{path}/{name}_{stamp}"
    df.write.parquet(folder)
    stored = df.sparkSession.read.parquet(folder)
    extra = [F.lit(x) for pair in (metadata or {}).items() for x in pair]
    manifest = row_hash(stored).select(
        F.lit(name).alias("dataset_name"),
        F.lit(folder).alias("filepath"),
        F.lit(stamp).alias("timestamp_utc"),
        "sha256_checksum",
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        (F.create_map(*extra) if extra else F.expr("cast(map() as map<string,string>)")).alias("custom_metadata"),
    )
    manifest.write.json(f"{path}/{name}_{stamp}_manifest")
    return df.sparkSession.read.schema(manifest.schema).json(f"{path}/{name}_{stamp}_manifest")
