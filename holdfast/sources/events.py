"""Customer events, from a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

CUSTOMER_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)


def customer_events(raw: DataFrame) -> DataFrame:
    """Telemetry rows as retention events. Works on tables and on streams: one projection, no shuffle."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    meaning = (
        F.when((kind == "error") & (k >= 90), "support_ticket_opened")
        .when((kind == "purchase") & (k >= 98), "payment_failed")
        .when((kind == "click") & (k >= 90), "competitor_viewed")
        .when((kind == "view") & (k >= 90), "usage_drop_detected")
        .when((kind == "signup") & (k >= 90), "price_increase_notified")
        .otherwise("app_login")
    )
    return raw.select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        meaning.alias("event_type"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"),
    )


def parse_events(messages: DataFrame) -> DataFrame:
    """Events in the producer's own format (ISO timestamp text): typed, ready for watermarks."""
    return messages.select(
        "event_id", "customer_id", F.to_timestamp("timestamp").alias("ts"), "event_type", "attributes"
    )


def read_event_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = RAW_EVENTS,
    kind: str = "parquet",
    glob: str | None = None,
    files_per_batch: int = 64,
) -> DataFrame:
    """File stream with a fixed schema; the number of files bounds what one micro-batch holds."""
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def read_event_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Kafka topic of JSON events (needs the Kafka connector package on the class path)."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )
    parsed = stream.select(F.from_json(F.col("value").cast("string"), CUSTOMER_EVENTS).alias("event"))
    return parse_events(parsed.select("event.*"))
