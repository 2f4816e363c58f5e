"""Event-time streams. Each transformation also runs on a batch DataFrame, which the tests use to hold both against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WATERMARK = "48 hours"
# Topics and the key of a message, as SQL over its fields.
TOPICS = {
    "raw_market_prices": "productId", "raw_hal_prices": "urun", "raw_weather": "concat(lat, ',', lon)", "raw_gdelt": "globalEventId",
    "raw_epias": "concat(dataset, ':', hour)", "raw_tcmb": "series", "raw_akaryakit": "concat(il, ':', urun)",
}

# Partitions of a topic, days that it keeps messages, and messages that it gets a minute.
CONTRACT = {
    "raw_market_prices": (12, 7, 50_000 / 1440), "raw_hal_prices": (6, 30, 2_000 / 1440), "raw_weather": (12, 7, 2_000 / 60), "raw_gdelt": (6, 7, 5_000 / 15),
    "raw_epias": (6, 30, 288 / 1440), "raw_tcmb": (3, 30, 30 / 1440), "raw_akaryakit": (3, 30, 500 / 1440),
}


def topic_options(topic: str, trigger_s: int = 60, ahead: float = 20.0) -> dict[str, str]:
    """Source options by the topic's contract: a trigger takes `ahead` times what comes between two, so a backlog drains, in as many
    tasks as the topic has partitions; a query that was off for longer than messages are kept fails instead of skipping them."""
    partitions, _, per_minute = CONTRACT[topic]
    most = max(partitions * 100, round(per_minute * trigger_s / 60 * ahead))
    return {"subscribe": topic, "minPartitions": str(partitions), "maxOffsetsPerTrigger": str(most), "failOnDataLoss": "true", "startingOffsets": "earliest"}


def expired(topic: str, at, now):
    """Whether a message of that time is past the topic's retention."""
    return F.unix_timestamp(now) - F.unix_timestamp(at) > CONTRACT[topic][1] * 86400


def read_events(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 50, **options: str) -> DataFrame:
    """File or Kafka stream with back-pressure."""
    r = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return r.option("maxOffsetsPerTrigger", 100_000).load()
    return r.schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def parse_payload(df: DataFrame, schema: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of JSON payloads."""
    parsed = df.withColumn("_p", F.from_json(F.col(value).cast("string"), schema)).withColumn("_ok", F.try_parse_json(F.col(value).cast("string")).isNotNull())
    return parsed.filter("_ok").select("_p.*"), parsed.filter("not coalesce(_ok, false)").select(F.col(value).cast("string").alias("payload"))


def tumbling(df: DataFrame, at: str, size: str, by: list[str], value: str) -> DataFrame:
    g = df.withWatermark(at, WATERMARK) if df.isStreaming else df
    return g.groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sliding(df: DataFrame, at: str, size: str, slide: str, by: list[str], value: str) -> DataFrame:
    g = df.withWatermark(at, WATERMARK) if df.isStreaming else df
    return g.groupBy(F.window(at, size, slide).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), *by, "n", "mean")


def sessions(df: DataFrame, at: str, gap: str, by: list[str]) -> DataFrame:
    g = df.withWatermark(at, WATERMARK) if df.isStreaming else df
    return g.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def dedup(df: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """At-least-once input to one row per key within the watermark."""
    return df.withWatermark(at, WATERMARK).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def quarantine_sink(good_path: str, bad_path: str, schema: T.StructType):
    """foreachBatch function: good rows and dead letters, each in a folder named by batch id, so that a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = parse_payload(batch, schema)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")

    return write


def bronze_sink(df: DataFrame, path: str, checkpoint: str, at: str):
    """A stream to Parquet by day of `at`; the file sink's log makes each batch appear once."""
    return df.withColumn("day", F.date_format(at, "yyyy-MM-dd")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day")
