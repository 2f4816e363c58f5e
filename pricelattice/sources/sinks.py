"""Writers. One partition depth per table, one shuffle on the partition keys so that each key gives few files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.functions.dates import partition_text
from pricelattice.operators.dedup import append_new, upsert


def with_partitions(df: DataFrame, date, keys: list[str]) -> DataFrame:
    return df.withColumns({k: c for k, c in partition_text(date).items() if k in keys})


def write_partitions(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite", dry_run: bool = False, max_records: int = 5_000_000) -> int | None:
    """Partitioned Parquet; only partitions in df are replaced. dry_run counts and writes nothing."""
    if dry_run:
        return df.count()
    out = df.hint("rebalance", *keys).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records)
    out.partitionBy(*keys).parquet(path)
    return None


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    option = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(option)
    try:
        spark.conf.set(option, "false")  # partition values stay text ('04', not 4)
        return spark.read.parquet(path)
    except AnalysisException:
        return None
    finally:
        spark.conf.set(option, before)


def write_missing_partitions(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Skips partitions that are there: an anti join on their keys, which Spark answers from the directory listing."""
    have = table_or_none(spark, path)
    write_partitions(df if have is None else append_new(have.select(*keys), df, keys), path, keys, mode="append")


def append_only_new(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    have = table_or_none(spark, path)
    (df if have is None else append_new(have, df, keys)).write.mode("append").parquet(path)


def upsert_partitions(spark: SparkSession, new: DataFrame, path: str, keys: list[str], parts: list[str]) -> None:
    """Rewrites the touched partitions only, new rows winning by key. The merged rows are checkpointed first, since the read and the
    write share a path."""
    have = table_or_none(spark, path)
    if have is None:
        return write_partitions(upsert(new.limit(0), new, keys), path, parts)
    touched = have.join(new.select(*parts).distinct(), parts, "left_semi")
    merged = upsert(touched, new, keys)
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path.rstrip("/") + "_checkpoints")  # beside the table, which every executor reaches
    return write_partitions(merged.checkpoint(), path, parts)


def write_csv_report(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Sorted CSV and its summary: distinct products and rows per category. Files are UTF-8 with a byte order mark before the header."""
    marked = df.orderBy(*order).withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return df.groupBy("kategori").agg(F.count("*").alias("n"), F.countDistinct("urun").alias("products"))


def write_json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, nulls written; an earlier run's files go. `by` gives a folder for each value, of a day for instance."""
    out = df.write.mode("overwrite").option("ignoreNullFields", False)
    (out.partitionBy(*by) if by else out).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with one JSON array, for reports: its rows go through one task, batch by batch."""
    import pyarrow as pa

    schema = pa.schema([("value", pa.string())])

    def run(batches):
        first = True
        for b in batches:
            rows = b.column("value").drop_null().to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [("[" if first and not i else ",") + r for i, r in enumerate(rows)]}, schema=schema)
            first = first and not rows
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]}, schema=schema)

    text = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    text = text.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value")))  # so that an empty table is written too
    text.repartition(1).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def run_log_row(spark: SparkSession, source: str, bucket: str, mb_before: float, mb_after: float) -> DataFrame:
    from pricelattice.functions.numeric import safe_ratio

    row = spark.createDataFrame([(source, bucket, mb_before, mb_after)], "source string, bucket string, mb_before double, mb_after double")
    return row.select(F.current_timestamp().alias("ts"), "*", safe_ratio(F.col("mb_before"), F.col("mb_after")).alias("ratio"))


def keyed_messages(df: DataFrame, key: str) -> DataFrame:
    """key (SQL over the columns) and value (all columns as JSON) of each row, as a topic takes them."""
    return df.select(F.expr(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def kafka_sink(df: DataFrame, topic: str, key: str, servers: str, checkpoint: str):
    """A stream to a topic, keyed by SQL over its columns, all replicas acknowledged. Needs the Kafka connector on the class path."""
    return keyed_messages(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).option("checkpointLocation", checkpoint)
