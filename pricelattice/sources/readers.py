"""Batch readers. Every reader takes a declared schema, so file-to-file type drift cannot change a table."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of Latin-1 whose places Turkish ones take in the single-byte encoding.
TURKISH = ("ÐÝÞðýþ", "ĞİŞğış")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine). A line that is no JSON goes to quarantine with its text; one with a wrong type keeps its other fields."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path")).filter("trim(value) <> ''")
    ok = F.try_parse_json("value").isNotNull()
    return lines.filter(ok).select(F.from_json("value", schema).alias("_r")).select("_r.*"), lines.filter(~ok).select(F.col("value").alias("_corrupt_record"), "file_path")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str | None = None) -> DataFrame:
    """CSV with a header, columns bound by name; quoted fields may hold newlines. Without an encoding, UTF-8 (its BOM is dropped), or
    Turkish single-byte text (Latin-1 with its six letters) where a file's bytes are no UTF-8. Files of one encoding and header are read together; columns that a file
    lacks are null, and so are values that do not fit their type."""
    files = spark.read.format("binaryFile").load(path)
    if encoding:
        kind, text = F.lit(encoding), F.decode("content", encoding)
    else:
        utf8 = F.try_validate_utf8(F.col("content").cast("string"))
        kind, text = F.when(utf8.isNotNull(), "UTF-8").otherwise("ISO-8859-1"), F.coalesce(utf8, F.decode("content", "iso-8859-1"))
    header = F.substring_index(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r", ""), "\n", 1)
    groups: dict[tuple[str, str], list[str]] = {}
    for r in files.select("path", kind.alias("kind"), F.encode(header, "UTF-8").alias("header")).collect():  # a row for each file, as the listing has
        groups.setdefault((r.kind, bytes(r.header).decode("utf-8")), []).append(r.path)
    frames = []
    for (kind_, line), paths in sorted(groups.items()):
        turkish = not encoding and kind_ != "UTF-8"
        names = next(csv.reader([line.translate(str.maketrans(*TURKISH)) if turkish else line]), [])
        raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        r = spark.read.schema(raw).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", kind_).csv(paths)
        at = {n.strip(): F.translate(f"c{i}", *TURKISH) if turkish else F.col(f"c{i}") for i, n in enumerate(names)}
        frames.append(r.select(*[at.get(f.name, F.lit(None).cast("string")).try_cast(f.dataType).alias(f.name) for f in schema.fields]))
    return concat_by_name(frames) if frames else spark.createDataFrame([], schema)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_parquet_years(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with the year of the file name as a column; broken files are skipped."""
    r = spark.read.option("ignoreCorruptFiles", "true")
    r = r.schema(schema) if schema else r
    return r.parquet(path).withColumn("file_year", F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})[^/]*$", 1).try_cast("int"))


def latest_partition(df: DataFrame, key: str, date: str, wanted: str | None = None) -> DataFrame:
    """Rows of the keys whose base date is the run's: the wanted date, which some keys may lack, or else the newest date of all keys."""
    if wanted is not None:
        return df.filter(F.col(date) == F.lit(wanted))
    newest = df.agg(F.max(date).alias(date))  # one row
    return df.filter(F.col(key).isNotNull()).join(F.broadcast(newest), date, "left_semi")


def first_nonempty(frames: list[DataFrame], default: DataFrame) -> DataFrame:
    """The first frame with a row; each is asked for one row at most."""
    for f in frames:
        if f.limit(1).count():
            return f
    return default


def concat_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_excel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Workbooks, one file per Python call; a workbook that cannot be read gives no rows."""
    names = schema.names

    def parse(batches):
        import io

        import pandas as pd

        for b in batches:
            for content in b["content"]:
                try:
                    frame = pd.read_excel(io.BytesIO(content), dtype=str)
                except Exception:  # noqa: BLE001  any broken workbook
                    continue
                yield frame.reindex(columns=names)

    strings = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, strings)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def html_cards(df: DataFrame, html: str, tag: str) -> DataFrame:
    """Inner text of each <tag> block, tags and entities stripped: regular expressions in the JVM."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    return df.select("*", F.posexplode(F.transform(blocks, text)).alias("card_no", "card_text"))


def labelled_fields(text, labels: list[str]) -> dict:
    """'Label: value' lines of a card, by label."""
    return {name: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{name}\s*:\s*(.*)$", 1)), F.lit("")) for name in labels}
