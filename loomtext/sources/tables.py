"""Tables in and out: pages, crawled bytes, page texts and extracted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.charset import declared, decoded, detected, vote


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """page_id, url, html from any columnar or JSON source; the scan takes these columns only."""
    return spark.read.format(format).load(path).select(F.col("page_id").cast("long"), "url", "html")


def read_bytes(spark: SparkSession, path: str, language: str = "ALL", pattern: str = "*") -> DataFrame:
    """Files of a crawl as pages: character set by vote, text decoded. page_id is
    a hash of the path."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.col("content").alias("body"))
    return decode_pages(b, language)


def decode_pages(rows: DataFrame, language: str = "ALL", header: Column | None = None) -> DataFrame:
    """Pages of rows (page_id, url, body binary): vote of declaration, header and detector."""
    x = detected(rows, "body", language, "detected")
    meta = declared(F.decode(F.substring("body", 1, 2048), "ISO-8859-1"))
    x = x.withColumn("charset", vote(meta, header if header is not None else F.lit(None).cast("string"), F.col("detected")))
    return decoded(x, "body", "charset", "html").select("page_id", "url", "charset", "html")


def cookies(header: Column) -> Column:
    """Names and values of a Cookie header as a map; parts without = are no cookies,
    of a name that repeats the last value counts."""
    parts = F.transform(F.split(header, ";"), lambda p: F.trim(p))
    pairs = F.filter(parts, lambda p: F.contains(p, F.lit("=")) & ~F.startswith(p, F.lit("=")))
    key = lambda p: F.substring_index(p, "=", 1)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: key(q) == key(p)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(key(p).alias("k"), F.substring(p, F.length(key(p)) + 2, F.length(p)).alias("v"))))


def read_libsvm(spark: SparkSession, path: str, width: int) -> DataFrame:
    """label, features (dense array) of a text problem ``label index:value ..``."""
    t = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("t"))
    entries = F.map_from_entries(F.transform(F.slice("t", F.lit(2), F.size("t")), lambda e: F.struct(F.split_part(e, F.lit(":"), F.lit(1)).cast("int").alias("k"), F.split_part(e, F.lit(":"), F.lit(2)).cast("double").alias("v"))))
    dense = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0)))
    return t.select(F.element_at("t", 1).cast("double").alias("label"), dense.alias("features"))


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    entries = F.filter(F.transform(features, lambda v, i: F.when(v != 0, F.concat_ws(":", (i + 1).cast("string"), v.cast("string")))), lambda e: e.isNotNull())
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(entries, " ")).alias("value")).write.text(path)


def table_text(df: DataFrame, kind: str = "json") -> DataFrame:
    """One text a row: CSV, TSV or JSON."""
    row = F.struct(*df.columns)
    if kind == "json":
        return df.select(F.to_json(row).alias("value"))
    return df.select(F.to_csv(row, {"sep": "," if kind == "csv" else "\t"}).alias("value"))


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """A folder of CSV, TSV or JSON lines."""
    if kind == "json":
        df.write.json(path)
    else:
        df.write.option("sep", "," if kind == "csv" else "\t").option("header", True).csv(path)
