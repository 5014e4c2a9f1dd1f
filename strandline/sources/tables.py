"""Tables of a folder, and views of them as numbers in order, planes and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scaled(column: str, by: int = 100) -> F.Column:
    """A decimal column as a whole number of its last place."""
    return F.round(F.col(column) * by).cast("long")


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (user_id, event_id, v): the value in hundredths, ordered by event_id within a user."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", scaled("value").alias("v"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a plane of whole numbers (y, x, v)."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return rows.select("y", F.col("x").cast("long").alias("x"), F.round(F.col("e").cast("double") * 1000).cast("long").alias("v"))


def byte_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, b): the bytes of a text column, numbered from 0, each byte read as a Latin-1 character."""
    chars = F.decode(F.col(text).cast("binary"), "ISO-8859-1")
    rows = df.select(key, F.posexplode(F.transform(F.split(chars, ""), F.ascii)).alias("i", "b"))
    return rows.where(F.col("b").isNotNull() & (F.col("i") >= 0)).select(key, F.col("i").cast("long").alias("i"), F.col("b").cast("long").alias("b"))
