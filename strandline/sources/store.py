"""Sinks: encoded blobs and models as Parquet, a row each, partitioned by method or type."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containers as N
from ..operators.tokens import Model


def write_blobs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with method and blob; the size and a digest go along, as does the file layout by method."""
    df.withColumns({"size": F.length("blob"), "digest": F.sha2("blob", 256)}).write.mode(mode).partitionBy("method").parquet(path)


def read_blobs(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("method") == method) if method else df


def decode_blobs(df: DataFrame) -> DataFrame:
    """(all but blob, data): decoded by each row's method; an error for what is damaged."""

    @F.pandas_udf("binary")
    def run(method, blob, digest):
        import hashlib

        import pandas as pd

        out = []
        for m, b, d in zip(method, blob, digest, strict=True):
            if hashlib.sha256(b).hexdigest() != d:
                raise ValueError("damaged")
            out.append(N.restore(m, bytes(b)))
        return pd.Series(out)

    return df.withColumn("data", run("method", "blob", "digest")).drop("blob")


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    row = (model.id, [bytearray(p) for p in model.patterns], bytearray(model.blob), json.dumps([model.counts, model.dist_counts]))
    spark.createDataFrame([row], "id long, patterns array<binary>, blob binary, counts string").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(path).first()
    counts, dist = json.loads(r["counts"])
    model = Model([bytes(p) for p in r["patterns"]], bytes(r["blob"]), counts, dist)
    if model.id != r["id"]:
        raise ValueError("another model")
    return model
