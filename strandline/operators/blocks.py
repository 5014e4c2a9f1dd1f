"""Sequential coders over blocks: a group is cut into blocks of bounded size, each coded by itself.

(by, block) is the key of the shuffle, so a group of any size spreads over
tasks; what a block costs in ratio is the model's fresh start.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coders as K

ROWS = 65_536
#: Rows of a file, at most.
FILE = 10_000


def in_blocks(df: DataFrame, value: str, by: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """(by, block, keys, values): arrays in order, with the last order column as key."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = df.select(*by, F.col(order[-1]).alias("_k"), F.col(value).alias("_v"), i.alias("_i"), F.floor(i / rows).cast("long").alias("block"))
    sorted_ = F.array_sort(F.collect_list(F.struct("_i", "_k", "_v")))
    return numbered.groupBy(*by, "block").agg(sorted_.alias("_x")).select(
        *by, "block", F.transform("_x", lambda x: x["_k"]).alias("keys"), F.transform("_x", lambda x: x["_v"]).alias("values")
    )


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run


def coded(df: DataFrame, encode) -> DataFrame:
    """Blocks with their values as bytes."""
    return df.withColumn("blob", _udf(lambda v: encode([int(x) for x in v]), "binary")(F.col("values"))).withColumn("n", F.size("values")).drop("values")


def decoded(df: DataFrame, decode) -> DataFrame:
    @F.pandas_udf("array<long>")
    def run(blob: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([list(map(int, decode(b, int(k)))) for b, k in zip(blob, n, strict=True)])

    return df.withColumn("values", run("blob", "n")).drop("blob", "n")


def rows_back(df: DataFrame, by: list[str], key: str, value: str = "v") -> DataFrame:
    pairs = F.explode(F.arrays_zip(F.col("keys").alias("k"), F.col("values").alias("v")))
    return df.select(*by, pairs.alias("x")).select(*by, F.col("x.k").alias(key), F.col("x.v").alias(value))


CODERS = {"residual": (K.residuals_encode, K.residuals_decode), "rice": (K.rice_encode, K.rice_decode)}


def through_files(df: DataFrame, key: str, run, schema: str, rows: int = FILE) -> DataFrame:
    """``run`` over pandas frames of at most ``rows`` rows, of a size that no table changes; rows are dealt out by ``key``, as a table may be one split."""

    def each(batches):
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                yield run(pdf.iloc[at : at + rows].reset_index(drop=True))

    return df.repartition(key).mapInPandas(each, schema)
