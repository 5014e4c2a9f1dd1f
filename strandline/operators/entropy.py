"""Histograms, entropies, adaptive code lengths and frequency models as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODEL_TOTAL = 1 << 16


def byte_histogram(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, b, n): counts of the bytes of a text column.

    A text is cut into its characters as an array and counted; the shuffle
    carries at most 256 rows a group from each task.
    """
    chars = F.decode(F.col(text).cast("binary"), "ISO-8859-1")
    rows = df.select(*by, F.explode(F.split(chars, "")).alias("c")).where(F.col("c") != "")
    return rows.groupBy(*by, "c").agg(F.count(F.lit(1)).alias("n")).select(*by, F.ascii("c").cast("long").alias("b"), "n")


def entropy(hist: DataFrame, by: list[str], n: str) -> DataFrame:
    """Bits a symbol of each group of a histogram, without a second pass: log t - sum(n log n) / t."""
    sums = hist.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.log2(n)).alias("s"))
    return sums.select(*by, F.round(F.abs(F.log2("n") - F.col("s") / F.col("n")), 6).alias("bits"), "n")


def frequency_model(hist: DataFrame, symbol: str, n: str = "n") -> DataFrame:
    """(sym, n, freq, cum, total): counts brought to a total of about 65,536, none below 1, with running sums.

    A model has a bounded alphabet; its rows meet in one window.
    """
    whole, order = Window.partitionBy(), Window.partitionBy().orderBy("sym")
    q = hist.select(F.col(symbol).alias("sym"), F.col(n).alias("n"))
    share = F.expr(f"n * {MODEL_TOTAL} div sum(n) over ()")
    q = q.withColumn("freq", F.greatest(F.lit(1).cast("long"), share))
    return q.withColumn("cum", F.sum("freq").over(order) - F.col("freq")).withColumn("total", F.sum("freq").over(whole))


def adaptive_bits(df: DataFrame, symbol: str, context: list[str], order: list[str], alphabet: int) -> DataFrame:
    """Bits of each symbol under counts that start at 1 and grow as its context is read, from running windows."""
    before = Window.partitionBy(*context).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*context, symbol).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total, mine = F.count(F.lit(1)).over(before) + alphabet, F.count(F.lit(1)).over(same) + 1
    return df.withColumn("bits", F.log2(total / mine))
