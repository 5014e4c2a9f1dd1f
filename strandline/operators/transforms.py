"""Differences, exclusive-or chains and their inverses; every operator names its groups and its order.

A window partitioned by ``by`` costs one shuffle and one sort on (by, order);
operators over the same keys share them. A null value gives a null, the values
after it go on from the last that isn't null, and the inverses give the nulls back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits


def _window(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def _before(value: str, by: list[str], order: list[str]):
    """The last value before a row's own that isn't null."""
    return F.last(value, ignorenulls=True).over(_window(by, order).rowsBetween(Window.unboundedPreceding, -1))


def _upto(by: list[str], order: list[str]):
    return _window(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def delta(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "d", stride: int = 1) -> DataFrame:
    """First differences; the first of a group is the value itself. With a stride, from the value so many rows before
    (0 where there is none or it is null)."""
    before = _before(value, by, order) if stride == 1 else F.lag(value, stride).over(_window(by, order))
    return df.withColumn(name, F.col(value) - F.coalesce(before, F.lit(0)))


def undelta(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "v") -> DataFrame:
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.sum(value).over(_upto(by, order))))


def xor(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "d") -> DataFrame:
    return df.withColumn(name, F.col(value).bitwiseXOR(F.coalesce(_before(value, by, order), F.lit(0))))


def unxor(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "v") -> DataFrame:
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.bit_xor(value).over(_upto(by, order))))


def order2(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "e") -> DataFrame:
    """Residuals of linear extrapolation from the two values before that aren't null; the first two of a group are themselves."""
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*by, known).orderBy(*order)  # nulls apart: they stand in nobody's way
    a, b = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.withColumn(name, F.when(b.isNull(), F.col(value)).otherwise(F.col(value) - (2 * a - b)))


def buckets(df: DataFrame, value: str, name: str = "k") -> DataFrame:
    return df.withColumn(name, bits.bucket(bits.zigzag(F.col(value))))


def contexts(df: DataFrame, bucket: str, by: list[str], order: list[str], name: str = "ctx") -> DataFrame:
    w = _window(by, order)
    before = [F.coalesce(F.lag(bucket, n).over(w), F.lit(0).cast("long")) for n in (1, 2)]
    return df.withColumn(name, bits.context(*before))


def price_raw_delta(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """For each group the cheapest of raw, first and second differences by bucket bits; ties take the first."""
    d = delta(delta(df, value, by, order, "_d1"), "_d1", by, order, "_d2")
    cost = [F.sum(2 * bits.bucket(bits.zigzag(F.col(c))) + 1).alias(f"bits{k}") for k, c in enumerate((value, "_d1", "_d2"))]
    sums = d.groupBy(*by).agg(*cost)
    options = F.array(*[F.struct(F.col(f"bits{k}").alias("bits"), F.lit(k).cast("long").alias("selector")) for k in range(3)])
    best = F.array_min(options)
    return sums.select(*by, best["selector"].alias("selector"), best["bits"].alias("bits"))


def prefix_sums(df: DataFrame, value: str, order: list[str], name: str = "total", block_rows: int | None = None) -> DataFrame:
    """Running sums of one long sequence without a window over all rows in one task.

    Rows are dealt by ranges of the order; each partition sums its own, and the
    few partition totals are carried. Ties of the order must be broken by it.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*([block_rows] if block_rows else []), *order).withColumn("_p", F.spark_partition_id())
    dealt = dealt.persist()
    totals = dealt.groupBy("_p").agg(F.sum(value).alias("_t")).collect()  # one row a partition
    at, carry = 0, []
    for p, t in sorted(totals):
        carry.append((p, at))
        at += t or 0
    side = spark.createDataFrame(carry or [(0, 0)], "_p int, _c long")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(side), "_p").withColumn(name, F.sum(value).over(w) + F.col("_c")).drop("_p", "_c")
