"""Dictionaries of distinct values and runs of equal ones.

The distinct values are ranked, not the rows: one window over the dictionary
alone, which then joins back (broadcast where Spark sees that it is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sorted_dictionary(df: DataFrame, value: str) -> DataFrame:
    """(value, code, n): distinct values in ascending order, numbered from 0.

    Codes come from ranges: each range partition numbers its own values, and
    the few partition sizes are carried, so no task holds all values.
    """
    return numbered(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), [value])


def first_seen_dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code, first): distinct values in the order of their first row, numbered from 0."""
    return numbered(df.groupBy(value).agg(F.min(order).alias("first")), ["first"])


def numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Rows with a ``code`` from 0 in the given order, which must tell all rows apart."""
    spark = distinct.sparkSession
    dealt = distinct.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).persist()
    sizes = sorted(dealt.groupBy("_p").count().collect())  # one row a partition
    at, carry = 0, []
    for p, n in sizes:
        carry.append((p, at))
        at += n
    side = spark.createDataFrame(carry or [(0, 0)], "_p int, _c long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.join(F.broadcast(side), "_p").withColumn("code", (rank + F.col("_c")).cast("long")).drop("_p", "_c")


def encode(df: DataFrame, value: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with the code of each value in place of it, a null being a value like any."""
    own = dictionary.select(F.col(value).alias("_value"), "code")
    return df.join(own, F.col(value).eqNullSafe(F.col("_value"))).drop("_value", value)


def decode(df: DataFrame, dictionary: DataFrame, value: str) -> DataFrame:
    return df.join(dictionary.select("code", value), "code")


def gate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, distinct, keep) for each column: a dictionary pays where there are fewer values than rows."""
    stack = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])
    long = df.select(F.explode(stack).alias("x")).select("x.name", "x.v")
    each = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("name").agg(F.sum("n").alias("n"), F.count("v").alias("distinct")).withColumn("keep", (F.col("n") >= 8) & (F.col("distinct") < F.col("n")))


def run_lengths(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, run, value, start, n): runs of equal values; nulls are equal."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    marked = df.withColumns({"_new": new, "_i": F.row_number().over(w).cast("long") - 1})
    runs = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return runs.groupBy(*by, "run").agg(F.first(value).alias(value), F.min("_i").alias("start"), F.count(F.lit(1)).alias("n"))


def unrun(runs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, i, value): the rows back."""
    at = F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)
    return runs.select(*by, value, F.explode(at).alias("i"))
