"""Fixed-width records: their period, and bytes to columns and back."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lags that are tried, the least length, and the share of equal bytes that a period must pass: fixed values.
LAGS, LEAST, SHARE = 256, 64, 0.2
#: Bytes from the begin that a period is looked for in, a fixed value: the sample is the feature.
SAMPLE = 1 << 16


def period(df: DataFrame, i: str = "i", v: str = "v") -> DataFrame:
    """(period, share): the lag at which most bytes of a sample repeat, the smallest of equals; no row if none passes.

    The first 64 KiB are looked at, as one array: its size is bounded, whatever the table's.
    """
    whole = F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(v).alias("v"))))
    sample = df.where(F.col(i) < SAMPLE).agg(F.transform(whole, lambda x: x["v"]).alias("x"))

    @F.pandas_udf("struct<period:long,share:double>")
    def best(x: pd.Series) -> pd.DataFrame:
        out = []
        for values in x:
            a = np.asarray(values)
            shares = [(float((a[p:] == a[:-p]).mean()), -p) for p in range(2, min(LAGS, len(a) // 4) + 1)] if len(a) >= LEAST else []
            top = max(shares, default=(0.0, 0))
            out.append((-top[1], round(top[0], 6)) if top[0] > SHARE else (None, None))
        return pd.DataFrame(out, columns=["period", "share"])

    return sample.select(best("x").alias("b")).select("b.*").where("period IS NOT NULL")


def deinterleave(df: DataFrame, widths: list[int], i: str = "i", v: str = "v") -> DataFrame:
    """(rec, c0, c1, ...): little-endian unsigned fields of up to 4 bytes; a rest that fills no record is left out."""
    size = sum(widths)
    at = F.pmod(F.col(i), F.lit(size))
    fields, begin = [], 0
    for k, w in enumerate(widths):
        parts = reduce(lambda a, b: a + b, [F.when(at == begin + b, F.shiftleft(F.col(v), 8 * b)).otherwise(0) for b in range(w)])
        fields.append(F.sum(parts).alias(f"c{k}"))
        begin += w
    rec = F.floor(F.col(i) / size).cast("long").alias("rec")
    return df.groupBy(rec).agg(*fields, F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).drop("_n")


def interleave(df: DataFrame, widths: list[int]) -> DataFrame:
    size = sum(widths)
    parts = [F.shiftrightunsigned(f"c{k}", 8 * b).bitwiseAND(F.lit(255)) for k, w in enumerate(widths) for b in range(w)]
    rows = df.select("rec", F.posexplode(F.array(*parts)).alias("k", "v"))
    return rows.select((F.col("rec") * size + F.col("k")).cast("long").alias("i"), "v")
