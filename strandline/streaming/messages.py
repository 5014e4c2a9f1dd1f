"""Streams of small messages: each encoded by itself under a broadcast model, or in blocks by time and key.

An extension: the same encoders on Structured Streaming. The first form keeps
no state; late messages need no care. The second gathers a tumbling window for
each key, closed by a watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coders as K
from ..plans.training import compressed


def encode_messages(stream: DataFrame, text: str, shared) -> DataFrame:
    return compressed(stream, text, shared)


def encode_windows(stream: DataFrame, value: str, key: str, time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, key, n, blob): whole numbers of a key in the order of time, coded once its window is over."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: K.residuals_encode([int(y) for y in v]))

    gathered = stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))).alias("x"))
    return gathered.select("window", key, F.size("x").alias("n"), run(F.transform("x", lambda x: x["v"])).alias("blob"))
