"""Queries over dictionaries and runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dictionary as D
from ..registry import query
from ..sources.tables import table


@query(
    "first_seen_dictionary",
    "WITH f AS (SELECT o_orderpriority AS v, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT v, first, row_number() OVER (ORDER BY first) - 1 AS code FROM f",
)
def first_seen_dictionary(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("v"), "o_orderkey")
    return D.first_seen_dictionary(t, "v", "o_orderkey").select("v", "first", "code")


_BITS = "CAST(CAST({} AS BIT) AS BIGINT)"


@F.pandas_udf(T.LongType())
def raw_bits(x: pd.Series) -> pd.Series:
    """The bit pattern of doubles: keeps negative zero and every NaN apart."""
    return pd.Series(x.to_numpy("float64").view("int64"))


def _sorted(spark, sf_dir, name: str, column: str):
    """Bit patterns in unsigned order: the sign bit is turned, so that negative numbers come last."""
    t = table(spark, sf_dir, name).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    bits = t.select(raw_bits(F.col(column)).alias("bits"), "n")
    turned = bits.withColumn("key", F.col("bits").bitwiseXOR(F.lit(-9223372036854775808).cast("long")))
    return D.numbered(turned, ["key"]).select("bits", "n", "code")


def _sorted_sql(name: str, column: str) -> str:
    return (
        f"WITH c AS (SELECT {_BITS.format(column)} AS bits, count(*) AS n FROM {name} GROUP BY 1) "
        "SELECT bits, n, row_number() OVER (ORDER BY bits < 0, bits) - 1 AS code FROM c"
    )


@query("sorted_value_dictionary", _sorted_sql("events", "value"))
def sorted_value_dictionary(spark, sf_dir):
    return _sorted(spark, sf_dir, "events", "value")


@query("sorted_value_dictionary_discount", _sorted_sql("lineitem", "l_discount"))
def sorted_value_dictionary_discount(spark, sf_dir):
    return _sorted(spark, sf_dir, "lineitem", "l_discount")


@query("dictionary_decode", "SELECT event_id, value FROM events")
def dictionary_decode(spark, sf_dir):
    """Values to codes and back."""
    t = table(spark, sf_dir, "events").select("event_id", "value")
    d = D.sorted_dictionary(t, "value")
    return D.decode(D.encode(t, "value", d).select("event_id", "code"), d, "value").select("event_id", "value")


@query("dictionary_null_roundtrip", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS t FROM events")
def dictionary_null_roundtrip(spark, sf_dir):
    """A column with nulls to codes and back."""
    t = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("t"))
    d = D.first_seen_dictionary(t, "t", "event_id")
    return D.decode(D.encode(t, "t", d), d, "t").select("event_id", "t")


@query(
    "dictionary_null_codes",
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS t FROM events), f AS (SELECT t, min(event_id) AS first FROM t GROUP BY 1), "
    "c AS (SELECT t, row_number() OVER (ORDER BY first) - 1 AS code FROM f) SELECT event_id, code FROM t JOIN c ON t.t IS NOT DISTINCT FROM c.t",
)
def dictionary_null_codes(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("t"))
    return D.encode(t, "t", D.first_seen_dictionary(t, "t", "event_id")).select("event_id", "code")


_GATED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "dictionary_gate",
    " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(DISTINCT {c}) AS distinct, count(*) >= 8 AND count(DISTINCT {c}) < count(*) AS keep FROM lineitem" for c in _GATED),
)
def dictionary_gate(spark, sf_dir):
    return D.gate(table(spark, sf_dir, "lineitem"), list(_GATED))


_RUNS = (
    "WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w - 1 AS i, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM e) "
)


@query("rle_encode", _RUNS + "SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(i) AS start, count(*) AS n FROM r GROUP BY 1, 2")
def rle_encode(spark, sf_dir):
    return D.run_lengths(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "event_type", ["user_id"], ["event_id"])


@query("rle_decode", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_type FROM events")
def rle_decode(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return D.unrun(D.run_lengths(t, "event_type", ["user_id"], ["event_id"]), "event_type", ["user_id"]).select("user_id", "i", "event_type")


@query("distinct_profile", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value) AS amounts, count(*) AS n FROM events GROUP BY 1")
def distinct_profile(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return t.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("value").alias("amounts"), F.count(F.lit(1)).alias("n"))
