"""Queries over ordered series: differences, residual buckets and prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import transforms as X
from ..registry import query
from ..sources.tables import cents, scaled, table

_U, _E = ["user_id"], ["event_id"]
_V = "s AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
_ZZ = "CASE WHEN {0} >= 0 THEN 2 * {0} ELSE -2 * {0} - 1 END"
_BK = "CAST(CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END AS BIGINT)"


def _k(v: str) -> str:
    return _BK.format("(" + _ZZ.format(v) + ")")


_W = "OVER (PARTITION BY user_id ORDER BY event_id)"
_D = f"{_V}, d AS (SELECT *, v - coalesce(lag(v) {_W}, 0) AS d FROM s)"
_O = "o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", scaled("o_totalprice").alias("v"))


@query("delta_bucket_hist", f"WITH {_D} SELECT {_k('d')} AS k, count(*) AS n FROM d GROUP BY 1")
def delta_bucket_hist(spark, sf_dir):
    d = X.buckets(X.delta(cents(spark, sf_dir), "v", _U, _E), "d")
    return d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("delta1_per_user", f"WITH {_D} SELECT user_id, event_id, d FROM d")
def delta1_per_user(spark, sf_dir):
    return X.delta(cents(spark, sf_dir), "v", _U, _E).select("user_id", "event_id", "d")


@query("delta2_per_user", f"WITH {_D} SELECT user_id, event_id, d - coalesce(lag(d) {_W}, 0) AS d2 FROM d")
def delta2_per_user(spark, sf_dir):
    return X.delta(X.delta(cents(spark, sf_dir), "v", _U, _E), "d", _U, _E, "d2").select("user_id", "event_id", "d2")


@query("undo_delta_roundtrip", f"WITH {_V} SELECT user_id, event_id, v FROM s")
def undo_delta_roundtrip(spark, sf_dir):
    d = X.delta(X.delta(cents(spark, sf_dir), "v", _U, _E).drop("v"), "d", _U, _E, "d2").drop("d")
    return X.undelta(X.undelta(d, "d2", _U, _E, "d1"), "d1", _U, _E).select("user_id", "event_id", "v")


_N = "s AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS v FROM events)"


def _gappy(spark, sf_dir):
    return cents(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("v")))


@query(
    "delta_null",
    f"WITH {_N} SELECT user_id, event_id, v - coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM s",
)
def delta_null(spark, sf_dir):
    return X.delta(_gappy(spark, sf_dir), "v", _U, _E).select("user_id", "event_id", "d")


@query("delta_null_roundtrip", f"WITH {_N} SELECT user_id, event_id, v FROM s")
def delta_null_roundtrip(spark, sf_dir):
    d = X.delta(_gappy(spark, sf_dir), "v", _U, _E).drop("v")
    return X.undelta(d, "d", _U, _E).select("user_id", "event_id", "v")


@query("xor_null_roundtrip", f"WITH {_N} SELECT user_id, event_id, v FROM s")
def xor_null_roundtrip(spark, sf_dir):
    d = X.xor(_gappy(spark, sf_dir), "v", _U, _E).drop("v")
    return X.unxor(d, "d", _U, _E).select("user_id", "event_id", "v")


@query(
    "fixed2_null",
    f"WITH {_N}, k AS (SELECT *, lag(v, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS a, lag(v, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM s WHERE v IS NOT NULL) "
    "SELECT user_id, event_id, CASE WHEN b IS NULL THEN v ELSE v - (2 * a - b) END AS e FROM k UNION ALL SELECT user_id, event_id, NULL FROM s WHERE v IS NULL",
)
def fixed2_null(spark, sf_dir):
    return X.order2(_gappy(spark, sf_dir), "v", _U, _E).select("user_id", "event_id", "e")


@query("xor_delta", f"WITH {_O} SELECT o_orderkey, xor(v, coalesce(lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0)) AS d FROM o")
def xor_delta(spark, sf_dir):
    return X.xor(_orders(spark, sf_dir), "v", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "d")


@query("xor_roundtrip", f"WITH {_O} SELECT o_orderkey, v FROM o")
def xor_roundtrip(spark, sf_dir):
    d = X.xor(_orders(spark, sf_dir), "v", ["o_custkey"], ["o_orderkey"]).drop("v")
    return X.unxor(d, "d", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "v")


@query("zigzag_roundtrip", f"WITH {_O}, d AS (SELECT o_orderkey, v - coalesce(lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS d FROM o) SELECT o_orderkey, d, {_ZZ.format('d')} AS u FROM d")
def zigzag_roundtrip(spark, sf_dir):
    d = X.delta(_orders(spark, sf_dir), "v", ["o_custkey"], ["o_orderkey"])
    u = d.select("o_orderkey", bits.zigzag(F.col("d")).alias("u"))
    return u.select("o_orderkey", bits.unzigzag(F.col("u")).alias("d"), "u")


@query(
    "ctx_order2_hist",
    f"WITH {_D}, k AS (SELECT user_id, event_id, {_k('d')} AS k FROM d), "
    f"c AS (SELECT k, least(coalesce(lag(k, 1) {_W}, 0), 16) * 17 + least(coalesce(lag(k, 2) {_W}, 0), 16) AS ctx FROM k) "
    "SELECT ctx, k, count(*) AS n FROM c GROUP BY 1, 2",
)
def ctx_order2_hist(spark, sf_dir):
    k = X.buckets(X.delta(cents(spark, sf_dir), "v", _U, _E), "d")
    return X.contexts(k, "k", _U, _E).groupBy("ctx", "k").agg(F.count(F.lit(1)).alias("n"))


def _select_sql(source: str, by: str, order: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY {order})"
    return (
        f"WITH {source}, a AS (SELECT *, v - coalesce(lag(v) {w}, 0) AS d1 FROM x), b AS (SELECT *, d1 - coalesce(lag(d1) {w}, 0) AS d2 FROM a), "
        f"c AS (SELECT {by}, sum(2 * {_k('v')} + 1) AS b0, sum(2 * {_k('d1')} + 1) AS b1, sum(2 * {_k('d2')} + 1) AS b2 FROM b GROUP BY 1) "
        f"SELECT {by}, CAST(CASE WHEN b0 <= b1 AND b0 <= b2 THEN 0 WHEN b1 <= b2 THEN 1 ELSE 2 END AS BIGINT) AS selector, CAST(least(b0, b1, b2) AS BIGINT) AS bits FROM c"
    )


@query("select_raw_d1_d2", _select_sql(_V.replace("s AS", "x AS"), "user_id", "event_id"))
def select_raw_d1_d2(spark, sf_dir):
    return X.price_raw_delta(cents(spark, sf_dir), "v", _U, _E)


@query("select_raw_d1_d2_orders", _select_sql(_O.replace("o AS", "x AS"), "o_custkey", "o_orderkey"))
def select_raw_d1_d2_orders(spark, sf_dir):
    return X.price_raw_delta(_orders(spark, sf_dir), "v", ["o_custkey"], ["o_orderkey"])


@query(
    "fixed2_residual",
    f"WITH {_V} SELECT user_id, event_id, CASE WHEN lag(v, 2) {_W} IS NULL THEN v ELSE v - (2 * lag(v) {_W} - lag(v, 2) {_W}) END AS e FROM s",
)
def fixed2_residual(spark, sf_dir):
    return X.order2(cents(spark, sf_dir), "v", _U, _E).select("user_id", "event_id", "e")


@query("fixed2_roundtrip", f"WITH {_V} SELECT user_id, event_id, v FROM s")
def fixed2_roundtrip(spark, sf_dir):
    """The inverse: two verbatim seeds make it a second difference whose second value is less by twice the first."""
    e = X.order2(cents(spark, sf_dir), "v", _U, _E).drop("v")
    w = Window.partitionBy(*_U).orderBy(*_E)
    seeded = F.when(F.row_number().over(w) == 2, F.col("e") - 2 * F.lag("e").over(w)).otherwise(F.col("e"))
    d2 = e.withColumn("d2", seeded)
    return X.undelta(X.undelta(d2, "d2", _U, _E, "d1"), "d1", _U, _E).select("user_id", "event_id", "v")


@query(
    "rice_static_len",
    f"WITH {_D}, u AS (SELECT user_id, {_ZZ.format('d')} AS u FROM d), "
    "l AS (SELECT user_id, k, CAST(sum((u >> k) + 1 + k) AS BIGINT) AS bits FROM u, (SELECT unnest(generate_series(0, 20)) AS k) GROUP BY 1, 2) "
    "SELECT user_id, CAST(arg_min(k, bits * 32 + k) AS BIGINT) AS k, min(bits) AS bits FROM l GROUP BY 1",
)
def rice_static_len(spark, sf_dir):
    """The best Rice parameter of each user: all 21 lengths are summed in one aggregation."""
    d = X.delta(cents(spark, sf_dir), "v", _U, _E).select("user_id", bits.zigzag(F.col("d")).alias("u"))
    sums = d.groupBy("user_id").agg(*[F.sum(bits.rice_length(F.col("u"), k)).alias(f"b{k}") for k in range(21)])
    best = F.array_min(F.array(*[F.struct(F.col(f"b{k}").alias("bits"), F.lit(k).cast("long").alias("k")) for k in range(21)]))
    return sums.select("user_id", best["k"].alias("k"), best["bits"].alias("bits"))


@query(
    "mid_side",
    "WITH x AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS l, CAST(round(l_quantity * 100) AS BIGINT) AS r FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, r + CAST(floor((l - r) / 2.0) AS BIGINT) AS m, l - r AS s, l, r FROM x",
)
def mid_side(spark, sf_dir):
    """Mid and side of two channels, and both back from them."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scaled("l_extendedprice").alias("l"), scaled("l_quantity").alias("r"))
    ms = t.select("l_orderkey", "l_linenumber", (F.col("r") + F.shiftright(F.col("l") - F.col("r"), 1)).alias("m"), (F.col("l") - F.col("r")).alias("s"))
    back = F.col("m") - F.shiftright(F.col("s"), 1)
    return ms.select("l_orderkey", "l_linenumber", "m", "s", (back + F.col("s")).alias("l"), back.alias("r"))


@query(
    "sparse_row_delta",
    "SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS d FROM orders",
)
def sparse_row_delta(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return X.delta(t, "o_orderkey", ["o_custkey"], ["o_orderkey"])


@query(
    "word_split_u64",
    "WITH x AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * 1000003 AS v FROM orders) "
    "SELECT o_orderkey, v & 4294967295 AS low, v >> 32 AS high FROM x",
)
def word_split_u64(spark, sf_dir):
    v = scaled("o_totalprice") * 1000003
    return table(spark, sf_dir, "orders").select("o_orderkey", v.bitwiseAND(F.lit(4294967295)).alias("low"), F.shiftrightunsigned(v, 32).alias("high"))


@query("value_slots", "SELECT doc_id, CAST(length(bin(n_chars)) - 1 AS BIGINT) AS slot, n_chars - CAST(2 ** (length(bin(n_chars)) - 1) AS BIGINT) AS rest FROM documents WHERE n_chars >= 1")
def value_slots(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("n_chars >= 1")
    return t.select("doc_id", bits.slot(F.col("n_chars")).alias("slot"), bits.slot_rest(F.col("n_chars")).alias("rest"))


@query("varint_len", "SELECT doc_id, CAST(greatest(1, ceil(CASE WHEN n_chars = 0 THEN 0 ELSE length(bin(n_chars)) END / 7.0)) AS BIGINT) AS n FROM documents")
def varint_len(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", bits.varint_length(F.col("n_chars")).alias("n"))


@query(
    "adaptive_depth",
    "SELECT doc_id, CAST(greatest(128, least(2048, 4194304 // greatest(n_chars, 1))) AS BIGINT) AS depth FROM documents",
)
def adaptive_depth(spark, sf_dir):
    """How many earlier places a match finder tries, by the size of a text; fixed values 128, 2048 and 2^22."""
    n = F.greatest(F.col("n_chars"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(128), F.least(F.lit(2048), F.floor(F.lit(4194304) / n))).cast("long").alias("depth"))


@query(
    "prefix_sum_total",
    "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events",
)
def prefix_sum_total(spark, sf_dir):
    """Running sums over all events: within ranges, with carried totals."""
    return X.prefix_sums(cents(spark, sf_dir).select("event_id", "v"), "v", ["event_id"]).select("event_id", "total")
