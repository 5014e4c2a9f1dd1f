"""Queries that code and decode: what comes back is the source, through bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import coders as K
from ..operators import containers as N
from ..operators import detect
from ..operators import entropy as E
from ..operators import transforms as X
from ..registry import query
from ..sources.tables import cents, plane, scaled, table

_SOURCE = "SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events"


def _roundtrip(spark, sf_dir, encode, decode):
    coded = B.coded(B.in_blocks(cents(spark, sf_dir), "v", ["user_id"], ["event_id"]), encode)
    return B.rows_back(B.decoded(coded, decode), ["user_id"], "event_id")


@query("residual_roundtrip", _SOURCE)
def residual_roundtrip(spark, sf_dir):
    """First differences through the context coder and back."""
    return _roundtrip(spark, sf_dir, lambda v: K.residuals_encode(np.diff(v, prepend=0).tolist()), lambda b, n: np.cumsum(K.residuals_decode(b, n)).tolist())


@query("rice_roundtrip", _SOURCE)
def rice_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, K.rice_encode, K.rice_decode)


@query("lms_roundtrip", _SOURCE)
def lms_roundtrip(spark, sf_dir):
    """Residuals of the adaptive filter through the context coder and back."""
    return _roundtrip(spark, sf_dir, lambda v: K.residuals_encode(K.lms(v)), lambda b, n: K.lms(K.residuals_decode(b, n), back=True))


@query("fcm_roundtrip", "SELECT event_id, value FROM events")
def fcm_roundtrip(spark, sf_dir):
    """Doubles by context-hash prediction and back, as bit patterns."""
    t = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    b = B.in_blocks(t, "value", ["user_id"], ["event_id"])

    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda v: K.fcm_encode(np.array(v, np.float64).view(np.uint64).tolist()))

    @F.pandas_udf("array<double>")
    def decode(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.array(K.fcm_decode(b, int(k)), np.uint64).view(np.float64).tolist() for b, k in zip(x, n, strict=True)])

    coded = b.select("user_id", "keys", encode("values").alias("blob"), F.size("values").alias("n"))
    back = coded.select("user_id", "keys", decode("blob", "n").alias("values"))
    return B.rows_back(back, [], "event_id", "value")


@query(
    "calic_roundtrip",
    "SELECT vec_id AS y, CAST(x - 1 AS BIGINT) AS x, CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS x FROM embeddings)",
)
def calic_roundtrip(spark, sf_dir):
    """Bands of 16 rows as planes: coded by gradient prediction with learnt corrections, and back."""
    p = plane(spark, sf_dir).withColumn("band", F.floor(F.col("y") / 16))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        ys, xs = pdf["y"].unique(), pdf["x"].unique()
        a = pdf["v"].to_numpy().reshape(len(ys), len(xs))
        blob = K.residuals_encode(K.calic(a).ravel().tolist())
        back = K.calic(np.array(K.residuals_decode(blob, a.size), np.int64).reshape(a.shape), back=True)
        return pd.DataFrame({"y": pdf["y"], "x": pdf["x"], "v": back.ravel()})

    return p.groupBy("band").applyInPandas(run, "y long, x long, v long")


def _order_sql(k: int) -> str:
    w = "OVER (PARTITION BY user_id ORDER BY event_id)"
    context = " || '|' || ".join([f"coalesce(lag(event_type, {i}) {w}, '')" for i in range(1, k + 1)]) or "''"
    return (
        f"SELECT {k} AS k, round(sum(log2((total + 5.0) / (mine + 1))), 6) AS bits, count(*) AS n FROM ("
        "SELECT count(*) OVER (PARTITION BY user_id, c ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total, "
        "count(*) OVER (PARTITION BY user_id, c, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mine "
        f"FROM (SELECT user_id, event_id, event_type, {context} AS c FROM events))"
    )


@query("adaptive_order_k", " UNION ALL ".join(map(_order_sql, (0, 1, 2))))
def adaptive_order_k(spark, sf_dir):
    """What event types cost, each user by itself, under counts that grow, given none, one or two types before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = None
    for k in (0, 1, 2):
        c = t.withColumn("c", F.concat_ws("|", *[F.coalesce(F.lag("event_type", i).over(w), F.lit("")) for i in range(1, k + 1)]) if k else F.lit(""))
        bits = E.adaptive_bits(c, "event_type", ["user_id", "c"], ["event_id"], 5)
        one = bits.agg(F.lit(k).alias("k"), F.round(F.sum("bits"), 6).alias("bits"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("huffman_lengths")
def huffman_lengths(spark, sf_dir):
    """Code lengths of at most 15 bits for the bytes of all documents: 256 counts decide them."""
    hist = E.byte_histogram(table(spark, sf_dir, "documents"), [], "text").collect()  # 256 rows at most
    freqs = [0] * 256
    for b, n in hist:
        freqs[b] = n
    rows = [(s, n, bits) for s, (n, bits) in enumerate(zip(freqs, K.huffman_lengths(freqs), strict=True)) if n]
    return spark.createDataFrame(rows, "sym long, n long, bits long")


@query("float_dictionary_roundtrip", "SELECT o_orderkey, o_totalprice FROM orders")
def float_dictionary_roundtrip(spark, sf_dir):
    """Prices as codes into a dictionary of bit patterns, a block for each 10,000 orders, and back."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = N.floats_encode(pdf["o_totalprice"].to_numpy("<f8").tobytes(), 8)
        return pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "o_totalprice": np.frombuffer(N.floats_decode(blob), "<f8")})

    return B.through_files(t, "o_orderkey", run, "o_orderkey long, o_totalprice double")


@query("records_codec_roundtrip", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders")
def records_codec_roundtrip(spark, sf_dir):
    """Orders as fixed-width records (4, 4 bytes), coded column by column, and back."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", scaled("o_totalprice").alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o_orderkey")
        raw = np.stack([pdf["o_orderkey"].to_numpy("<u4"), pdf["c"].to_numpy("<u4")], axis=1).tobytes()
        back = np.frombuffer(N.records_decode(N.records_encode(raw, [4, 4])), "<u4").reshape(-1, 2).astype("int64")
        return pd.DataFrame({"o_orderkey": back[:, 0], "c": back[:, 1]})

    return B.through_files(t, "o_orderkey", run, "o_orderkey long, c long")


def routed(df, key: str, data: str):
    """(key, kind, method, n_in, n_out, ok): the smallest verified encoding of each blob."""
    found = detect.identify(df.select(F.col(key).alias("key"), F.coalesce(F.col(data), F.lit("")).cast("binary").alias("data")), "data")

    def run(batches):
        for pdf in batches:
            rows = []
            for k, d, kind in zip(pdf["key"], pdf["data"], pdf["kind"], strict=True):
                method, blob = N.choose(bytes(d), kind)
                rows.append((k, kind, method, len(d), len(blob), N.restore(method, blob) == bytes(d)))
            yield pd.DataFrame(rows, columns=["key", "kind", "method", "n_in", "n_out", "ok"])

    return found.select("key", "data", "kind").mapInPandas(run, "key long, kind string, method string, n_in long, n_out long, ok boolean")


@query("auto_route")
def auto_route(spark, sf_dir):
    """Documents and pages: kind, chosen method, sizes, and whether what is stored gives the source back."""
    docs = routed(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("source", F.lit("documents"))
    return docs.unionByName(routed(table(spark, sf_dir, "pages"), "page_id", "html").withColumn("source", F.lit("pages")))


@query("auto_route_verified", "SELECT 'documents' AS source, count(*) AS n, true AS ok FROM documents UNION ALL SELECT 'pages', count(*), true FROM pages")
def auto_route_verified(spark, sf_dir):
    r = auto_route(spark, sf_dir)
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("ok") & (F.col("n_out") <= F.col("n_in"))).alias("ok"))


@query("report_ratios")
def report_ratios(spark, sf_dir):
    """Bytes of all documents as they are, as routed, and under three common compressors, with ratios."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))

    def run(batches):
        for pdf in batches:
            rows = [(name, len(d), len(f(bytes(d)))) for d in pdf["data"] for name, f in (("raw", bytes), ("deflate", N.METHODS["deflate"][0]), *N.BARS.items())]
            yield pd.DataFrame(rows, columns=["method", "n_in", "n_out"])

    sums = t.mapInPandas(run, "method string, n_in long, n_out long").groupBy("method").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    return sums.withColumn("ratio", F.round(F.coalesce(F.try_divide("n_in", "n_out"), F.lit(0.0)), 6))


@query("price_vs_coded", "SELECT count(DISTINCT user_id) AS users, true AS ok FROM events")
def price_vs_coded(spark, sf_dir):
    """The context coder spends what its model says, but for a few bytes a block."""
    b = B.in_blocks(X.delta(cents(spark, sf_dir), "v", ["user_id"], ["event_id"]), "d", ["user_id"], ["event_id"])

    @F.pandas_udf("boolean")
    def close(x: pd.Series) -> pd.Series:
        return x.map(lambda v: abs(len(K.residuals_encode(v)) - K.residuals_bits(v) / 8) < 8 + 0.01 * len(v))

    return b.agg(F.countDistinct("user_id").alias("users"), F.bool_and(close("values")).alias("ok"))
