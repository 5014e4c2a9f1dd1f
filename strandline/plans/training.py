"""Queries that train a text model on small messages and code with it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containers as N
from ..operators import detect
from ..operators import mining as M
from ..operators import tokens as K
from ..registry import query
from ..sources.tables import table

#: What a model is trained on: a bounded sample, in the order of digests, as a model is small by construction.
SAMPLES, PATTERNS = 200, 64


def train(messages: DataFrame, key: str, text: str, samples: int = SAMPLES) -> K.Model:
    """A dictionary mined from a sample, a text of segments that cover it, and frequencies, under which the rest of the sample
    costs least. Each of the nine kinds of text, and none, is tried by a task of its own."""
    spark = messages.sparkSession
    some = messages.where(F.col(text).isNotNull()).orderBy(F.sha2(F.col(text).cast("binary"), 256), key).limit(samples).select(key, text).persist()
    top = M.patterns(some, key, text, PATTERNS, (4, 6, 8, 12, 16, 24, 32)).collect()
    rows = [r[1].encode() for r in some.orderBy(key).collect()]
    some.unpersist()
    patterns, cut = [bytes.fromhex(r["g"]) for r in top], len(rows) * 4 // 5 if len(rows) >= 5 else len(rows)
    shared = spark.sparkContext.broadcast((rows, patterns))

    def run(batches):
        for pdf in batches:
            out = []
            for k, most, size in zip(pdf["k"], pdf["most"], pdf["size"], strict=True):
                rows, patterns = shared.value
                blob = K.select_blob(rows[:cut], int(most), int(size)) if most else b""
                model = K.train(rows, patterns, [blob])
                bits = sum(K.cost(K.parse(s, model, 32), model) for s in rows[cut:] or rows)
                out.append((k, bits, blob, model.counts, model.dist_counts))
            yield pd.DataFrame(out, columns=["k", "bits", "blob", "counts", "dist"])

    tried = [(k, *x) for k, x in enumerate(((0, 0), *K.BLOBS))]
    found = spark.createDataFrame(tried, "k int, most int, size int").repartition(len(tried), "k")
    best = found.mapInPandas(run, "k int, bits double, blob binary, counts array<int>, dist array<int>").orderBy("bits", "k").first()
    return K.Model(patterns, bytes(best["blob"]), list(best["counts"]), list(best["dist"]))


def _mapped(x: pd.Series, f) -> pd.Series:
    """``f`` of each value that isn't null; what comes again in a batch is found once."""
    known = {v: f(v) for v in x.dropna().unique()}
    return x.map(lambda v: None if v is None else known[v])


def compressed(df: DataFrame, text: str, shared) -> DataFrame:
    """``df`` with the text as bytes under a broadcast model."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return _mapped(x, lambda v: K.compress(v.encode(), shared.value, 32))

    return df.withColumn("blob", run(text)).drop(text)


def restored(df: DataFrame, text: str, shared) -> DataFrame:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return _mapped(x, lambda v: K.decompress(v, shared.value).decode())

    return df.withColumn(text, run("blob")).drop("blob")


@query("trained_codec_roundtrip", "SELECT event_id, props FROM events")
def trained_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages through a model trained on some of them, and back."""
    t = table(spark, sf_dir, "events").select("event_id", "props")
    shared = spark.sparkContext.broadcast(train(t, "event_id", "props"))
    return restored(compressed(t, "props", shared), "props", shared)


@query("trained_beats_untrained", "SELECT count(*) AS n, true AS smaller FROM events")
def trained_beats_untrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether messages take fewer bytes in all under a trained model than under none."""
    t = table(spark, sf_dir, "events").select("event_id", "props")
    trained, plain = spark.sparkContext.broadcast(train(t, "event_id", "props")), spark.sparkContext.broadcast(K.Model())

    def size(shared):
        @F.pandas_udf("long")
        def run(x: pd.Series) -> pd.Series:
            return _mapped(x, lambda v: len(K.compress(v.encode(), shared.value, 32))).astype("Int64")

        return run("props")

    sizes = t.select(size(trained).alias("a"), size(plain).alias("b"))
    return sizes.agg(F.count(F.lit(1)).alias("n"), (F.sum("a") < F.sum("b")).alias("smaller"))


@query("optimal_parse", "SELECT count(*) AS n, true AS ok FROM benchmark")
def optimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parse of least cost is never dearer than the greedy or the lazy one, and all give the text back."""
    t = table(spark, sf_dir, "benchmark")
    shared = spark.sparkContext.broadcast(train(t, "item_id", "text", 40))

    @F.pandas_udf("boolean")
    def ok(x: pd.Series) -> pd.Series:
        def one(v: str) -> bool:
            m, d = shared.value, v.encode()
            best, greedy, lazy = K.parse(d, m), K.parse(d, m, greedy=True), K.parse(d, m, lazy=True)
            return K.cost(best, m) <= min(K.cost(greedy, m), K.cost(lazy, m)) + 1e-6 and K.expand(best, m) == d == K.expand(greedy, m) == K.expand(lazy, m)

        return x.map(one)

    return t.agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok("text")).alias("ok"))


@query("lazy_parse_roundtrip", "SELECT event_id, props FROM events")
def lazy_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as tokens of a lazy parse under a trained model, and back."""
    t = table(spark, sf_dir, "events").select("event_id", "props")
    shared = spark.sparkContext.broadcast(train(t, "event_id", "props"))

    @F.pandas_udf("string")
    def back(x: pd.Series) -> pd.Series:
        return _mapped(x, lambda v: K.expand(K.parse(v.encode(), shared.value, 32, lazy=True), shared.value).decode())

    return t.select("event_id", back("props").alias("props"))


@query("auto_route_trained")
def auto_route_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts under a trained model where that is strictly smaller than the routed encoding, else as routed: kind,
    method, sizes, and whether what is stored gives the source back."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(train(t, "item_id", "text", 40))
    found = detect.identify(t.withColumn("data", F.col("text").cast("binary")), "data").select("item_id", "data", "kind")

    def run(batches):
        for pdf in batches:
            rows = []
            for k, d, kind in zip(pdf["item_id"], pdf["data"], pdf["kind"], strict=True):
                d = bytes(d)
                method, blob = N.choose(d, kind)
                own = K.compress(d, shared.value, 128)
                if len(own) < len(blob):
                    method, blob = "trained", own
                back = K.decompress(blob, shared.value) if method == "trained" else N.restore(method, blob)
                rows.append((k, kind, method, len(d), len(blob), back == d))
            yield pd.DataFrame(rows, columns=["item_id", "kind", "method", "n_in", "n_out", "ok"])

    return found.mapInPandas(run, "item_id long, kind string, method string, n_in long, n_out long, ok boolean")
