"""Jobs from a command line: ``python -m strandline COMMAND ...``. Paths may be on any file system that Spark reaches.

identify IN                 path, size, kind and codec of each file, printed
auto-compress IN OUT        each file by the smallest verified encoding, as rows of Parquet
auto-decompress IN OUT      those rows as (path, data)
train IN MODEL              a model for small texts from a folder's files
compress IN OUT -m MODEL    each file under a model; --or-route: as routed where that is no larger
decompress IN OUT -m MODEL  those rows as (path, data)
benchmark IN                bytes and ratios of the routed encoding and of common compressors, printed
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import containers as N
from .operators import detect
from .operators import tokens as K
from .plans.training import train
from .sources import store
from .sources.blobs import read_folder


def routed(files: DataFrame, model=None) -> DataFrame:
    """(path, kind, method, blob): the smallest verified encoding; with a broadcast model, its own where strictly smaller."""
    found = detect.identify(files.select("path", "data"), "data")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, data, kind in zip(pdf["path"], pdf["data"], pdf["kind"], strict=True):
                method, blob = N.choose(bytes(data), kind)
                if model is not None and len(own := K.compress(bytes(data), model.value)) < len(blob):
                    method, blob = "trained", own
                rows.append((path, kind, method, blob))
            yield pd.DataFrame(rows, columns=["path", "kind", "method", "blob"])

    return found.select("path", "data", "kind").mapInPandas(run, "path string, kind string, method string, blob binary")


def restored(rows: DataFrame, model=None) -> DataFrame:
    """(path, data) of rows by method; an error for what is damaged or another model's."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            data = [K.decompress(bytes(b), model.value) if m == "trained" else N.restore(m, bytes(b)) for m, b in zip(pdf["method"], pdf["blob"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "data": data})

    return rows.select("path", "method", "blob").mapInPandas(run, "path string, data binary")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in (("identify", 1), ("auto-compress", 2), ("auto-decompress", 2), ("train", 2), ("compress", 2), ("decompress", 2), ("benchmark", 1)):
        one = sub.add_parser(name)
        one.add_argument("source")
        if places == 2:
            one.add_argument("target")
        if name in ("compress", "decompress"):
            one.add_argument("-m", "--model", required=True)
        if name == "compress":
            one.add_argument("--or-route", action="store_true")
    said = p.parse_args(arguments)
    spark = SparkSession.builder.appName(f"strandline {said.command}").getOrCreate()
    model = spark.sparkContext.broadcast(store.load_model(spark, said.model)) if getattr(said, "model", None) else None
    if said.command in ("auto-decompress", "decompress"):
        restored(store.read_blobs(spark, said.source), model).write.parquet(said.target)
        return
    files = read_folder(spark, said.source)
    if files.isEmpty():
        raise SystemExit(f"no files in {said.source}")
    if said.command == "identify":
        detect.identify(files, "data").select("path", "size", "kind", "codec").orderBy("path").show(10_000, False)
    elif said.command == "auto-compress":
        store.write_blobs(routed(files), said.target)
    elif said.command == "train":
        store.save_model(spark, train(files.select("path", F.decode("data", "UTF-8").alias("text")), "path", "text"), said.target)
    elif said.command == "compress":
        rows = routed(files, model)
        if not said.or_route:
            own = F.udf(lambda d: K.compress(bytes(d), model.value), "binary")
            rows = files.select("path", F.lit(None).cast("string").alias("kind"), F.lit("trained").alias("method"), own("data").alias("blob"))
        store.write_blobs(rows, said.target)
    else:
        bars = {"raw": bytes, "deflate": N.METHODS["deflate"][0], **N.BARS}

        def sizes(batches):
            import pandas as pd

            for pdf in batches:
                rows = [(name, len(d), len(f(bytes(d)))) for d in pdf["data"] for name, f in bars.items()]
                yield pd.DataFrame(rows, columns=["method", "n_in", "n_out"])

        own = routed(files).join(files.select("path", "size"), "path").select(F.lit("routed").alias("method"), F.col("size").alias("n_in"), F.length("blob").cast("long").alias("n_out"))
        every = files.select("data").mapInPandas(sizes, "method string, n_in long, n_out long").unionByName(own)
        totals = every.groupBy("method").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
        totals.withColumn("ratio", F.round(F.try_divide("n_in", "n_out"), 4)).orderBy("n_out").show(100, False)


if __name__ == "__main__":
    main()
