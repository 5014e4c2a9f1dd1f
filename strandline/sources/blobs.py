"""Blobs and corpora: folders of files, splits, collections, generated samples, and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import containers as N


def read_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, size, data) of the files of a folder; order by path where order matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("content").alias("data"))


def digest(data: str = "data"):
    return F.sha2(F.col(data), 256)


def leaks(train: DataFrame, test: DataFrame, data: str = "data") -> DataFrame:
    """Test blobs whose content is in the training set too."""
    return test.withColumn("_h", digest(data)).join(train.select(digest(data).alias("_h")).distinct(), "_h", "left_semi").drop("_h")


def require_disjoint(train: DataFrame, test: DataFrame, key: str, data: str = "data") -> None:
    first = leaks(train, test, data).select(key).limit(3).collect()
    if first:
        raise ValueError(f"in both sets: {[r[0] for r in first]}")


def collect(files: DataFrame, extensions: list[str], least: int, most: int, want: int) -> DataFrame:
    """Different contents of a bounded size and given extensions, ``want`` of them in the order of their digests."""
    kept = files.where(F.col("size").between(least, most) & F.lower(F.element_at(F.split("name", r"\."), -1)).isin(extensions))
    return kept.withColumn("digest", digest()).dropDuplicates(["digest"]).orderBy("digest").limit(want)


def split_by_order(df: DataFrame, order: str, by: list[str], share: float = 0.8) -> DataFrame:
    w = Window.partitionBy(*by)
    k, n = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w)
    return df.withColumn("split", F.when(k <= F.floor(n * share), "train").otherwise("test"))


def messages(lines: DataFrame, fields: list[str], text: str = "value") -> DataFrame:
    """Readings with exactly as many fields as named, as one JSON text each."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    return lines.where(F.size(parts) == len(fields)).select(F.to_json(F.struct(*[parts[k].alias(f) for k, f in enumerate(fields)])).alias("message"))


def fixed_point(column: str, decimals: int):
    """Text with a constant number of decimals as a whole number; null where the text has another form."""
    ok = F.rlike(F.col(column), F.lit(rf"^-?[0-9]+\.[0-9]{{{decimals}}}$"))
    return F.when(ok, F.replace(F.col(column), F.lit(".")).cast("long"))


def generated(spark: SparkSession, kind: str, n: int, seed: int = 1) -> DataFrame:
    """(id, data): synthetic JSON, log or HTML texts; the same for a seed on every machine."""
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(f"{kind}:{seed}:{salt}")), F.lit(k))
    words = F.array(*[F.lit(w) for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma")])
    word = lambda salt: F.get(words, pick(salt, 6).cast("int"))
    text = {
        "json": F.to_json(F.struct(F.col("id"), word(1).alias("name"), pick(2, 100).alias("age"), F.array(word(3), word(4)).alias("tags"))),
        "logs": F.format_string("2024-01-%02d %02d:%02d:%02d INFO %s request=%d took %dms", pick(1, 28) + 1, pick(2, 24), pick(3, 60), pick(4, 60), word(5), pick(6, 10000), pick(7, 900)),
        "html": F.format_string("<!doctype html><html><body><h1>%s</h1><p>%s %s %d</p></body></html>", word(1), word(2), word(3), pick(4, 1000)),
    }[kind]
    return spark.range(n).select("id", text.cast("binary").alias("data"))


_READERS = {"npy": lambda d: N.read_npy(d)[1].shape, "fits": lambda d: N.read_fits(d)[1].shape, "wav": lambda d: N.read_wav(d)[1].shape, "y4m": lambda d: N.read_y4m(d)[2][0].shape}


def shapes(files: DataFrame, kind: str, data: str = "data") -> DataFrame:
    """``files`` with the shape of the array that each blob of a kind holds; null where it can't be read."""

    @F.pandas_udf("array<long>")
    def run(x):
        def one(d):
            try:
                return [int(k) for k in _READERS[kind](bytes(d))]
            except (ValueError, KeyError, IndexError, EOFError):
                return None

        return x.map(one)

    return files.withColumn("shape", run(F.col(data)))
