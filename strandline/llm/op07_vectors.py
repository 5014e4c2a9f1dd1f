"""Embedding near-duplicates: sign hashing in several tables, exact cosines, components.

Equal vectors are one class. Random hyperplanes give a class a code of ``bits``
signs in each of ``tables`` tables; the bits grow with the logarithm of the
number of classes, so that buckets keep their size, and the tables follow from
the recall asked for at the threshold: a pair at angle a agrees in one sign
with probability 1 - a/pi. The classes of a bucket are compared in double
precision in blocks of bounded size, every pair of blocks being one task. A
pair counts only in the first table in which its codes agree, so no pairs are
ever written: a task gives for each class its number of linked vectors and the
smallest class that it reaches.

Defined cases: null or zero vectors, and those with null, NaN or infinite
components, link with nothing; vectors of other lengths are not compared with
each other; rows without an id get 0 links and null classes; rows that repeat
an id are the same vector if equal; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components
from .op08_jaccard import reach

THRESHOLD, RECALL = 0.9, 0.995
#: Classes that a bucket holds on average, and that a block holds at most on average.
BUCKET, BLOCK = 64, 1024
_SEED = 20_240_229


def shape(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = min(31, max(6, math.ceil(math.log2(max(classes, 2) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _classes(batches):
    for batch in batches:
        ids = batch.column("vec_id")
        keys, vectors = [], []
        for x in batch.column("embedding"):
            v = None
            if x.is_valid and len(x.values) and not x.values.null_count:
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                top = np.abs(v).max()
                if not np.isfinite(top) or top == 0:
                    v = None
            if v is None:
                keys.append(None)
                vectors.append(None)
                continue
            v = v + 0.0  # -0.0 is 0.0
            keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).hexdigest())
            w = v.astype(np.float32)
            vectors.append(w.tobytes() if (w == v).all() and len(w) % 2 == 0 else v.tobytes() + b"\x00")
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), pa.array(vectors, pa.binary())], ["vec_id", "class", "v"])


def _unpacked(raw: bytes) -> np.ndarray:
    """A stored vector at length 1: single precision where that loses nothing, else double and one byte more."""
    v = np.frombuffer(raw[:-1], np.float64) if len(raw) % 2 else np.frombuffer(raw, np.float32).astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _codes_of(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits)
        for batch in batches:
            raw = batch.column("v").to_pylist()
            codes = np.zeros((len(raw), tables), np.int64)
            units = [_unpacked(x) for x in raw]
            sizes = np.array([len(u) for u in units])
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([_SEED, int(d)]).standard_normal((int(d), tables * bits))
                for k in range(0, len(rows), 1024):
                    some = rows[k : k + 1024]
                    signs = np.stack([units[i] for i in some]) @ planes[d] > 0
                    codes[some] = signs.reshape(len(some), tables, bits) @ weight
            keys = [[f"{d}:{t}:{c}" for t, c in enumerate(row)] for d, row in zip(sizes.tolist(), codes.tolist(), strict=True)]
            packed = pa.array([c.astype("<u4").tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(keys, pa.list_(pa.string()))], [*batch.schema.names, "codes", "keys"])

    return run


def _compare_of(threshold: float):
    def run(batches):
        for unit in C.grouped(batches, "unit"):
            table = int(unit.column("unit")[0].as_py().split(":")[1])
            ids = unit.column("rep").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, side = ids[order], unit.column("side").to_numpy()[order]
            copies = unit.column("copies").to_numpy()[order]
            raw, codes = unit.column("v").to_pylist(), unit.column("codes").to_pylist()
            x = np.stack([_unpacked(raw[k]) for k in order])
            code = np.stack([np.frombuffer(codes[k], "<u4") for k in order])
            near = x @ x.T >= threshold
            if side.any() and not side.all():
                near &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(near, 1))
            for t in range(table):
                if not len(a):
                    break
                fresh = code[a, t] != code[b, t]
                a, b = a[fresh], b[fresh]
            if len(a):
                near = np.zeros((len(ids), len(ids)), bool)
                near[a, b] = near[b, a] = True
                some = near.any(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array((near @ copies)[some].astype(np.int64)), pa.array(ids[reach(near)][some])], ["rep", "links", "low"]
                )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = C.written(rows.mapInArrow(C.tidied(_classes), "vec_id long, class string, v binary"), "vectors")
    known = rows.where("class IS NOT NULL AND vec_id IS NOT NULL")
    classes = C.written(known.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "classes")
    bits, tables = shape(classes.count(), threshold, recall)
    hashed = classes.select("rep", "copies", "v").mapInArrow(
        _codes_of(bits, tables), "rep long, copies long, v binary, codes binary, keys array<string>"
    )
    hashed = C.written(hashed, "codes")
    sizes = hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    sizes = C.written(sizes, "buckets")
    many = sizes.select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    full = C.checked_join(hashed.select("rep", "copies", "v", "codes", F.explode("keys").alias("key")), many, "key", "inner")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    name = lambda j: F.concat_ws(":", "key", F.least("own", j), F.greatest("own", j))
    unit = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(name(j).alias("unit"), (F.col("own") > j).cast("int").alias("side"))
    )
    tasks = full.withColumn("own", own).select("rep", "copies", "v", "codes", F.explode(unit).alias("u"))
    tasks = tasks.select("rep", "copies", "v", "codes", "u.unit", "u.side").repartition("unit").sortWithinPartitions("unit")
    found = C.written(tasks.mapInArrow(C.tidied(_compare_of(threshold)), "rep long, links long, low long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ends = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    done = classes.join(links, "rep", "left").join(ends, "rep", "left").select(
        "class", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    joined = C.join_hot(known.select("vec_id", "class"), C.written(done, "classed"), "class").select("vec_id", "n_links", "component_id")
    rest = rows.where("class IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(C.table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id"""
