"""Near-duplicate join by MinHash banding, verified on whole n-gram sets.

1. Each text gives the set of its runs of ``SHINGLE`` words (a shorter one the
   run of all its words), minimum hashes, one key a band of them, and a sketch of
   ``BITS`` bits, which agree in (1 + s) / 2 of all places for sets of similarity s.
   Texts with one set are one class, represented by its smallest id. Bands and
   rows follow from the similarity and the recall asked for.
2. Classes that share a band key are candidates. In rounds each is held against
   the smallest of its band (``_ties``): sketches too far apart tie nothing, and a
   class so near to it that whatever is alike to the class must be tied as well
   is done with; the others go on among themselves. Connected components of the
   ties say which classes must be compared.
3. The classes of a component are compared set against set in tasks of bounded
   size: a large component is dealt into tiers by the size of sets (a pair of
   similarity s has sizes within s of each other, so neighbours suffice) and
   tiers into blocks, and every pair of blocks is one task. A task gives for
   each class its number of linked documents and the smallest class that it
   reaches there, never pairs.
4. Components of these ties are the classes of near-duplicates.

With r rows and b bands a pair of similarity s is missed with probability
(1 - s**r)**b: 4e-4 at 0.8 with 6 and 25, before the component's help.

Defined cases: a text without words (null, empty) links with nothing, nor does
a row without id; rows that repeat an id are the same document; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9995
#: Bits of a sketch, 64 a number; rounds in which a band's classes are held against its smallest.
BITS, ROUNDS = 512, 3
#: Shingles (at least LEAST for a set) that a block may hold: a large component is dealt into
#: some 24 blocks, of BLOCK[0] shingles at least and BLOCK[1] at most.
BLOCK, LEAST = (30_000, 400_000), 200
_A = C.mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shape(similarity: float, recall: float = RECALL, hashes: int = 176) -> tuple[int, int]:
    """The most rows a band, and bands for them, with which a pair of that similarity meets with ``recall``."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if rows * bands <= hashes:
            best = (bands, rows)
    return best


def shingles(offsets: np.ndarray, raw: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = C.Words(offsets, raw)
    h = w.hashes()
    runs = C.windows(h, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(C.windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _chunks(sets: list[np.ndarray]):
    """The sets that aren't empty, some 64k members at once, which stay in the cache: numbers, members, begins."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    at = 0
    while at < len(full):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at : at + (1 << 16)]]), 1 << 16)))
        some = full[at:end]
        yield some, np.concatenate([sets[k] for k in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        at = end


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of band keys, and of a sketch's numbers, for each set; the band's number is part of a key.

    The sketch's bits are taken from the minimum hashes, and from more of them where bands have too few.
    """
    out, sketch = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), BITS // 64), np.uint64)
    hashes = max(bands * rows, 128)
    each = -(-BITS // hashes)  # bits of a minimum hash: two sets with other minima differ in each of them by chance
    for some, x, begin in _chunks(sets):
        high, bits = x >> np.uint64(32), np.zeros((len(some), hashes * each), bool)
        key = np.zeros(len(some), np.uint64)
        for k in range(hashes):
            low = np.minimum.reduceat((x * _A[k] + high) >> np.uint64(16), begin)
            if k % rows == 0:
                key = np.full(len(some), np.uint64(k // rows + 1))
            key = key * np.uint64(0x9E3779B97F4A7C15) + low
            if k % rows == rows - 1 and k < bands * rows:
                out[some, k // rows] = C.mix(key)
            spread = C.mix(low)
            for e in range(each):
                bits[:, k * each + e] = (spread >> np.uint64(11 * e + 5)) & np.uint64(1)
        packed = np.packbits(np.ascontiguousarray(bits[:, np.arange(BITS) * (hashes * each) // BITS]), axis=1)
        packed = np.ascontiguousarray(packed)
        sketch[some] = packed.view(np.uint64)
    return out, sketch


def _signatures(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part, offsets, raw in C.slices(batch, "text"):
                sets = shingles(offsets, raw)
                keys, sketch = (x.view(np.int64) for x in band_keys(sets, bands, rows))
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if f else None for s, f in zip(sets, full, strict=True)], pa.string()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                        pa.array(list(sketch), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "set_id", "n", "keys", "sketch"],
                )

    return run


def _with_sets(batches):
    for batch in batches:
        for part, offsets, raw in C.slices(batch, "text"):
            sets = pa.array([s.tobytes() for s in shingles(offsets, raw)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], ["doc_id", "grams"])


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which of the sets are alike: a matrix, the diagonal false. Sets meet in their common members only."""
    k = len(sets)
    x = np.concatenate(sets)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    run = np.cumsum(new) - 1
    often = np.bincount(run)[run] > 1
    row, run = row[often], run[often]
    common = np.zeros((k, k), np.float32)
    if len(run):
        col = np.cumsum(np.concatenate([[False], run[1:] != run[:-1]]))
        step = max(256, min(1 << 16, (1 << 22) // k))
        for c in range(0, int(col[-1]) + 1, step):
            a, b = np.searchsorted(col, [c, c + step])
            m = np.zeros((k, min(step, int(col[-1]) + 1 - c)), np.float32)
            m[row[a:b], col[a:b] - c] = 1
            common += m @ m.T
    n = np.array([len(s) for s in sets], np.float64)
    both = common.astype(np.float64)
    out = both / np.maximum(n[:, None] + n[None, :] - both, 1) >= similarity
    np.fill_diagonal(out, False)
    return out


def reach(adjacent: np.ndarray) -> np.ndarray:
    """For each node the smallest that it reaches."""
    label = np.arange(len(adjacent))
    while True:
        low = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _crosses(unit: str) -> bool:
    """Whether a unit holds two different blocks, in which only pairs across count."""
    _, *blocks = unit.split(":")  # tier, block, tier, block; none for a component that isn't dealt out
    return blocks[:2] != blocks[2:]


def _compare_of(similarity: float):
    def run(batches):
        for unit in C.grouped(batches, "unit"):
            ids = unit.column("rep").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            side = unit.column("side").to_numpy()[order]
            copies = unit.column("copies").to_numpy()[order]
            raw = unit.column("grams").to_pylist()
            near = linked([np.frombuffer(raw[k], np.uint64) for k in order], similarity)
            if _crosses(unit.column("unit")[0].as_py()):  # also where one of the blocks has no members
                near &= side[:, None] != side[None, :]
            some = near.any(axis=1)
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array((near @ copies)[some].astype(np.int64)), pa.array(ids[reach(near)][some])], ["rep", "links", "low"]
                )

    return run


def _ties(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): ties whose components hold every pair of classes that share a band and may be alike.

    In each round a band's classes are held against its smallest, p. A class x with a similarity of (1 + s) / 2
    or more to p, s being the one asked for, needs no other tie: what is alike to x has one of 1.5 s - 0.5 or more
    to p, Jaccard's distance being a metric, and is tied to p as well, as only what the sketch shows to be 0.2 below
    that isn't. All others go on without p. After the last round the rest of a band is tied whatever its sketches.
    """
    far = BITS * (1 - max(0.0, 1.5 * similarity - 0.7)) / 2
    done = BITS * (1 - (1 + similarity) / 2) / 2
    banded = classes.select("rep", F.explode("keys").alias("key"))
    counts = banded.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    counts = C.written(counts, "bands")
    total = counts.agg(F.sum("many")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("many") > max(200, total // 512)).select("key").collect()]
    shared = C.written(C.join_hot(banded, counts.select("key"), "key", hot=hot), "banded")
    known = C.written(C.within(classes.select("rep", "sketch"), shared, "rep", "left_semi"), "sketches")  # of those that share a band
    active = C.written(C.checked_join(shared, known, "rep", "inner", hot=[]), "active")
    ties = []
    for k in range(ROUNDS + 1):
        low = active.groupBy("key").agg(F.min(F.struct("rep", "sketch")).alias("low"), F.count(F.lit(1)).alias("many")).where("many > 1")
        low = C.written(low, "lows")
        if low.isEmpty():
            break
        held = C.join_hot(active, low.select("key", "low"), "key", hot=hot).where("rep <> low.rep")
        if k == ROUNDS:
            ties.append(held.select(F.col("rep").alias("a"), F.col("low.rep").alias("b")))
            break
        apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("low.sketch")[i])) for i in range(BITS // 64)])
        held = C.written(held.select("rep", "sketch", "key", F.col("low.rep").alias("low"), apart.alias("apart")), "held")
        ties.append(held.where(F.col("apart") <= far).select(F.col("rep").alias("a"), F.col("low").alias("b")))
        active = held.where(F.col("apart") > done).select("rep", "sketch", "key")
    empty = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    return reduce(DataFrame.unionByName, ties, empty)


def _units(members: DataFrame, similarity: float) -> DataFrame:
    """(rep, copies, unit, side): the tasks that each class takes part in."""
    step = -math.log(similarity)
    tier = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int")
    members = members.withColumn("w", F.greatest("n", F.lit(LEAST))).withColumn("tier", tier)
    tiers = members.groupBy("component", "tier").agg(F.sum("w").alias("s"))
    whole = tiers.groupBy("component").agg(F.sum("s").alias("s"), F.collect_list(F.struct("tier", "s")).alias("t")).where(F.col("s") > BLOCK[0])
    size = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.floor(F.col("s") / 24)))
    dealt = F.transform("t", lambda t: F.struct(t["tier"].alias("tier"), F.ceil(t["s"] / size).cast("int").alias("blocks")))
    whole = C.written(whole.select("component", F.map_from_entries(dealt).alias("tiers")), "large")  # a few hundred tiers at most
    members = C.checked_join(members, whole, "component", "left")
    blocks = lambda t: F.coalesce(F.try_element_at("tiers", t), F.lit(0))
    own = F.pmod(F.xxhash64("rep"), F.greatest(blocks(F.col("tier")), F.lit(1))).cast("int")
    members = members.withColumn("own", own)
    name = lambda t, i, u, j: F.concat_ws(":", "component", t, i, u, j)
    unit = lambda key, side: F.struct(key.alias("unit"), side.cast("int").alias("side"))
    upto = lambda t: F.filter(F.sequence(F.lit(0), F.greatest(blocks(t), F.lit(1)) - 1), lambda j: j < blocks(t))
    t, i = F.col("tier"), F.col("own")
    same = F.transform(upto(t), lambda j: unit(name(t, F.least(i, j), t, F.greatest(i, j)), i > j))
    above = F.transform(upto(t + 1), lambda j: unit(name(t, i, t + 1, j), F.lit(False)))
    below = F.transform(upto(t - 1), lambda j: unit(name(t - 1, j, t, i), F.lit(True)))
    one = F.array(unit(F.col("component").cast("string"), F.lit(False)))
    some = F.when(F.col("tiers").isNull(), one).otherwise(F.concat(same, above, below))
    return members.select("rep", "copies", F.explode(some).alias("u")).select("rep", "copies", "u.unit", "u.side")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): class_id, the smallest id that links reach, and n_links,
    the number of other documents with a similarity of at least ``similarity``; of pairs just that alike
    a share of ``recall`` is found, of others more.

    Both are null and 0 where there is nothing to compare.
    """
    bands, rows = shape(similarity, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, set_id string, n long, keys array<long>, sketch array<long>"
    signed = C.written(docs.mapInArrow(C.tidied(_signatures(bands, rows)), schema), "signatures")
    classes = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
    )
    classes = C.written(classes, "classes")
    groups = C.written(components(_ties(classes, similarity)).withColumnRenamed("node", "rep"), "groups")
    members = C.written(C.checked_join(classes.select("rep", "copies", "n"), groups, "rep", "inner"), "members")
    units = C.written(_units(members, similarity), "units")
    texts = C.within(docs.where("doc_id IS NOT NULL"), members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(C.tidied(_with_sets), "doc_id long, grams binary").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    tasks = units.join(sets, "rep").repartition("unit").sortWithinPartitions("unit")
    found = C.written(tasks.mapInArrow(C.tidied(_compare_of(similarity)), "rep long, links long, low long"), "links")
    ends = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = C.written(links.join(ends, "rep", "left"), "tied")
    more = C.checked_join(classes.select("set_id", "rep", "copies"), tied, "rep", "left").where("copies > 1 OR links IS NOT NULL")
    more = more.select("set_id", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies")
    more = C.written(more, "classed")  # of all other documents each is a class of its own
    hot = [r[0] for r in more.where(F.col("copies") > F.greatest(F.lit(200), F.lit(signed.count() // 512))).select("set_id").collect()]
    out = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    out = C.checked_join(out, more.drop("copies"), "set_id", "left", hot=hot)
    own = F.when(F.col("set_id").isNotNull(), F.col("doc_id"))
    return out.select("doc_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each class."""
    gone = near_duplicates(docs, similarity).where("doc_id <> class_id").select("doc_id")
    return C.within(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
