"""Substrings of bytes: frequencies, scores, segments, and matches against what came before.

Substrings are taken as hexadecimal slices of one string a row; the text itself
never goes past an explode, so rows stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the substrings that prune longer ones, and lengths of candidates: fixed values.
UNIT, LENGTHS = 8, (3, 4, 5, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Greatest distances at which matches of so many bytes pay: fixed values.
SHORT_CAPS = {3: 1 << 7, 4: 1 << 11, 5: 1 << 14}


def grams(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, i, g): every run of ``size`` bytes, as hexadecimal, with its place from 0."""
    hexed = F.hex(F.col(text).cast("binary"))
    n = F.floor(F.length(hexed) / 2) - size
    slices = F.when(n >= 0, F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2 * size))))
    return df.select(key, F.posexplode(slices).alias("i", "g")).withColumn("i", F.col("i").cast("long"))


def frequency(df: DataFrame, key: str, text: str, size: int = UNIT) -> DataFrame:
    return grams(df, key, text, size).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def candidates(df: DataFrame, key: str, text: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(g, size, n) of all substrings that occur twice or more; long ones only where their first UNIT bytes repeat."""
    repeated = frequency(df, key, text).where("n >= 2").select(F.col("g").alias("lead"))
    out = None
    for size in lengths:
        rows = grams(df, key, text, size).select("g")
        if size > UNIT:
            rows = rows.withColumn("lead", F.substring("g", 1, 2 * UNIT)).join(repeated, "lead", "left_semi").select("g")
        found = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("size", F.lit(size).cast("long"))
        out = found if out is None else out.unionByName(found)
    return out


def patterns(df: DataFrame, key: str, text: str, limit: int, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """The best substrings by frequency times (length - 2); of equals the longer, then the lesser bytes."""
    scored = candidates(df, key, text, lengths).withColumn("score", F.col("n") * (F.col("size") - 2))
    return scored.orderBy(F.desc("score"), F.desc("size"), "g").limit(limit)


def segment_scores(df: DataFrame, key: str, text: str, size: int = 2048, step: int = 512) -> DataFrame:
    """(key, segment, score): how often, in all texts together, the UNIT-byte runs of each segment occur."""
    rows = grams(df, key, text, UNIT)
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.join(n, "g")
    last = F.floor(F.col("i") / step)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") + UNIT - size) / step))
    segments = F.sequence(first, last)
    return placed.where(first <= last).select(key, F.explode(segments).alias("segment"), "n").groupBy(key, "segment").agg(F.sum("n").alias("score"))


def earlier_matches(df: DataFrame, key: str, text: str, window: int = 1 << 19, most: int = 2048, unit: int = 3) -> DataFrame:
    """(key, i, distance, rank): for each place the nearest earlier places with the same ``unit`` bytes, as many as a
    text of its length gets: 2^22 / n, between 128 and ``most`` (fixed values).

    Each place takes the frame of so many rows before it: no pairs of all places are made.
    """
    depth = F.greatest(F.lit(128), F.least(F.lit(most), F.floor(F.lit(1 << 22) / F.greatest(F.octet_length(F.col(text)), F.lit(1))))).cast("int")
    rows = grams(df, key, text, unit).join(df.select(key, depth.alias("depth")), key)
    w = Window.partitionBy(key, "g").orderBy("i").rowsBetween(-most, -1)
    back = rows.withColumn("before", F.reverse(F.collect_list("i").over(w))).select(key, "i", "depth", F.posexplode("before").alias("k", "j"))
    found = back.where(F.col("k") < F.col("depth")).select(key, "i", (F.col("i") - F.col("j")).alias("distance"), (F.col("k") + 1).cast("long").alias("rank"))
    return found.where(F.col("distance") <= window)


def longest_matches(df: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(key, i, pid, size): the longest pattern that begins at each place; of equals the first pattern.

    Patterns (pid, g) share lengths: places join once a length, on the whole run.
    """
    sizes = sorted(r[0] for r in patterns.select((F.length("g") / 2).cast("int")).distinct().collect())  # at most the lengths mined
    out = None
    for size in sizes:
        found = grams(df, key, text, size).join(F.broadcast(patterns.where(F.length("g") == 2 * size)), "g")
        found = found.select(key, "i", "pid", F.lit(size).cast("long").alias("size"))
        out = found if out is None else out.unionByName(found)
    best = out.groupBy(key, "i").agg(F.max(F.struct("size", -F.col("pid"))).alias("m"))
    return best.select(key, "i", (-F.col("m")["col2"]).alias("pid"), F.col("m.size").alias("size"))
