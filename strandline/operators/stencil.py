"""Predictors over planes of whole numbers (y, x, v), as windows along rows and columns.

Neighbours above come from a window by column, neighbours to the left from one
by row; a neighbour outside the plane is 0 for the gradient tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits

#: What the first value of a plane is predicted as, and the gradient thresholds: fixed values.
ORIGIN, GRADIENTS = 128, (80, 32, 8)


def neighbours(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` with w, n, nw, ne, ww and nn (null outside the plane)."""
    by = by or []
    row, column = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")
    up = df.withColumns({"n": F.lag("v").over(column), "nn": F.lag("v", 2).over(column)})
    return up.withColumns(
        {"w": F.lag("v").over(row), "ww": F.lag("v", 2).over(row), "nw": F.lag("n").over(row), "ne": F.lead("n").over(row)}
    )


def _edges(inner: Column) -> Column:
    """The first row is predicted from the left, the first column from above."""
    return (
        F.when(F.col("w").isNull() & F.col("n").isNull(), F.lit(ORIGIN).cast("long")).when(F.col("n").isNull(), F.col("w")).when(F.col("w").isNull(), F.col("n")).otherwise(inner)
    )


def med() -> Column:
    low, high = F.least("w", "n"), F.greatest("w", "n")
    return _edges(F.when(F.col("nw") >= high, low).when(F.col("nw") <= low, high).otherwise(F.col("w") + F.col("n") - F.col("nw")))


def paeth() -> Column:
    p = F.col("w") + F.col("n") - F.col("nw")
    a, b, c = (F.abs(p - F.col(x)) for x in ("w", "n", "nw"))
    return _edges(F.when((a <= b) & (a <= c), F.col("w")).when(b <= c, F.col("n")).otherwise(F.col("nw")))


def gap(scale: int = 1) -> Column:
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    w, n, nw, ne, ww, nn = map(z, ("w", "n", "nw", "ne", "ww", "nn"))
    dh, dv = F.abs(w - ww) + F.abs(n - nw) + F.abs(n - ne), F.abs(w - nw) + F.abs(n - nn) + F.abs(ne - nn)
    base = F.shiftright(w + n, 1) + F.shiftright(ne - nw, 2)
    d, (t1, t2, t3) = dv - dh, [t * scale for t in GRADIENTS]
    return _edges(
        F.when(d > t1, w).when(d < -t1, n).when(d > t2, F.shiftright(base + w, 1)).when(d < -t2, F.shiftright(base + n, 1))
        .when(d > t3, F.shiftright(3 * base + w, 2)).when(d < -t3, F.shiftright(3 * base + n, 2)).otherwise(base)
    )


PREDICTORS = {"med": med, "paeth": paeth, "gap": gap}


def residuals(df: DataFrame, predictor: str) -> DataFrame:
    return neighbours(df).select("y", "x", (F.col("v") - PREDICTORS[predictor]()).alias("r"))


def cost(r: Column) -> Column:
    """Bits that a residual takes: twice its bucket, and one."""
    return 2 * bits.bucket(bits.zigzag(r)) + 1


def block_sums(df: DataFrame, value: Column, size: int = 16) -> DataFrame:
    return df.groupBy(F.floor(F.col("y") / size).alias("by"), F.floor(F.col("x") / size).alias("bx")).agg(F.sum(value).alias("cost"))


def _displaced(y, x, v, known, layers, filled, origin: tuple[int, int], edge: tuple[int, int], size: int, reach: int) -> list[tuple]:
    """(block row, block column, dy, dx, sad) of each block among the pixels (y, x, v), those without a value marked.

    ``layers`` and ``filled`` are the places around as planes (values, and 0: no pixel, 1: one without a value, 2: a value);
    a second layer holds pixels whose place is taken.
    """
    rows, columns = y // size, x // size
    order = np.lexsort((columns, rows))
    y, x, v, known, rows, columns = (a[order] for a in (y, x, v, known, rows, columns))
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(columns) != 0)]))
    steps = np.arange(-reach, reach + 1)
    tx = np.clip(x[:, None] + steps, 0, edge[1]) - origin[1]
    best: list[tuple | None] = [None] * len(starts)
    for dy in steps.tolist():
        ty = (np.clip(y + dy, 0, edge[0]) - origin[0])[:, None]
        sums = pairs = valued = 0
        for plane, kind in zip(layers, filled, strict=True):
            met = kind[ty, tx]
            both = (met == 2) & known[:, None]
            sums = sums + np.add.reduceat(np.where(both, np.abs(v[:, None] - plane[ty, tx]), 0), starts)
            pairs = pairs + np.add.reduceat(met > 0, starts, dtype=np.int64)
            valued = valued + np.add.reduceat(both, starts, dtype=np.int64)
        blank = np.where(pairs > 0, np.where(valued > 0, 0, 1), 2)  # sums come first, then those of no values
        first = np.lexsort((np.broadcast_to(np.arange(len(steps)), sums.shape), sums, blank), axis=1)[:, 0]
        for k, j in enumerate(first.tolist()):
            if blank[k, j] < 2 and (best[k] is None or (blank[k, j], sums[k, j]) < best[k][:2]):
                best[k] = (int(blank[k, j]), int(sums[k, j]), dy, int(steps[j]))
    return [(int(rows[i]), int(columns[i]), m[2], m[3], None if m[0] else m[1]) for i, m in zip(starts, best, strict=True) if m]


def tiles(now: DataFrame, before: DataFrame, by: list[str], tile: int, reach: int) -> DataFrame:
    """(by, ty, tx, was, y, x, v, my, mx): pixels of ``now`` by tile, those of ``before`` for each tile within reach, and the last row and column."""
    edge = F.broadcast(before.agg(F.max("y").alias("my"), F.max("x").alias("mx")))
    inside = lambda c, m: F.floor(F.least(F.col(m), F.greatest(F.lit(0).cast("long"), F.col(c))) / tile)
    near = lambda c, m: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - reach) / tile)), F.floor(F.least(F.col(m), F.col(c) + reach) / tile))
    mine = now.crossJoin(edge).select(*by, inside("y", "my").alias("ty"), inside("x", "mx").alias("tx"), F.lit(False).alias("was"), "y", "x", "v", "my", "mx")
    around = before.crossJoin(edge).where("y >= 0 AND x >= 0").select(*by, F.explode(near("y", "my")).alias("ty"), "y", "x", "v", "my", "mx")
    around = around.select(*by, "ty", F.explode(near("x", "mx")).alias("tx"), F.lit(True).alias("was"), "y", "x", "v", "my", "mx")
    return mine.unionByName(around)


def motion(now: DataFrame, before: DataFrame, by: list[str] | None = None, size: int = 16, reach: int = 8) -> DataFrame:
    """(by, block row, block column, dy, dx, sad): where each block of ``now`` has its least sum of absolute differences in ``before``.

    Displacements are tried row by row; of equals the first stays. Outside
    places are clamped. A tile of blocks is searched by one task's value, which
    holds the tile's pixels and those of ``before`` within reach of it: a pixel
    is dealt out once, and once for each tile that it is near to.
    """
    by = by or []
    tile = size * max(1, 64 // size)
    wide = tile + 2 * reach
    names = [*by, "by", "bx", "dy", "dx", "sad"]
    schema = T.StructType([*(now.schema[c] for c in by), *(T.StructField(c, T.LongType()) for c in names[len(by) :])])

    def run(key, rows):
        was, y, x = (rows[c].to_numpy() for c in ("was", "y", "x"))
        known, v = rows["v"].is_valid().to_numpy(), rows["v"].fill_null(0).to_numpy()
        found = []
        if was.any() and not was.all():
            if len(v) * (int(v.max()) - int(v.min())) >= 1 << 63:
                raise OverflowError("differences beyond 64 bits")
            origin = tuple(int(k.as_py()) * tile - reach for k in key[len(by) :])
            at = (y[was] - origin[0]) * wide + x[was] - origin[1]
            order = np.argsort(at, kind="stable")
            at, values, kinds = at[order], v[was][order], np.where(known[was][order], 2, 1)
            layer = np.arange(len(at)) - np.searchsorted(at, at)  # how many pixels of this place came before
            planes, filled = np.zeros((2, int(layer.max()) + 1, wide * wide), np.int64)
            planes[layer, at], filled[layer, at] = values, kinds
            shape = (-1, wide, wide)
            m = ~was
            found = _displaced(y[m], x[m], v[m], known[m], planes.reshape(shape), filled.reshape(shape), origin, (rows["my"][0].as_py(), rows["mx"][0].as_py()), size, reach)
        columns = list(zip(*found, strict=True)) or [()] * 5
        keys = [pa.array([k.as_py()] * len(found), k.type) for k in key[: len(by)]]
        return pa.table([*keys, *(pa.array(c, pa.int64()) for c in columns)], names)

    return tiles(now, before, by, tile, reach).groupBy(*by, "ty", "tx").applyInArrow(run, schema)


def modes(now: DataFrame, before: DataFrame, size: int = 16) -> DataFrame:
    """(by, bx, mode): skip where a block did not change, intra where its own prediction is cheaper than the difference."""
    inner = neighbours(now).select("y", "x", cost(F.col("v") - med()).alias("intra"))
    j = now.join(before.select("y", "x", F.col("v").alias("p")), ["y", "x"]).join(inner, ["y", "x"])
    sums = j.groupBy(F.floor(F.col("y") / size).alias("by"), F.floor(F.col("x") / size).alias("bx")).agg(
        F.sum(F.abs(F.col("v") - F.col("p"))).alias("change"), F.sum(cost(F.col("v") - F.col("p"))).alias("inter"), F.sum("intra").alias("intra")
    )
    return sums.select("by", "bx", F.when(F.col("change") == 0, "skip").when(F.col("intra") < F.col("inter"), "intra").otherwise("inter").alias("mode"))


def bayer(df: DataFrame) -> DataFrame:
    """Four planes by the parity of row and column."""
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    return df.select((F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))).alias("plane"), half("y"), half("x"), "v")


def halved(df: DataFrame) -> DataFrame:
    """Means of squares of two by two, rounded down; a last odd row or column is left out."""
    sums = df.groupBy(F.floor(F.col("y") / 2).cast("long").alias("y"), F.floor(F.col("x") / 2).cast("long").alias("x")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.where("n = 4").select("y", "x", F.shiftright("s", 2).alias("v"))
