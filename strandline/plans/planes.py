"""Queries over planes, frames and channels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stencil as S
from ..operators import transforms as X
from ..registry import query
from ..sources.tables import plane, table

_P = "p AS (SELECT vec_id AS y, CAST(x - 1 AS BIGINT) AS x, CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS x FROM embeddings))"
_N = (
    f"{_P}, u AS (SELECT *, lag(v) OVER c AS n, lag(v, 2) OVER c AS nn FROM p WINDOW c AS (PARTITION BY x ORDER BY y)), "
    "q AS (SELECT *, lag(v) OVER r AS w, lag(v, 2) OVER r AS ww, lag(n) OVER r AS nw, lead(n) OVER r AS ne FROM u WINDOW r AS (PARTITION BY y ORDER BY x))"
)
_EDGE = "CASE WHEN w IS NULL AND n IS NULL THEN 128 WHEN n IS NULL THEN w WHEN w IS NULL THEN n ELSE {} END"
_MED = _EDGE.format("CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE w + n - nw END")
_PAETH = _EDGE.format(
    "CASE WHEN abs(n - nw) <= abs(w - nw) AND abs(n - nw) <= abs(w + n - nw - nw) THEN w WHEN abs(w - nw) <= abs(w + n - nw - nw) THEN n ELSE nw END"
)
_BASE = "(floor((w + n) / 2.0) + floor((ne0 - nw0) / 4.0))"
_GRAD = "((abs(w - nw0) + abs(n - nn0) + abs(ne0 - nn0)) - (abs(w - ww0) + abs(n - nw0) + abs(n - ne0)))"
_GAP = _EDGE.format(
    f"CAST(CASE WHEN {_GRAD} > 80 THEN w WHEN {_GRAD} < -80 THEN n WHEN {_GRAD} > 32 THEN floor(({_BASE} + w) / 2) WHEN {_GRAD} < -32 THEN floor(({_BASE} + n) / 2) "
    f"WHEN {_GRAD} > 8 THEN floor((3 * {_BASE} + w) / 4) WHEN {_GRAD} < -8 THEN floor((3 * {_BASE} + n) / 4) ELSE {_BASE} END AS BIGINT)"
)
_Q0 = "z AS (SELECT *, coalesce(nw, 0) AS nw0, coalesce(ne, 0) AS ne0, coalesce(ww, 0) AS ww0, coalesce(nn, 0) AS nn0 FROM q)"
_COST = "(2 * CASE WHEN ({0}) = 0 THEN 0 ELSE length(bin(CASE WHEN ({0}) >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END)) END + 1)"


def _register(name: str, sql: str):
    @query(f"{name}_residual", f"WITH {_N}, {_Q0} SELECT y, x, v - {sql} AS r FROM z")
    def residual(spark, sf_dir):
        return S.residuals(plane(spark, sf_dir), name)


for _name, _sql in (("med", _MED), ("paeth", _PAETH), ("gap", _GAP)):
    _register(_name, _sql)


@query(
    "predictor_choice",
    f"WITH {_N}, {_Q0}, r AS (SELECT v - {_MED} AS a, v - {_PAETH} AS b, v - {_GAP} AS c FROM z), s AS (SELECT CAST(sum({_COST.format('a')}) AS BIGINT) AS med, CAST(sum({_COST.format('b')}) AS BIGINT) AS paeth, CAST(sum({_COST.format('c')}) AS BIGINT) AS gap FROM r) "
    "SELECT med, paeth, gap, CASE WHEN med <= paeth AND med <= gap THEN 'med' WHEN paeth <= gap THEN 'paeth' ELSE 'gap' END AS choice FROM s",
)
def predictor_choice(spark, sf_dir):
    n = S.neighbours(plane(spark, sf_dir))
    sums = n.agg(*[F.sum(S.cost(F.col("v") - p())).alias(k) for k, p in S.PREDICTORS.items()])
    options = F.array(*[F.struct(F.col(k).alias("bits"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(S.PREDICTORS)])
    return sums.withColumn("choice", F.array_min(options)["name"])


@query("block_cost_16", f"WITH {_P} SELECT y // 16 AS by, x // 16 AS bx, CAST(sum({_COST.format('v')}) AS BIGINT) AS cost FROM p GROUP BY 1, 2")
def block_cost_16(spark, sf_dir):
    return S.block_sums(plane(spark, sf_dir), S.cost(F.col("v")))


_FRAMES = f"{_P}, b AS MATERIALIZED (SELECT y // 32 AS z, y % 32 AS y, x, v FROM p WHERE (y // 32) * 32 + 32 <= (SELECT max(y) + 1 FROM p)), a AS (SELECT z + 1 AS z, y, x, v FROM b)"


def _frames(spark, sf_dir):
    """Frames of 32 rows: (those before, under the number of the next; all). Rows that fill no frame are left out."""
    p = plane(spark, sf_dir)
    n = p.agg((F.max("y") + 1).alias("n"))
    b = p.join(F.broadcast(n)).select(F.floor(F.col("y") / 32).alias("z"), F.pmod("y", F.lit(32)).alias("y"), "x", "v", "n").where("z * 32 + 32 <= n").drop("n")
    return b.withColumn("z", F.col("z") + 1), b


@query(
    "interslice_delta",
    f"WITH {_P} SELECT y // 32 AS z, y % 32 AS y, x, v - coalesce(lag(v) OVER (PARTITION BY y % 32, x ORDER BY y // 32), 0) AS d FROM p",
)
def interslice_delta(spark, sf_dir):
    p = plane(spark, sf_dir).select(F.floor(F.col("y") / 32).alias("z"), F.pmod("y", F.lit(32)).alias("y"), "x", "v")
    return X.delta(p, "v", ["y", "x"], ["z"]).select("z", "y", "x", "d")


@query(
    "motion_sad_search",
    f"WITH {_FRAMES}, s AS (SELECT unnest(generate_series(-8, 8)) AS k), d AS (SELECT z, y, x, v, dy.k AS dy, dx.k AS dx, least(31, greatest(0, y + dy.k)) AS ty, least(63, greatest(0, x + dx.k)) AS tx FROM b, s dy, s dx), "
    "m AS (SELECT d.z, d.y // 16 AS \"by\", d.x // 16 AS bx, dy, dx, sum(abs(d.v - a.v)) AS sad FROM d JOIN a ON a.z = d.z AND a.y = ty AND a.x = tx GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY z, \"by\", bx ORDER BY sad, dy, dx) AS n FROM m) "
    "SELECT z, \"by\", bx, CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx, CAST(sad AS BIGINT) AS sad FROM r WHERE n = 1",
)
def motion_sad_search(spark, sf_dir):
    """Every frame of 32 rows against the one before."""
    before, now = _frames(spark, sf_dir)
    return S.motion(now, before, ["z"])


@query(
    "mode_mix",
    f"WITH {_P}, g AS (SELECT y // 32 AS z, y % 32 AS y, x, v FROM p), i AS (SELECT z, y, x, v, lag(v) OVER (PARTITION BY z, x ORDER BY y) AS n, lag(v) OVER (PARTITION BY z, y ORDER BY x) AS w FROM g), "
    "j AS (SELECT *, lag(n) OVER (PARTITION BY z, y ORDER BY x) AS nw FROM i), t AS (SELECT a.z, a.y // 16 AS by, a.x // 16 AS bx, sum(abs(a.v - b.v)) AS change, "
    f"sum({_COST.format('a.v - b.v')}) AS inter, sum({_COST.format('a.v - ' + _MED)}) AS intra FROM j a JOIN (SELECT z AS pz, y AS py, x AS px, v FROM g) b ON pz = a.z - 1 AND py = a.y AND px = a.x GROUP BY ALL) "
    "SELECT CASE WHEN change = 0 THEN 'skip' WHEN intra < inter THEN 'intra' ELSE 'inter' END AS mode, count(*) AS n FROM t GROUP BY 1",
)
def mode_mix(spark, sf_dir):
    """How the blocks of successive frames of 32 rows are best told."""
    g = plane(spark, sf_dir).select(F.floor(F.col("y") / 32).alias("z"), F.pmod("y", F.lit(32)).alias("y"), "x", "v")
    inner = S.neighbours(g, ["z"]).select("z", "y", "x", "v", S.cost(F.col("v") - S.med()).alias("intra"))
    before = g.select((F.col("z") + 1).alias("z"), "y", "x", F.col("v").alias("p"))
    j = inner.join(before, ["z", "y", "x"])
    t = j.groupBy("z", F.floor(F.col("y") / 16).alias("by"), F.floor(F.col("x") / 16).alias("bx")).agg(
        F.sum(F.abs(F.col("v") - F.col("p"))).alias("change"), F.sum(S.cost(F.col("v") - F.col("p"))).alias("inter"), F.sum("intra").alias("intra")
    )
    mode = F.when(F.col("change") == 0, "skip").when(F.col("intra") < F.col("inter"), "intra").otherwise("inter")
    return t.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("bayer_split", f"WITH {_P} SELECT (y % 2) * 2 + x % 2 AS plane, y // 2 AS y, x // 2 AS x, v FROM p")
def bayer_split(spark, sf_dir):
    return S.bayer(plane(spark, sf_dir))


@query("bayer_merge", f"WITH {_P} SELECT y, x, v FROM p")
def bayer_merge(spark, sf_dir):
    """Parity planes put together again."""
    b = S.bayer(plane(spark, sf_dir))
    return b.select((F.col("y") * 2 + F.floor(F.col("plane") / 2)).alias("y"), (F.col("x") * 2 + F.pmod("plane", F.lit(2))).alias("x"), "v")


@query(
    "rgb_green_subtract",
    f"WITH {_P}, c AS (SELECT y, x // 3 AS x, sum(CASE WHEN x % 3 = 0 THEN v ELSE 0 END) AS r, sum(CASE WHEN x % 3 = 1 THEN v ELSE 0 END) AS g, sum(CASE WHEN x % 3 = 2 THEN v ELSE 0 END) AS b FROM p GROUP BY ALL) "
    "SELECT y, x, CAST(g AS BIGINT) AS g, CAST(r - g AS BIGINT) AS rg, CAST(b - g AS BIGINT) AS bg FROM c",
)
def rgb_green_subtract(spark, sf_dir):
    """Every three columns as red, green and blue; what a last pixel lacks is 0."""
    of = lambda k: F.sum(F.when(F.pmod("x", F.lit(3)) == k, F.col("v")).otherwise(F.lit(0)))
    c = plane(spark, sf_dir).groupBy("y", F.floor(F.col("x") / 3).alias("x")).agg(of(0).alias("r"), of(1).alias("g"), of(2).alias("b"))
    return c.select("y", "x", "g", (F.col("r") - F.col("g")).alias("rg"), (F.col("b") - F.col("g")).alias("bg"))


@query("downsample_box", f"WITH {_P} SELECT y // 2 AS y, x // 2 AS x, CAST(floor(sum(v) / 4.0) AS BIGINT) AS v FROM p GROUP BY y // 2, x // 2 HAVING count(*) = 4")
def downsample_box(spark, sf_dir):
    return S.halved(plane(spark, sf_dir))


@query(
    "median_reference",
    f"WITH {_P}, m AS (SELECT y, CAST(trunc(quantile_cont(v, 0.5)) AS BIGINT) AS ref FROM p GROUP BY 1) SELECT y, x, v - ref AS r, ref FROM p JOIN m USING (y)",
)
def median_reference(spark, sf_dir):
    """Channels less their common median; the reference is kept."""
    p = plane(spark, sf_dir)
    m = F.percentile("v", F.lit(0.5)).over(Window.partitionBy("y"))
    ref = p.withColumn("ref", F.when(m < 0, F.ceil(m)).otherwise(F.floor(m)).cast("long"))
    return ref.select("y", "x", (F.col("v") - F.col("ref")).alias("r"), "ref")


@query("neighbour_channel_delta", f"WITH {_P} SELECT y, x, v - coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) AS d FROM p")
def neighbour_channel_delta(spark, sf_dir):
    return X.delta(plane(spark, sf_dir), "v", ["y"], ["x"]).select("y", "x", "d")


@query(
    "channel_correlation",
    f"WITH {_P}, d AS (SELECT y, x, v, lag(v) OVER (PARTITION BY y ORDER BY x) AS w FROM p) SELECT x, round(corr(v, w), 6) AS r, count(*) AS n FROM d WHERE w IS NOT NULL GROUP BY 1",
)
def channel_correlation(spark, sf_dir):
    d = plane(spark, sf_dir).withColumn("w", F.lag("v").over(Window.partitionBy("y").orderBy("x"))).where("w IS NOT NULL")
    return d.groupBy("x").agg(F.round(F.corr("v", "w"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query(
    "channel_oracle_router",
    f"WITH {_P}, d AS (SELECT y, x, v, v - coalesce(lag(v) OVER (PARTITION BY x ORDER BY y), 0) AS t, v - coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) AS c FROM p), "
    f"s AS (SELECT x, sum({_COST.format('v')}) AS raw, sum({_COST.format('t')}) AS along, sum({_COST.format('c')}) AS across FROM d GROUP BY 1) "
    "SELECT x, CAST(least(raw, along, across) AS BIGINT) AS bits, CASE WHEN raw <= along AND raw <= across THEN 'raw' WHEN along <= across THEN 'along' ELSE 'across' END AS winner FROM s",
)
def channel_oracle_router(spark, sf_dir):
    """For each channel the cheapest of its values, its differences in time and those to the channel before."""
    d = X.delta(X.delta(plane(spark, sf_dir), "v", ["x"], ["y"], "t"), "v", ["y"], ["x"], "c")
    s = d.groupBy("x").agg(F.sum(S.cost(F.col("v"))).alias("raw"), F.sum(S.cost(F.col("t"))).alias("along"), F.sum(S.cost(F.col("c"))).alias("across"))
    best = F.array_min(F.array(*[F.struct(F.col(k).alias("bits"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(("raw", "along", "across"))]))
    return s.select("x", best["bits"].alias("bits"), best["name"].alias("winner"))
