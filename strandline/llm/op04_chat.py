"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions alone.

A log that stores a conversation after each turn holds its earlier states as
prefixes. Every turn gets the rolling hash of the conversation up to it: the
exclusive or of 120-bit digests of (position, role, text), which can be summed
in parts. Conversations whose whole hash is the hash of a prefix of a longer
one go by an anti-join, and of equal ones the smallest id stays. The rest are
rendered, in parts of ``PART_TURNS`` turns.

Rows are dealt by ranges of (conversation, turn), so that a conversation that
holds a large part of all rows spans several partitions; positions and hashes
are summed within partitions and carried over the few conversations that span.

Defined cases: a repeated row counts once; turns of one number follow by role
and text, a null number first; null roles and texts are empty; rows without a
conversation are not rendered; ``<|`` in a role or text is rendered ``< |``, so
that nothing reads as a marker; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PART_TURNS = 512
_ORDER = ("turn", "role", "text")


def _digest(*columns) -> list:
    """Two halves of 60 bits of a digest."""
    whole = F.sha2(F.concat_ws(":", *columns).cast("binary"), 256)
    return [F.conv(F.substring(whole, k, 15), 16, 10).cast("long") for k in (1, 16)]


def turns(conversations: DataFrame) -> DataFrame:
    """Each turn with its position from 1, the rolling hash (h1, h2) up to it, and whether it is the last."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = rows.distinct().repartitionByRange("conv_id", *_ORDER).withColumn("pid", F.spark_partition_id())
    dealt = C.written(dealt, "turns")
    runs = dealt.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("n"))
    ends = runs.groupBy("conv_id").agg(F.min("pid").alias("low"), F.max("pid").alias("high"), F.collect_list(F.struct("pid", "n")).alias("runs"))
    spans = C.written(ends.where("low < high"), "spans")  # at most one for each border of partitions
    placed = C.checked_join(dealt, spans, "conv_id", "left")
    here = Window.partitionBy("pid", "conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.aggregate(F.filter("runs", lambda r: r["pid"] < F.col("pid")), F.lit(0).cast("long"), lambda t, r: t + r["n"])
    placed = placed.withColumn("position", F.row_number().over(here) + F.coalesce(before, F.lit(0).cast("long")))
    placed = placed.withColumn("last", F.lead(F.lit(1)).over(here).isNull() & F.coalesce(F.col("pid") == F.col("high"), F.lit(True)))
    h = _digest(F.col("position").cast("string"), F.length("role").cast("string"), "role", "text")
    placed = placed.withColumns({"d1": h[0], "d2": h[1]})
    placed = placed.withColumns({"h1": F.bit_xor("d1").over(upto), "h2": F.bit_xor("d2").over(upto)}).drop("runs", "low", "high")
    placed = C.written(placed, "hashed")
    partial = placed.join(F.broadcast(spans.select("conv_id")), "conv_id", "left_semi") if spans.limit(300_001).count() <= 300_000 else placed.join(
        spans.select("conv_id"), "conv_id", "left_semi"
    )
    sums = partial.groupBy("conv_id", "pid").agg(F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"))
    carry = C.written(sums.groupBy("conv_id").agg(F.collect_list(F.struct("pid", "x1", "x2")).alias("sums")), "carried")
    done = C.checked_join(placed, carry, "conv_id", "left")
    prior = F.filter("sums", lambda s: s["pid"] < F.col("pid"))
    added = lambda h, x: F.col(h).bitwiseXOR(F.coalesce(F.aggregate(prior, F.lit(0).cast("long"), lambda t, s: t.bitwiseXOR(s[x])), F.lit(0).cast("long")))
    return done.select("conv_id", *_ORDER, "position", "last", added("h1", "x1").alias("h1"), added("h2", "x2").alias("h2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with, the smallest id of equal ones."""
    whole = hashed.where("last").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.where("NOT last").select("position", "h1", "h2").distinct()
    return whole.join(prefixes, ["position", "h1", "h2"], "left_anti").select("conv_id", F.col("position").alias("n_turns"))


def render(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, rendered): the maximal conversations as chat text, ``part_turns`` turns a row."""
    hashed = C.written(turns(conversations), "prefixes")
    kept = C.written(maximal(hashed), "maximal")
    large = kept.where(F.col("n_turns") > F.greatest(F.lit(200), F.lit(hashed.count() // 512)))
    rows = C.checked_join(hashed.select("conv_id", "role", "text", "position"), kept, "conv_id", "inner", hot=[r[0] for r in large.select("conv_id").collect()])
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    said = F.concat(F.lit("<|im_start|>"), plain(F.col("role")), F.lit("\n"), plain(F.col("text")), F.lit("<|im_end|>\n"))
    rows = rows.select("conv_id", "n_turns", F.floor((F.col("position") - 1) / part_turns).alias("part"), F.struct("position", said.alias("said")).alias("t"))
    parts = rows.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list("t")).alias("t"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("t", lambda t: t["said"]), "").alias("rendered"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return render(C.table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, chr(1)) OVER w AS upto
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n, upto, min(conv_id) AS conv_id FROM p WHERE position = n GROUP BY ALL),
kept AS (SELECT conv_id, n FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position < p.n AND p.position = whole.n AND p.upto = whole.upto))
SELECT conv_id, ((position - 1) // 512)::BIGINT AS part, n::BIGINT AS n_turns,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
FROM p JOIN kept USING (conv_id, n) GROUP BY ALL"""
