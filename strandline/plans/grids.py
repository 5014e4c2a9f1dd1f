"""Queries over delimited text and fixed-width records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import records as R
from ..operators.dictionary import numbered
from ..registry import query
from ..sources.tables import scaled, table


def _rendered(spark, sf_dir):
    """Texts of semicolon-separated orders, a text for each customer with three orders or more, beside all documents."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", scaled("o_totalprice").alias("c"), "o_orderpriority")
    price = F.concat(F.floor(F.col("c") / 100).cast("string"), F.lit("."), F.lpad(F.pmod("c", F.lit(100)).cast("string"), 2, "0"))
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), price, "o_orderpriority")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit("key;price;priority\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return rows.where(F.size("rows") >= 3).select(F.col("o_custkey").alias("key"), text.alias("text"))


_RENDERED = (
    "o AS (SELECT o_custkey AS key, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderpriority FROM orders), "
    "x AS (SELECT key, 'key;price;priority' || chr(10) || string_agg(o_orderkey || ';' || (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ';' || o_orderpriority, chr(10) ORDER BY o_orderkey) || chr(10) AS text "
    "FROM o GROUP BY 1 HAVING count(*) >= 3)"
)
_LINES = (
    "n AS (SELECT key, text, length(text) - length(replace(text, chr(10), '')) AS ends, (length(text) - length(replace(text, chr(13) || chr(10), ''))) / 2 AS crlfs FROM t), "
    "s AS (SELECT *, string_split(text, CASE WHEN ends > 0 AND crlfs = ends THEN chr(13) || chr(10) ELSE chr(10) END) AS p FROM n), "
    "l AS (SELECT key, CASE WHEN ends > 0 AND crlfs = ends THEN 'crlf' ELSE 'lf' END AS terminator, ends, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS lines FROM s), "
    "c AS (SELECT key, d, k, list_transform(lines, lambda x: length(x) - length(replace(x, d, ''))) AS n, terminator FROM l, (VALUES (';', 0), (',', 1), (chr(9), 2), ('|', 3)) AS v(d, k) WHERE ends >= 3 AND len(lines) >= 3), "
    "b AS (SELECT key, any_value(terminator) AS terminator, arg_min(d, k) AS delimiter FROM c WHERE list_min(n) = list_max(n) AND list_min(n) >= 1 GROUP BY 1)"
)


@query("delimiter_detect", f"WITH {_RENDERED}, t AS (SELECT 'o' || key AS key, text FROM x UNION ALL SELECT 'd' || doc_id, text FROM documents), {_LINES} SELECT key, terminator, delimiter FROM b")
def delimiter_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    texts = _rendered(spark, sf_dir).select(F.concat(F.lit("o"), F.col("key").cast("string")).alias("key"), "text").unionByName(docs)
    found = G.delimiters(texts, "key", "text")
    return found.withColumn("terminator", F.when(F.col("terminator") == "\r\n", "crlf").otherwise("lf"))


@query(
    "numeric_columns",
    f"WITH {_RENDERED} SELECT key, col, CASE col WHEN 0 THEN 0 WHEN 1 THEN 2 END AS ndec, col < 2 AS numeric FROM x, (SELECT unnest([0, 1, 2]::BIGINT[]) AS col)",
)
def numeric_columns(spark, sf_dir):
    long = G.cells(_rendered(spark, sf_dir), "key", "text").where("row > 0")
    return G.numeric_columns(long, ["key", "col"]).withColumn("ndec", F.col("ndec").cast("int"))


@query("grid_roundtrip", f"WITH {_RENDERED} SELECT key, text FROM x")
def grid_roundtrip(spark, sf_dir):
    """Grids taken apart into typed columns and put together again."""
    long = G.cells(_rendered(spark, sf_dir), "key", "text").persist()
    kinds = G.numeric_columns(long.where("row > 0"), ["key", "col"])
    typed = long.join(kinds, ["key", "col"])
    number = F.when(F.col("numeric") & (F.col("row") > 0), G.scaled(F.col("cell")))
    columns = typed.withColumns({"v": number}).withColumn("cell", F.when(F.col("v").isNull(), F.col("cell")))
    back = columns.withColumn("cell", F.coalesce("cell", G.unscaled(F.col("v"), F.col("ndec"))))
    lines = back.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("c"))
    lines = lines.select("key", F.struct("row", F.array_join(F.transform("c", lambda x: x["cell"]), ";").alias("line")).alias("l"))
    return lines.groupBy("key").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


_RECORDS = (
    "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_orderkey % 256 AS a, CAST(round(o_totalprice * 100) AS BIGINT) % 65536 AS b FROM orders), "
    "x AS (SELECT r * 6 + k AS i, CASE k WHEN 0 THEN a WHEN 1 THEN 7 WHEN 2 THEN b % 256 WHEN 3 THEN b // 256 WHEN 4 THEN 0 ELSE 200 END AS v FROM o, (SELECT unnest(generate_series(0, 5)) AS k))"
)


def _records(spark, sf_dir):
    """Six-byte records of all orders, as bytes (i, v); orders are numbered range by range."""
    o = numbered(table(spark, sf_dir, "orders").select("o_orderkey", scaled("o_totalprice").alias("c")), ["o_orderkey"])
    b = F.pmod("c", F.lit(65536))
    fields = F.array(F.pmod("o_orderkey", F.lit(256)), F.lit(7).cast("long"), F.pmod(b, F.lit(256)), F.floor(b / 256), F.lit(0).cast("long"), F.lit(200).cast("long"))
    rows = o.select("code", F.posexplode(fields).alias("k", "v"))
    return rows.select((F.col("code") * 6 + F.col("k")).cast("long").alias("i"), F.col("v").cast("long").alias("v"))


@query(
    "period_detect",
    f"WITH {_RECORDS.replace('x AS', 'w AS')}, x AS MATERIALIZED (SELECT * FROM w WHERE i < 65536), n AS (SELECT count(*) AS n FROM x), p AS (SELECT unnest(generate_series(2, least(256, (SELECT n // 4 FROM n)))) AS p), "
    "l AS (SELECT p, i - p AS at, v FROM p CROSS JOIN x), m AS (SELECT p, avg(CASE WHEN l.v = b.v THEN 1.0 ELSE 0.0 END) AS share FROM l JOIN x b ON b.i = l.at GROUP BY 1) "
    "SELECT CAST(p AS BIGINT) AS period, round(share, 6) AS share FROM m WHERE share > 0.2 ORDER BY share DESC, p LIMIT 1",
)
def period_detect(spark, sf_dir):
    return R.period(_records(spark, sf_dir))


@query("records_deinterleave", f"WITH {_RECORDS}, y AS (SELECT i // 6 AS rec, i % 6 AS k, v FROM x) SELECT CAST(rec AS BIGINT) AS rec, CAST(sum(CASE WHEN k = 0 THEN v END) AS BIGINT) AS c0, CAST(sum(CASE WHEN k = 1 THEN v END) AS BIGINT) AS c1, CAST(sum(CASE k WHEN 2 THEN v WHEN 3 THEN v * 256 END) AS BIGINT) AS c2, CAST(sum(CASE k WHEN 4 THEN v WHEN 5 THEN v * 256 END) AS BIGINT) AS c3 FROM y GROUP BY 1")
def records_deinterleave(spark, sf_dir):
    return R.deinterleave(_records(spark, sf_dir), [1, 1, 2, 2])


@query("records_roundtrip", f"WITH {_RECORDS} SELECT CAST(i AS BIGINT) AS i, CAST(v AS BIGINT) AS v FROM x")
def records_roundtrip(spark, sf_dir):
    return R.interleave(R.deinterleave(_records(spark, sf_dir), [1, 1, 2, 2]), [1, 1, 2, 2])
