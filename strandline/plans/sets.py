"""Queries over corpora as sets: copies, leaks, splits, chunks, substrings and matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mining as M
from ..registry import query
from ..sources.tables import table


@query("train_test_leak", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON sha256(d.text) = sha256(b.text)")
def train_test_leak(spark, sf_dir):
    """Documents that are whole benchmark items."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.join(b, "h").select("doc_id", "item_id")


@query("split_leak", "SELECT source, count(DISTINCT sha256(text)) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.source <> d.source AND sha256(e.text) = sha256(d.text)) GROUP BY 1")
def split_leak(spark, sf_dir):
    """How many texts of each source are in another source too."""
    t = table(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).distinct()
    both = t.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.collect_set("source").alias("sources")).where("k > 1")
    return both.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("content_dedup", "SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "crawl_order",
    "SELECT h, doc_id FROM (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE octet_length(encode(text)) BETWEEN 200 AND 20000 GROUP BY 1) ORDER BY h LIMIT 100",
)
def crawl_order(spark, sf_dir):
    """A collection of 100 different texts of a bounded size, in the order of their digests: a limit is the feature."""
    t = table(spark, sf_dir, "documents").where(F.octet_length("text").between(200, 20000))
    return t.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).orderBy("h").limit(100)


@query(
    "split_80_20",
    "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.8) THEN 'train' ELSE 'test' END AS split FROM documents",
)
def split_80_20(spark, sf_dir):
    w = Window.partitionBy("source")
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").select("doc_id", F.when(k <= F.floor(n * 0.8), "train").otherwise("test").alias("split"))


@query(
    "chunk_lines_40",
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), c AS (SELECT doc_id, k, lines[k * 40 + 1:k * 40 + 40] AS part FROM (SELECT doc_id, lines, unnest(generate_series(0, (len(lines) - 1) // 40)) AS k FROM l)) "
    "SELECT doc_id, CAST(k AS BIGINT) AS chunk, array_to_string(part, chr(10)) AS text FROM c WHERE octet_length(encode(array_to_string(part, chr(10)))) >= 200",
)
def chunk_lines_40(spark, sf_dir):
    """Texts in pieces of forty lines, those of 200 bytes or more; slices of an array, no regrouping."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    at = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 40).cast("int"))
    parts = t.select("doc_id", F.posexplode(F.transform(at, lambda k: F.array_join(F.slice("lines", k * 40 + 1, F.lit(40)), "\n"))).alias("chunk", "text"))
    return parts.where(F.octet_length("text") >= 200).withColumn("chunk", F.col("chunk").cast("long"))


_H = "h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark)"


def _grams(size: int) -> str:
    return f"SELECT item_id, i, substr(h, 2 * i + 1, {2 * size}) AS g FROM (SELECT item_id, h, unnest(generate_series(0, length(h) // 2 - {size})) AS i FROM h)"


@query("dmer_freq_topk", f"WITH {_H}, g AS ({_grams(8)}) SELECT g, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, g LIMIT 50")
def dmer_freq_topk(spark, sf_dir):
    return M.frequency(table(spark, sf_dir, "benchmark"), "item_id", "text").orderBy(F.desc("n"), "g").limit(50)


_LENGTHS = (3, 4, 5, 6, 8, 12, 16, 24, 32)
_MINED = (
    f"{_H}, u AS ({_grams(8)}), rep AS (SELECT g FROM u GROUP BY 1 HAVING count(*) >= 2), "
    + "k AS ("
    + " UNION ALL ".join(
        f"SELECT g, count(*) AS n, CAST({s} AS BIGINT) AS size FROM ({_grams(s)}) {'WHERE substr(g, 1, 16) IN (SELECT g FROM rep)' if s > 8 else ''} GROUP BY 1 HAVING count(*) >= 2" for s in _LENGTHS
    )
    + "), top AS (SELECT g, n, size, CAST(n * (size - 2) AS BIGINT) AS score FROM k ORDER BY score DESC, size DESC, g LIMIT 64)"
)


@query("mine_patterns_topk", f"WITH {_MINED} SELECT g, n, size, score FROM top")
def mine_patterns_topk(spark, sf_dir):
    return M.patterns(table(spark, sf_dir, "benchmark"), "item_id", "text", 64, _LENGTHS)


@query(
    "dict_longest_match",
    f"WITH {_MINED}, p AS (SELECT g, size, row_number() OVER (ORDER BY score DESC, size DESC, g) - 1 AS pid FROM top), m AS ("
    + " UNION ALL ".join(f"SELECT item_id, i, pid, size FROM ({_grams(s)}) x JOIN p ON p.g = x.g AND p.size = {s}" for s in _LENGTHS)
    + ") SELECT item_id, i, arg_min(pid, -size * 1000 + pid) AS pid, max(size) AS size FROM m GROUP BY 1, 2",
)
def dict_longest_match(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark")
    top = M.patterns(t, "item_id", "text", 64, _LENGTHS)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), F.desc("size"), "g")) - 1  # 64 rows
    pats = top.select(rank.cast("long").alias("pid"), "g")
    return M.longest_matches(t, "item_id", "text", pats)


@query(
    "blob_segment_scores",
    f"WITH {_H}, u AS ({_grams(8)}), n AS (SELECT g, count(*) AS n FROM u GROUP BY 1), s AS (SELECT item_id, k, i, n FROM u JOIN n USING (g), (SELECT unnest(generate_series(0, 63)) AS k) WHERE i >= k * 512 AND i + 8 <= k * 512 + 2048) "
    "SELECT item_id, CAST(k AS BIGINT) AS segment, CAST(sum(n) AS BIGINT) AS score FROM s GROUP BY 1, 2",
)
def blob_segment_scores(spark, sf_dir):
    return M.segment_scores(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(
    "lz_candidates",
    f"WITH {_H}, g AS ({_grams(3)}), r AS (SELECT item_id, g, i, row_number() OVER (PARTITION BY item_id, g ORDER BY i) AS k FROM g), "
    "d AS (SELECT item_id, greatest(128, least(2048, 4194304 // greatest(1, octet_length(encode(text))))) AS depth FROM benchmark) "
    "SELECT a.item_id, a.i, a.i - b.i AS distance, a.k - b.k AS rank FROM r a JOIN r b ON a.item_id = b.item_id AND a.g = b.g AND b.k < a.k JOIN d ON d.item_id = a.item_id WHERE a.k - b.k <= depth",
)
def lz_candidates(spark, sf_dir):
    return M.earlier_matches(table(spark, sf_dir, "benchmark"), "item_id", "text")


_PRICED = (
    "WITH h AS (SELECT lang, c, count(*) AS n FROM (SELECT lang, unnest(string_split(hex(encode(text)), '')) AS c FROM documents) WHERE c <> '' GROUP BY 1, 2), "
    "t AS (SELECT lang, sum(n) AS n FROM h GROUP BY 1), s AS (SELECT h.lang, any_value(t.n) AS halves, ceil(sum(h.n * log2(t.n / h.n)) / 8) AS size FROM h JOIN t USING (lang) GROUP BY 1), "
    "g AS (SELECT lang, 100.0 * (halves / 2.0 - size) / (halves / 2.0) AS gain FROM s) "
)


@query("verdict", _PRICED + "SELECT lang, round(gain, 5) AS gain, CASE WHEN gain >= 3 THEN 'WIN' WHEN gain > 0 THEN 'edge' ELSE 'lose' END AS verdict FROM g")
def verdict(spark, sf_dir):
    """What texts of a language take when their half-bytes are coded by frequency, held against storing them: a win from
    3 percent on, an edge above none."""
    t = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0)
    h = t.select("lang", F.explode(F.split(F.hex(F.col("text").cast("binary")), "")).alias("c")).where("c <> ''").groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))
    s = h.groupBy("lang").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    size, bar = F.ceil((F.col("t") * F.log2("t") - F.col("x")) / 8), F.col("t") / 2
    gain = F.lit(100.0) * (bar - size) / bar
    return s.select("lang", F.round(gain, 5).alias("gain"), F.when(gain >= 3, "WIN").when(gain > 0, "edge").otherwise("lose").alias("verdict"))
