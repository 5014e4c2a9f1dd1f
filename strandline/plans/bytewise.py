"""Queries over bytes: kinds, histograms, entropies, models and byte transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import detect
from ..operators import entropy as E
from ..operators import specs as S
from ..registry import query
from ..sources.tables import byte_rows, scaled, table

_B = "b AS (SELECT {key}, unnest(generate_series(0, octet_length(e) - 1)) AS i, e FROM (SELECT {key}, encode({text}) AS e FROM {table})), " "r AS (SELECT {key}, i, CAST(('0x' || hex(e[i + 1:i + 1])) AS BIGINT) AS b FROM b)"


def _bytes_sql(table_: str, key: str, text: str) -> str:
    return _B.format(table=table_, key=key, text=text)


_ITEMS = _bytes_sql("benchmark", "item_id", "text")


def _items(spark, sf_dir):
    return byte_rows(table(spark, sf_dir, "benchmark"), "item_id", "text")


def _stride_sql(s: int) -> str:
    return f"SELECT {s} AS stride, ((b - coalesce(lag(b, {s}) OVER (PARTITION BY item_id ORDER BY i), 0)) % 256 + 256) % 256 AS d FROM r"


@query("byte_delta_stride", f"WITH {_ITEMS}, d AS ({' UNION ALL '.join(map(_stride_sql, (1, 2, 4)))}) SELECT CAST(stride AS BIGINT) AS stride, CAST(d AS BIGINT) AS d, count(*) AS n FROM d GROUP BY 1, 2")
def byte_delta_stride(spark, sf_dir):
    w = Window.partitionBy("item_id").orderBy("i")
    rows = _items(spark, sf_dir)
    d = [F.struct(F.lit(s).cast("long").alias("stride"), F.pmod(F.col("b") - F.coalesce(F.lag("b", s).over(w), F.lit(0)), F.lit(256)).alias("d")) for s in (1, 2, 4)]
    return rows.select(F.array(*d).alias("x")).select(F.explode("x").alias("x")).groupBy("x.stride", "x.d").agg(F.count(F.lit(1)).alias("n"))


@query("byte_delta_roundtrip", f"WITH {_ITEMS} SELECT item_id, CAST(sum(b * ((i % 251) + 1)) AS BIGINT) AS mark, count(*) AS n FROM r GROUP BY 1")
def byte_delta_roundtrip(spark, sf_dir):
    """Bytes less those four before, and back by sums in each lane; a mark of all bytes in their places."""
    w = Window.partitionBy("item_id").orderBy("i")
    d = _items(spark, sf_dir).select("item_id", "i", F.pmod(F.col("b") - F.coalesce(F.lag("b", 4).over(w), F.lit(0)), F.lit(256)).alias("d"))
    lane = Window.partitionBy("item_id", F.pmod("i", F.lit(4))).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = d.select("item_id", "i", F.pmod(F.sum("d").over(lane), F.lit(256)).alias("b"))
    return back.groupBy("item_id").agg(F.sum(F.col("b") * (F.pmod("i", F.lit(251)) + 1)).alias("mark"), F.count(F.lit(1)).alias("n"))


def _planes_sql(n: int) -> str:
    return f"SELECT {n} AS planes, i % {n} AS plane, b FROM r"


@query("byte_split_planes", f"WITH {_ITEMS}, p AS ({' UNION ALL '.join(map(_planes_sql, (2, 4, 8)))}) SELECT CAST(planes AS BIGINT) AS planes, CAST(plane AS BIGINT) AS plane, b, count(*) AS n FROM p GROUP BY 1, 2, 3")
def byte_split_planes(spark, sf_dir):
    p = [F.struct(F.lit(n).cast("long").alias("planes"), F.pmod("i", F.lit(n)).alias("plane")) for n in (2, 4, 8)]
    rows = _items(spark, sf_dir).select("b", F.explode(F.array(*p)).alias("p"))
    return rows.groupBy("p.planes", "p.plane", "b").agg(F.count(F.lit(1)).alias("n"))


@query("byte_split_order", f"WITH {_ITEMS} SELECT item_id, i, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i % 4, i) - 1 AS BIGINT) AS place, b FROM r")
def byte_split_order(spark, sf_dir):
    """Where each byte goes when bytes are gathered plane by plane, by arithmetic on its place alone."""
    rows = _items(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("item_id"))
    lane, row = F.pmod("i", F.lit(4)), F.floor(F.col("i") / 4)
    before = lane * F.floor(n / 4) + F.least(lane, F.pmod(n, F.lit(4)))
    return rows.select("item_id", "i", (before + row).cast("long").alias("place"), "b")


_RATIO = "CASE WHEN octet_length(s) = 0 THEN 0.0 ELSE octet_length(regexp_replace(decode_latin, '[^\\t\\n\\r\\x20-\\x7E]', '', 'g')) END"


@query(
    "printable_ratio",
    f"WITH {_bytes_sql('(SELECT * FROM documents)', 'doc_id', 'text')} SELECT doc_id, round(sum(CASE WHEN b IN (9, 10, 13) OR (b >= 32 AND b < 127) THEN 1 ELSE 0 END) / count(*), 6) AS ratio "
    "FROM r WHERE i < 8192 GROUP BY 1",
)
def printable_ratio(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return t.select("doc_id", F.round(detect.printable_ratio(F.col("text").cast("binary")), 6).alias("ratio"))


def _kind_sql(text: str, key: str, table_: str) -> str:
    words = " + ".join(f"(length(low) - length(replace(low, '{k}', ''))) / {len(k)}" for k in detect.KEYWORDS)
    return f"""
WITH t AS (SELECT {key} AS key, {text} AS t FROM {table_}),
h AS (SELECT key, t, regexp_replace(left(t, 4096), '^[\\t-\\r\\x20]+', '') AS head, list_slice(list_filter(string_split(left(t, 8192), chr(10)), lambda x: x <> ''), 1, 6) AS lines FROM t),
l AS (SELECT key, t, head, lower(head) AS low, left(head, 1) AS f, lines, len(list_filter(lines, lambda x: regexp_matches(x, '{detect.STAMP}'))) AS stamps,
  list_transform(lines, lambda x: length(x) - length(replace(x, ',', ''))) AS commas FROM h)
SELECT key, CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN f IN ('{{', '[') THEN 'text/json'
  WHEN f = '<' AND (contains(low, '<!doctype html') OR contains(low, '<html')) THEN 'text/html' WHEN f = '<' THEN 'text/xml'
  WHEN {words} >= 3 THEN 'text/code' WHEN len(lines) >= 3 AND stamps >= len(lines) // 2 + 1 THEN 'text/log'
  WHEN len(lines) >= 3 AND list_min(commas) = list_max(commas) AND list_min(commas) >= 1 THEN 'text/csv' ELSE 'text/plain' END AS text_kind FROM l"""


def _text_kinds(spark, sf_dir, name, key, text):
    t = table(spark, sf_dir, name)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return t.select(F.col(key).alias("key"), F.when(F.length(raw) == 0, "empty").otherwise(detect.text_kind(raw)).alias("text_kind"))


@query("identify_pages", _kind_sql("html", "page_id", "pages"))
def identify_pages(spark, sf_dir):
    """The text kind of every page, from its first characters."""
    return _text_kinds(spark, sf_dir, "pages", "page_id", "html")


@query("identify_props", _kind_sql("props", "event_id", "events"))
def identify_props(spark, sf_dir):
    return _text_kinds(spark, sf_dir, "events", "event_id", "props")


@query(
    "identify_documents",
    f"WITH {_bytes_sql('documents', 'doc_id', 'text')}, p AS (SELECT doc_id, sum(CASE WHEN b IN (9, 10, 13) OR (b >= 32 AND b < 127) THEN 1 ELSE 0 END) / count(*) AS ratio FROM r WHERE i < 8192 GROUP BY 1), "
    f"k AS ({_kind_sql('text', 'doc_id', 'documents')}) "
    "SELECT CASE WHEN text_kind <> 'empty' AND ratio < 0.9 THEN 'binary/unknown' ELSE text_kind END AS kind, count(*) AS n FROM k LEFT JOIN p ON key = doc_id GROUP BY 1",
)
def identify_documents(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("data"))
    return detect.identify(t, "data").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_SAMPLES = [
    *((m.hex(), "00" * o + m.hex()) for o, m, _, _ in detect.MAGIC),
    ("tiff", "49492A0008000000"), ("cr2", "49492A00100000004352"), ("wav", "524946460000000057415645"), ("json", b'{"a": 1}'.hex()), ("html", b"<!DOCTYPE html><p>".hex()),
    ("xml", b"<?xml version='1.0'?><a/>".hex()), ("code", b"import os\ndef f():\n    return os\n".hex()), ("log", b"2024-01-01 a\n2024-01-02 b\n2024-01-03 c\n".hex()),
    ("csv", b"a,b\n1,2\n3,4\n".hex()), ("blank", b"  \n \n".hex()), ("noise", "0001020304FFFEFD"), ("empty", ""),
]
_EXPECTED = [*(k for _, _, k, _ in detect.MAGIC), "image/tiff", "image/cr2", "audio/wav", "text/json", "text/html", "text/xml", "text/code", "text/log", "text/csv", "text/plain", "binary/unknown", "empty"]


@query("magic_rules", f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{k}{chr(39)})' for (n, _), k in zip(_SAMPLES, _EXPECTED, strict=True))}) AS t(sample, kind)")
def magic_rules(spark, sf_dir):
    """The kinds of literal samples, by the rules; the SQL states what they are."""
    rows = spark.createDataFrame([(n, bytes.fromhex(h)) for n, h in _SAMPLES], "sample string, data binary")
    return detect.identify(rows, "data").select("sample", "kind")


@query(
    "byte_entropy_o0",
    f"WITH {_bytes_sql('(SELECT doc_id, lang, text FROM documents)', 'doc_id', 'text')}, c AS (SELECT lang, b, count(*) AS n FROM r JOIN documents USING (doc_id) GROUP BY 1, 2), "
    "t AS (SELECT lang, sum(n) AS t FROM c GROUP BY 1) SELECT lang, round(-sum(n / t * log2(n / t)), 6) AS bits, CAST(sum(n) AS BIGINT) AS n FROM c JOIN t USING (lang) GROUP BY 1",
)
def byte_entropy_o0(spark, sf_dir):
    hist = E.byte_histogram(table(spark, sf_dir, "documents"), ["lang"], "text")
    return E.entropy(hist, ["lang"], "n")


@query(
    "byte_plane_entropy",
    "WITH x AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders), p AS (SELECT p, (v >> (8 * p)) & 255 AS b FROM x, (SELECT unnest(generate_series(0, 7)) AS p)), "
    "c AS (SELECT p, b, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT p, sum(n) AS t FROM c GROUP BY 1) "
    "SELECT CAST(p AS BIGINT) AS plane, round(abs(sum(n / t * log2(n / t))), 6) AS bits, CAST(sum(n) AS BIGINT) AS n FROM c JOIN t USING (p) GROUP BY 1",
)
def byte_plane_entropy(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(scaled("o_totalprice").alias("v"))
    planes = F.array(*[F.struct(F.lit(p).cast("long").alias("plane"), F.shiftrightunsigned("v", 8 * p).bitwiseAND(F.lit(255)).alias("b")) for p in range(8)])
    hist = x.select(F.explode(planes).alias("p")).groupBy("p.plane", "p.b").agg(F.count(F.lit(1)).alias("n"))
    return E.entropy(hist, ["plane"], "n")


_FREQ = (
    f"{_bytes_sql('documents', 'doc_id', 'text')}, c AS (SELECT b AS sym, count(*) AS n FROM r GROUP BY 1), "
    "q AS (SELECT sym, n, greatest(1, (n * 65536) // (SELECT sum(n) FROM c)) AS freq FROM c)"
)


@query(
    "freq_model",
    f"WITH {_FREQ} SELECT sym, CAST(freq AS BIGINT) AS freq, CAST(sum(freq) OVER (ORDER BY sym) - freq AS BIGINT) AS cum, CAST(sum(freq) OVER () AS BIGINT) AS total FROM q",
)
def freq_model(spark, sf_dir):
    return E.frequency_model(E.byte_histogram(table(spark, sf_dir, "documents"), [], "text"), "b").select("sym", "freq", "cum", "total")


@query(
    "static_price",
    f"WITH {_ITEMS}, c AS (SELECT b AS sym, count(*) AS n FROM r GROUP BY 1), a AS (SELECT sym, coalesce(n, 0) + 1 AS n FROM (SELECT unnest(generate_series(0, 255)) AS sym) LEFT JOIN c USING (sym)), "
    "q AS (SELECT sym, greatest(1, (n * 65536) // (SELECT sum(n) FROM a)) AS freq FROM a), m AS (SELECT sym, log2((SELECT sum(freq) FROM q) / freq) AS cost FROM q), "
    "dd AS (SELECT doc_id, unnest(generate_series(0, octet_length(e) - 1)) AS i, e FROM (SELECT doc_id, encode(text) AS e FROM documents)), "
    "dr AS (SELECT doc_id, CAST(('0x' || hex(e[i + 1:i + 1])) AS BIGINT) AS sym FROM dd) "
    "SELECT doc_id, round(sum(cost), 3) AS bits FROM dr JOIN m USING (sym) GROUP BY 1",
)
def static_price(spark, sf_dir):
    """What documents cost under a byte model of the benchmark in which every byte occurs at least once."""
    hist = E.byte_histogram(table(spark, sf_dir, "benchmark"), [], "text")
    every = spark.range(256).select(F.col("id").alias("b")).join(hist, "b", "left").select("b", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    model = E.frequency_model(every, "b")
    docs = E.byte_histogram(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    priced = docs.join(F.broadcast(model.select(F.col("sym").alias("b"), "freq", "total")), "b")  # 256 rows
    return priced.groupBy("doc_id").agg(F.round(F.sum(F.col("n") * F.log2(F.col("total") / F.col("freq"))), 3).alias("bits"))


@query(
    "content_crc",
    "SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents",
)
def content_crc(spark, sf_dir):
    """Digest and size by which stored content is identified."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n"))


# ------------------------------------------------------------------ chains of steps

_SPEC_NAMES = [S.text(x) for x in S.SPECS]


@query(
    "spec_roundtrip",
    "SELECT item_id, spec, text FROM benchmark, (SELECT unnest([" + ", ".join(f"'{n}'" for n in _SPEC_NAMES) + "]) AS spec)",
)
def spec_roundtrip(spark, sf_dir):
    """Each text through every specification, as the specification's bytes tell it, and back."""
    t = table(spark, sf_dir, "benchmark")

    def run(batches):
        for pdf in batches:
            rows = []
            for k, v in zip(pdf["item_id"], pdf["text"], strict=True):
                for spec in S.SPECS:
                    said = S.to_bytes(spec)
                    out = None if v is None else S.apply(v.encode(), S.from_bytes(said))
                    rows.append((k, S.text(S.from_bytes(said)), None if out is None else S.invert(out, spec).decode()))
            yield pd.DataFrame(rows, columns=["item_id", "spec", "text"])

    return t.select("item_id", "text").mapInPandas(run, "item_id long, spec string, text string")


@query(
    "byte_xor_stride",
    f"WITH {_ITEMS}, x AS (" + " UNION ALL ".join(f"SELECT {n} AS stride, xor(b, coalesce(lag(b, {n}) OVER (PARTITION BY item_id ORDER BY i), 0)) AS d FROM r" for n in (1, 4, 8))
    + ") SELECT CAST(stride AS BIGINT) AS stride, CAST(d AS BIGINT) AS d, count(*) AS n FROM x GROUP BY 1, 2",
)
def byte_xor_stride(spark, sf_dir):
    """Counts of bytes exclusive-or those 1, 4 and 8 before, counted where the text is."""
    t = table(spark, sf_dir, "benchmark")

    def run(batches):
        for pdf in batches:
            rows = []
            for v in pdf["text"].dropna():
                for stride in (1, 4, 8):
                    n = np.bincount(np.frombuffer(S.xor(v.encode(), stride), np.uint8), minlength=256)
                    rows += [(stride, int(b), int(n[b])) for b in np.flatnonzero(n)]
            yield pd.DataFrame(rows, columns=["stride", "d", "n"])

    return t.select("text").mapInPandas(run, "stride long, d long, n long").groupBy("stride", "d").agg(F.sum("n").alias("n"))


@query("transform_select")
def transform_select(spark, sf_dir):
    """For prices as 64-bit words, texts and pages: the specification under which all blocks together pack best.

    Blocks of a source are packed where they are; a source's sizes are sums of 13 numbers.
    """
    o = table(spark, sf_dir, "orders").select(F.lit("prices").alias("source"), F.pmod(F.xxhash64("o_orderkey"), F.lit(64)).alias("part"), F.col("o_orderkey").alias("k"), scaled("o_totalprice").alias("v"))
    words = o.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x")).select("source", F.transform("x", lambda x: x["v"]).alias("words"), F.lit(None).cast("binary").alias("data"))
    texts = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.lit(None).cast("array<long>").alias("words"), F.col("text").cast("binary").alias("data"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.lit(None).cast("array<long>").alias("words"), F.col("html").cast("binary").alias("data"))

    def run(batches):
        for pdf in batches:
            rows = []
            for source, w, d in zip(pdf["source"], pdf["words"], pdf["data"], strict=True):
                data = np.array(w, "<i8").tobytes() if w is not None else bytes(d) if d is not None else b""
                rows += [(source, k, size) for k, size in enumerate(S.packed_sizes(data))]
            yield pd.DataFrame(rows, columns=["source", "k", "size"])

    sizes = words.unionByName(texts).unionByName(pages).mapInPandas(run, "source string, k long, size long").groupBy("source", "k").agg(F.sum("size").alias("size"))
    best = sizes.groupBy("source").agg(F.min(F.struct("size", "k")).alias("best"))
    names = F.array(*[F.lit(n) for n in _SPEC_NAMES])
    return best.select("source", F.element_at(names, (F.col("best.k") + 1).cast("int")).alias("spec"), F.col("best.size").alias("size"))


# ------------------------------------------------------------------ numbers in base 128

@query(
    "varint_bytes",
    "WITH RECURSIVE v AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders), "
    "w AS (SELECT o_orderkey, v, '' AS h FROM v UNION ALL SELECT o_orderkey, v // 128 AS v, h || printf('%02X', CASE WHEN v >= 128 THEN v % 128 + 128 ELSE v END) FROM w WHERE v > 0) "
    "SELECT o_orderkey, CASE WHEN h = '' THEN '00' ELSE h END AS h FROM w WHERE v = 0",
)
def varint_bytes(spark, sf_dir):
    """Amounts as bytes of seven bits, low ones first, the high bit telling that more follow."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", scaled("o_totalprice").alias("v"))
    return t.select("o_orderkey", F.hex(bits.varint(F.col("v"))).alias("h"))


@query("varint_roundtrip", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders")
def varint_roundtrip(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", bits.varint(scaled("o_totalprice")).alias("b"))
    return t.select("o_orderkey", bits.unvarint(F.col("b")).alias("v"))
