"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Every item of the benchmark gives its windows of ``size`` successive words (an
item with fewer words is one window). Windows with the items that hold them are
dealt by hash into blocks of at most some ``block_bytes``, each a sorted array of
hashes beside the windows' words, to verify hits by, and the items' ids; a window
that many items share is spread over blocks by item. Blocks are broadcast, at
most ``HELD`` at a time, and a worker opens one at once: it goes through all
documents of an Arrow batch, whose hits are gathered, before the next. Only a
benchmark of more than ``HELD`` blocks makes the documents be written and read
again, once for each further ``HELD`` blocks.

Defined cases: a null or empty text has no words and is clean; an item with no
words gives nothing; an item with a null id still marks words but is not
listed; repeated rows are scanned like others; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW_WORDS = 10
#: Bytes of a block of windows, as a worker holds it; blocks that are broadcast at a time.
BLOCK_BYTES, HELD = 32 << 20, 16
#: What a window costs beside its words: hash, place, size and item.
_ROW = 32
SPAN = T.ArrayType(T.StructType([T.StructField("from_word", T.LongType()), T.StructField("to_word", T.LongType())]))


def _grams_of(size: int, id_col: str, text_col: str):
    schema = pa.schema([("words", pa.int32()), ("gram", pa.binary()), ("item", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, offsets, raw in C.slices(batch, text_col):
                w = C.Words(offsets, raw)
                ids = part.column(id_col).to_pylist()
                found = set()
                for r, item in enumerate(ids):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    n = min(size, b - a)
                    if n:
                        found.update((n, w.text(k, k + n), item) for k in range(a, b - n + 1))
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema=schema)

    return run


def gram_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """One row for each distinct window and item that holds it: words, gram, item."""
    found = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(
        _grams_of(size, "item", "text"), "words int, gram binary, item long"
    )
    return found.distinct()


class Block:
    """Windows and items, looked up by hash and verified by their words: arrays, one after another."""

    def __init__(self, table: pa.Table):
        """From rows of words, gram and item (null: none to list)."""
        table = table.sort_by([("words", "ascending"), ("gram", "ascending")]).combine_chunks()
        words, grams, item = table.column("words").to_numpy(), table.column("gram"), table.column("item")
        new = np.ones(len(table), bool)
        if len(table) > 1:
            new[1:] = (words[1:] != words[:-1]) | pc.not_equal(grams.slice(1), grams.slice(0, len(table) - 1)).to_numpy()
        at = np.flatnonzero(new)
        self.begin, self.known, self.items = np.append(at, len(table)), item.is_valid().to_numpy(), item.fill_null(0).to_numpy()
        words, grams = words[at], grams.take(pa.array(at)).combine_chunks()
        offsets, raw = C.strings(grams.view(pa.string()))
        self.text, self.data = offsets, raw
        hashes = np.empty(len(at), np.uint64)
        for a, b in C.pieces(offsets):
            w = C.Words(offsets[a : b + 1], raw)
            h = w.hashes()
            for n in np.unique(words[a:b]).tolist():
                some = np.flatnonzero(words[a:b] == n)
                hashes[a + some] = C.windows(h, n)[w.first[some]]
        self.by_size = {}
        for n in np.unique(words).tolist():
            some = np.flatnonzero(words == n)
            order = some[np.argsort(hashes[some], kind="stable")]
            self.by_size[n] = (hashes[order], order.astype(np.int32))

    @property
    def nbytes(self) -> int:
        fixed = sum(x.nbytes for x in (self.items, self.known, self.begin, self.data, self.text))
        return fixed + sum(h.nbytes + o.nbytes for h, o in self.by_size.values())

    def hits(self, w: C.Words, hashes: np.ndarray):
        """(first word, words, items) of every verified window, each within one row."""
        for size, (keys, place) in self.by_size.items():
            h = C.windows(hashes, size)
            if not len(h):
                continue
            bits = np.zeros(1 << 20, bool)
            bits[keys >> np.uint64(44)] = True
            maybe = np.flatnonzero(bits[h >> np.uint64(44)])
            maybe = maybe[w.row[maybe] == w.row[maybe + size - 1]]
            at = np.searchsorted(keys, h[maybe])
            ok = at < len(keys)
            maybe, at = maybe[ok], at[ok]
            ok = keys[at] == h[maybe]
            for k, i in zip(maybe[ok].tolist(), at[ok].tolist(), strict=True):
                said = w.text(k, k + size)
                while i < len(keys) and keys[i] == h[k]:
                    g = place[i]
                    if self.data[self.text[g] : self.text[g + 1]].tobytes() == said:
                        a, b = self.begin[g], self.begin[g + 1]
                        yield k, size, self.items[a:b][self.known[a:b]].tolist()
                        break
                    i += 1


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _note(block: Block, at: int, w: C.Words, hashes: np.ndarray, spans: list[list], items: list[set]) -> None:
    """Hits of a block in rows from ``at`` on, added to their spans and items."""
    for k, size, ids in block.hits(w, hashes):
        r = int(w.row[k])
        a = k - int(w.first[r])
        spans[at + r].append((a, a + size))
        items[at + r].update(ids)


def _scan_of(blocks: list, text_col: str, names: tuple[str, str, str], carry: bool):
    n_name, span_name, item_name = names
    span_type = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))

    def run(batches):
        only = Block(_opened(blocks[0])) if len(blocks) == 1 else None
        for batch in batches:
            n = batch.num_rows
            spans: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            count = np.zeros(n, np.int64)
            at = 0
            parts = []
            for part, offsets, raw in C.slices(batch, text_col):
                w = C.Words(offsets, raw)
                count[at : at + part.num_rows] = np.diff(w.first)
                if only:  # part by part: a batch's words take many times its bytes
                    _note(only, at, w, w.hashes(), spans, items)
                else:
                    parts.append((at, w, w.hashes()))
                at += part.num_rows
                del w
            for sent in () if only else blocks:
                block = Block(_opened(sent))
                for held in parts:
                    _note(block, *held, spans, items)
                del block
            del parts
            columns = [batch.column(i) for i in range(batch.num_columns)]
            fields = list(batch.schema.names)
            if carry:
                for r, (s, i) in enumerate(zip(batch.column(span_name).to_pylist(), batch.column(item_name).to_pylist(), strict=True)):
                    spans[r] += [(x["from_word"], x["to_word"]) for x in s]
                    items[r].update(i)
                keep = [k for k, f in enumerate(fields) if f not in names]
                columns, fields = [columns[k] for k in keep], [fields[k] for k in keep]
            columns += [
                pa.array(count, pa.int64()),
                pa.array([[{"from_word": a, "to_word": b} for a, b in _merged(s)] for s in spans], span_type),
                pa.array([sorted(i) for i in items], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*fields, *names])

    return run


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(sent) -> pa.Table:
    """A broadcast block's rows, read from the worker's file each time: the worker keeps none."""
    path = getattr(sent, "_path", None)
    held = sent.load_from_path(path) if path and "_value" not in sent.__dict__ else sent.value
    return pa.ipc.open_stream(pa.py_buffer(held)).read_all()


def scan(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """``docs`` with the number of words, the merged runs of hit words, and the items that occur.

    Names that ``docs`` already has get underscores in front.
    """
    spark = docs.sparkSession
    names = tuple(C.free_name(docs.columns, n) for n in names)
    grams = C.written(gram_table(benchmark, item_col, item_text_col, size), "grams")
    total = grams.agg(F.sum(F.length("gram") + _ROW)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("words", "gram", "item"), F.lit(blocks))
    schema = C.with_fields(docs.schema, (names[0], T.LongType()), (names[1], SPAN), (names[2], T.ArrayType(T.LongType())))
    out = docs
    for first in range(0, blocks, HELD):
        held = [spark.sparkContext.broadcast(_packed(grams.where(block == k).toArrow())) for k in range(first, min(blocks, first + HELD))]
        out = out.mapInArrow(C.tidied(_scan_of(held, text_col, names, first > 0)), schema)
        if first + HELD < blocks:
            out = C.written(out, "hits")
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no benchmark window occurs, their columns as they were."""
    names = tuple(C.free_name(docs.columns, n) for n in ("n_words", "spans", "items"))
    return scan(docs, benchmark, **kw).where(F.size(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **kw) -> DataFrame:
    """All documents, hit words and what stands between two hit words of a run cut from their texts."""
    span_name = C.free_name(docs.columns, "spans")
    found = scan(docs, benchmark, text_col=text_col, **kw)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part, offsets, raw in C.slices(batch, text_col):
                w = C.Words(offsets, raw)
                texts = part.column(text_col).to_pylist()
                for r, s in enumerate(part.column(span_name).to_pylist()):
                    if s:
                        whole, at, out = texts[r].encode(), 0, []
                        for x in s:
                            a = int(w.start[w.first[r] + x["from_word"]] - w.offsets[r])
                            out.append(whole[at:a])
                            at = int(w.end[w.first[r] + x["to_word"] - 1] - w.offsets[r])
                        texts[r] = b"".join([*out, whole[at:]]).decode()
                columns = [pa.array(texts, pa.string()) if f == text_col else part.column(f) for f in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return found.mapInArrow(C.tidied(run), schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of ``scan`` over the whole of ``documents`` and ``benchmark``."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, C.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["to_word"] - s["from_word"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM g),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, g.item_id FROM dw JOIN g ON dw.gram = g.gram AND dw.k = g.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
