"""The registered queries over the smallest tables, against SQL where there is some."""

import hashlib
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import registry
from strandline.llm.op10_bpe import default_path

from ..compare import duck, same
from . import helpers as H


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), duck(sf_dir, registry.SQL[name]))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1_counts_and_base(spark, sf_dir, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op1_lm_score"](spark, sf_dir).collect()}
    import collections
    import re

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", H.lower(t)) for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c, ends = collections.Counter(), 0
    for i, w in words.items():
        if not held[i]:
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    price = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    assert got.keys() == docs.keys()
    for i, w in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert abs(r.base_score - sum(price(c[x]) for x in w) - price(ends)) < 1e-6 * max(1, abs(r.base_score))
        assert r.score < 0 and math.isfinite(r.score)


def test_op8_against_all_pairs(spark, sf_dir, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op8_jaccard_join"](spark, sf_dir).collect()}
    sets = {i: s for i, t in docs.items() if (s := H.shingles(t))}
    roots, links = H.classes(sets, H.jaccard)
    assert {i: (r.class_id, r.n_links) for i, r in got.items() if i in sets} == {i: (roots[i], links[i]) for i in sets}


def test_op10_against_the_library(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    for r in registry.QUERIES["op10_bpe"](spark, sf_dir).collect():
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _accuracy(spark, sf_dir, name, label):
    got = {r.doc_id: r for r in registry.QUERIES[name](spark, sf_dir).collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    pairs = [(r[label], got[r.doc_id].predicted) for r in known if got[r.doc_id].held_out]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_op3_held_out_accuracy(spark, sf_dir):
    assert _accuracy(spark, sf_dir.replace("sf0.001", "sf0.01"), "op3_quality", "quality") > 0.97


def test_op9_held_out_accuracy(spark, sf_dir):
    assert _accuracy(spark, sf_dir.replace("sf0.001", "sf0.01"), "op9_toxicity", "toxic") > 0.92


def test_pipeline_against_brute_force(spark, sf_dir, docs):
    """Every stage over the last one's rows: the classifier by its own score, the rest by other means."""
    from strandline.llm import op03_quality as Q
    from strandline.llm.op02_secrets import scan

    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Q.fit(Q.with_statistics(d), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id for r in Q.with_score(d, model).collect() if r.score >= 0.3}
    sets = {i: s for i in kept if (s := H.shingles(docs[i]))}
    roots, _ = H.classes(sets, H.jaccard)
    kept = {i for i in kept if roots.get(i, i) == i}
    grams = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = H.words(r.text)
        n = min(10, len(w))
        grams.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)
    sizes = {len(g) for g in grams}

    def clean(text):
        w = H.words(text)
        return not any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))

    kept = {i for i in kept if clean(docs[i])}
    spans = {r.doc_id: r.secrets for r in scan(d).collect()}
    t = Tokenizer.from_file(default_path())
    want = {}
    for i in kept:
        out, at = [], 0
        for s in spans[i]:
            if s.start >= at:
                out += [docs[i][at : s.start], "[SECRET]"]
            at = max(at, s.end)
        want[i] = t.encode("".join([*out, docs[i][at:]]), add_special_tokens=False).ids
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(None, None, None, None, None), (10_001, None, None, None, None), (10_002, "", "en", "x", 0), (10_002, "", "en", "x", 0)], d.schema)
    d = d.unionByName(odd).withColumns({"score": F.lit("s"), "spans": F.lit(1), "Items": F.lit(2), "secrets": F.lit(3), "ids": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.C.written(stage(spark, d, sf_dir), name)
        if name != "encoding":
            assert after.dtypes == d.dtypes and after.count() > 0
            assert stage(spark, d.limit(0), sf_dir).count() == 0
            d = after
        else:
            assert after.columns[: len(d.columns)] == d.columns and after.count() == d.count()
