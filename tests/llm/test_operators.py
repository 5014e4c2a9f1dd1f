"""Small fixtures: odd rows, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline
from strandline.llm import common as C
from strandline.llm import op01_lm, op02_secrets, op03_quality, op04_chat, op05_warc, op06_decontaminate, op07_vectors, op08_jaccard, op09_toxicity, op10_bpe
from strandline.llm.graph import components

from . import helpers as H

DOC = "doc_id long, text string"


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def _some(n=40, seed=1):
    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "éta", "the", "of", "and", "to"]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) + ".") for i in range(n)]


ODD = [(1001, None), (1002, ""), (1003, " \n\t "), (1004, "x" * 200_000), (1005, "word " * 30_000), (1006, "tie"), (1007, "tie"), (1006, "tie"), (None, "tie")]


# ------------------------------------------------------------------ shared parts

def test_words_and_hashes_do_not_depend_on_slices():
    texts = ["Ab c,d", "", "éÉ 9z--Q", "a b", "b a"]
    whole = C.Words(*C.strings(pa.array(texts)))
    assert [[whole.text(k, k + 1).decode() for k in range(whole.first[r], whole.first[r + 1])] for r in range(5)] == [["ab", "c", "d"], [], ["éÉ", "9z", "q"], ["a", "b"], ["b", "a"]]
    one = {}
    for t in texts:
        w = C.Words(*C.strings(pa.array([t])))
        one.update({w.text(k, k + 1): h for k, h in enumerate(w.hashes().tolist())})
    assert [one[whole.text(k, k + 1)] for k in range(len(whole.start))] == whole.hashes().tolist()
    sliced = pa.array(["zz", *texts]).slice(1)
    assert C.Words(*C.strings(sliced)).hashes().tolist() == whole.hashes().tolist()


def test_words_of_a_text_of_50_mb_take_bounded_memory():
    import tracemalloc

    raw = np.frombuffer(b"some words Of one long text, " * 1_700_000, np.uint8)
    tracemalloc.start()
    w = C.Words(np.array([0, len(raw)]), raw)
    h = w.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == 6 * 1_700_000 and len(np.unique(h)) == 6 and peak < 14 * len(raw)
    long = np.frombuffer(b"x" * 3_000_000 + b" y", np.uint8)
    assert len(np.unique(C.Words(np.array([0, len(long)]), long).hashes())) == 2


def test_join_hot_keeps_every_row(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit("hot")).when(F.col("id") < 2100, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("2500", 2)], "k string, v int")
    for how in ("inner", "left"):
        assert sorted(map(str, C.join_hot(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 900 + k) for k in range(1, 400)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    items = {i: i for p in pairs for i in p if i is not None and p[0] is not None and p[0] != p[1]}
    near = {frozenset(p) for p in pairs}
    roots, _ = H.classes(items, lambda a, b: frozenset((a, b)) in near)
    assert got == roots
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1

def test_lm_odd_rows_and_brute_force_attention(spark):
    docs = _docs(spark, _some(60) + ODD)
    held = op03_quality.in_fold(F.col("doc_id"), 10)
    model = op01_lm.fit(docs, ~held)
    rows = op01_lm.score(docs, model).collect()
    assert len(rows) == 69 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1001, 1002, 1003)} == {1}
    assert {r.n_tokens for r in rows if r.doc_id == 1005} == {30_001}
    empty = docs.limit(0)
    assert op01_lm.score(empty, model).count() == 0
    nothing = op01_lm.fit(empty, F.lit(True))
    assert all(math.isfinite(r.score) for r in op01_lm.score(docs, nothing).collect())
    # overlapping windows against one query at a time
    size, rng = 200, np.random.default_rng(0)
    w = op01_lm.Attention.fresh(size, op01_lm.CLASSES)
    classes = rng.integers(0, op01_lm.CLASSES, size + 1)
    prior = np.log(rng.dirichlet(np.ones(op01_lm.CLASSES), size + 1)).astype(np.float32)
    m = op01_lm.Model.__new__(op01_lm.Model)
    m.attention, m.end = op01_lm.Attention(w, prior, classes), size
    row, source, target = np.sort(rng.integers(0, 20, 400)), rng.integers(0, size, 400), rng.integers(0, size, 400)
    got = m.attended(source, target, np.zeros(400, np.float32), row) + prior[source, classes[target]]
    for i in range(400):
        js = [j for j in range(max(0, i // 16 * 16 - 16), i + 1) if row[j] == row[i]]
        s = np.array([w["q"][source[i]] @ w["k"][source[j]] / 4 + w["bias"][i - j] for j in js])
        a = np.exp(s - s.max())
        logits = (a / a.sum()) @ w["v"][source[js]] @ w["w"] + w["e"][source[i]] @ w["w"] + prior[source[i]]
        assert abs(got[i] - logits[classes[target[i]]] + np.log(np.exp(logits).sum())) < 1e-4


def test_lm_trains_on_every_word_at_every_size(spark, monkeypatch):
    """All words of a corpus of over 5 million characters are in runs, and all pieces of a run are targets once."""
    text = " ".join(f"w{k % 1000}" for k in range(30_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([text] * 40)], ["doc_id", "text"])
    assert len(text) * 40 > 5_000_000
    rows = pa.Table.from_batches(list(op01_lm._gather()([batch]))).to_pylist()
    runs = [r for r in rows if r["kind"] == 1]
    assert " ".join(r["s"] for r in runs[: 30_000 // op01_lm.RUN]) == text and sum(len(r["s"].split(" ")) for r in runs) == 40 * 30_000
    assert sum(r["n"] & 1 for r in runs) == sum(r["n"] >> 1 for r in runs) == 40
    said = op01_lm.load_ranks(op01_lm.default_path())
    size, none = len(said[1]), np.zeros(0, np.int64)
    m = op01_lm.Model(said, op01_lm.Ngrams(size, none, none, none, none, np.ones(size + 1)), None, (0.5, 0.5))
    long = [" ".join(["deadbeef" * 40] * 12), "a b c"]
    x, t, *_ = op01_lm.windows_of(m, long, np.array([3, 0]))
    ids = [m.pieces.words(r.split(" "))[0].tolist() for r in long]
    want = ids[0] + [m.end] + ids[1][1:]  # the first run is a whole text; the other's begin and end are not
    assert len(ids[0]) > 64 and t[t >= 0].tolist() == want
    assert x[1, 0] == ids[0][31] and (t >= 0).sum(axis=1)[0] == 32
    # portions and sums of trainers
    monkeypatch.setattr(op01_lm, "PORTION", 20)
    monkeypatch.setattr(op01_lm, "LONG", 2)
    monkeypatch.setattr(op01_lm, "TRAINERS", 3)
    docs = _docs(spark, _some(60))
    model = op01_lm.fit(docs, F.lit(True))
    assert all(math.isfinite(r.score) and r.score < 0 for r in op01_lm.score(docs, model).collect())


def test_lm_prices_are_exact_where_trigrams_are_not_broadcast(spark, monkeypatch):
    docs = _docs(spark, _some(80) + ODD + [(2000 + k, f"{hashlib.sha1(bytes([k])).hexdigest()} {'aqz' * k} {k}") for k in range(40)])
    held = op03_quality.in_fold(F.col("doc_id"), 10)
    whole = op01_lm.fit(docs, ~held)
    monkeypatch.setattr(op01_lm, "HEAD", 20)
    monkeypatch.setattr(op01_lm, "TRIGRAMS", 50)
    model = op01_lm.fit(docs, ~held)
    assert whole["priced"] is None and whole["shares"] == model["shares"]
    a, b = (op01_lm.Model(m["said"], op01_lm.Ngrams(len(m["said"][1]), *m["ngrams"]), None, (0.5, 0.5)) for m in (whole, model))
    words, three = model["priced"].head.value
    prices = [(words.to_pylist(), three)]
    rows = model["priced"].joined(docs.withColumn("row", F.monotonically_increasing_id()), "text").collect()
    prices += [([o.w], [np.array(o.a), np.array(o.b)]) for r in rows for o in r.others or ()]
    assert len(words) <= 20 and {w for some, _ in prices for w in some} == {w for r in rows for w in (r.text or "").lower().split()}
    for some, three in prices:  # seen in training or not
        assert all(np.allclose(x, y, rtol=1e-6) for x, y in zip(a.lexicon(some), b.lexicon(some, three), strict=True)), some
    # scores; a window's begin depends on the order of rows
    x, y = ({r.doc_id: r for r in op01_lm.score(docs, m).where("doc_id < 1000 OR doc_id >= 2000").collect()} for m in (whole, model))
    assert len(x) == 120 and x.keys() == y.keys()
    assert all(x[k][1:3] == y[k][1:3] and math.isclose(x[k].base_score, y[k].base_score, rel_tol=1e-9) and math.isclose(x[k].score, y[k].score, rel_tol=0.05) for k in x)


def test_lm_is_a_distribution():
    """Over all that may follow a piece the model's parts sum to 1."""
    rng = np.random.default_rng(1)
    size, keys = 50, []
    for _ in range(400):
        x, y, z = (int(v) for v in rng.integers(0, size + 1, 3))
        keys.append((x * (size + 1) + min(y, size - 1)) * (size + 1) + z)
    tri, n = np.unique(keys, return_counts=True)
    bi, at = np.unique(tri % ((size + 1) ** 2), return_inverse=True)
    grams = op01_lm.Ngrams(size, tri, n, bi, np.bincount(at, weights=n).astype(np.int64), rng.integers(1, 9, size + 1))
    z = np.arange(size + 1)
    for x, y in ((3, 4), (size, 7), (9, 9)):
        assert abs(np.exp(grams.logs(np.full(size + 1, x), np.full(size + 1, y), z)[0]).sum() - 1) < 1e-6
    assert np.allclose(grams.bigrams().sum(axis=1), 1, atol=1e-4) and abs(np.exp(grams.first).sum() - 1) < 1e-6


def test_lm_training_takes_no_time_for_padding(monkeypatch):
    """What comes after the last target of a batch is left out, and changes nothing but rounding."""
    rng, size, n = np.random.default_rng(4), 50, 96
    x, t = rng.integers(0, size, (n, 32)), rng.integers(0, size + 1, (n, 32))
    out = np.arange(32) >= rng.integers(3, 12, n)[:, None]
    x[out], t[out] = size, -1
    prior = np.log(rng.dirichlet(np.ones(op01_lm.CLASSES), size + 1)).astype(np.float32)
    told = [-rng.random((n, 32)), -rng.random((n, 32)), rng.random((n, 32)) < 0.5]
    weights, classes = op01_lm.Attention.fresh(size, op01_lm.CLASSES), rng.integers(0, op01_lm.CLASSES, size + 1)
    plain, widths = op01_lm.Attention.forward, []

    def forward(self, *args):
        widths.append(args[0].shape[1])
        return plain(self, *args)

    monkeypatch.setattr(op01_lm.Attention, "forward", forward)
    new, loss, shares = op01_lm.train(weights, prior, classes, x, t, 3, 0.03, told)
    assert len(widths) == 2 and max(widths) <= 11
    t[0, 31], told[1][0, 31] = 0, 0  # one target at the end: its batch is as wide as it was, the other one isn't
    op01_lm.train(weights, prior, classes, x, t, 3, 0.03, told)
    assert sorted(widths[2:])[1] == 32 and sorted(widths[2:])[0] <= 11
    t[0, 31] = -1
    wide = [np.pad(a, ((0, 0), (0, 32)), constant_values=c) for a, c in ((x, size), (t, -1), *((a, 0) for a in told))]
    other, also, both = op01_lm.train(weights, prior, classes, *wide[:2], 3, 0.03, wide[2:])
    assert all(np.allclose(new[k], other[k], atol=1e-5) for k in new) and math.isclose(loss, also, rel_tol=1e-6) and np.allclose(shares, both)


class _Sent:
    def __init__(self, value):
        self.value = value


def test_lm_training_prices_frequent_words_once(monkeypatch):
    """Portions of runs take frequent words from a worker's lexicon, with the same windows."""
    said, rng = op01_lm.load_ranks(op01_lm.default_path()), np.random.default_rng(2)
    size, none = len(said[1]), np.zeros(0, np.int64)
    shared = {"key": "once", "said": said, "ngrams": (none, none, none, none, np.ones(size + 1)), "classes": rng.integers(0, op01_lm.CLASSES, size + 1), "prior": np.zeros((size + 1, op01_lm.CLASSES), np.float32)}
    words, asked, plain = [f"w{k}" for k in range(30)], [], op01_lm.Model.lexicon
    runs = [" ".join([*words[k % 3 :: 3], f"rare{k}"]) for k in range(40)] + [""]
    monkeypatch.setattr(op01_lm, "PORTION", 10)
    monkeypatch.setattr(op01_lm.Model, "lexicon", lambda self, some, three=None: asked.extend(some) or plain(self, some, three))
    batch = pa.RecordBatch.from_arrays([pa.array(runs), pa.array([0] * 40 + [3])], ["s", "n"])
    head = (pa.array(words), None)
    told = list(op01_lm._trainer_of(_Sent(shared), op01_lm.Attention.fresh(size, op01_lm.CLASSES), _Sent(head), 0, 0.01)([batch]))
    assert told[0].column("n")[0].as_py() > 400 and all(asked.count(w) == 1 for w in words) and {f"rare{k}" for k in range(40)} <= set(asked)
    m = op01_lm._model(shared)
    lexicon = op01_lm.Lexicon(m, *head)
    pairs = zip(op01_lm.windows_of(m, runs, np.arange(41) % 4), op01_lm.windows_of(m, runs, np.arange(41) % 4, lexicon=lambda w: lexicon(w, None)[0]), strict=True)
    assert all(np.array_equal(a, b) for a, b in pairs)


@pytest.mark.parametrize("factor", [1, 40])
def test_lm_training_against_brute_force(factor):
    """Loss and first step of a batch, also where scores are too large for plain exponentials."""
    rng, size, many = np.random.default_rng(6), 30, 8
    x, t = rng.integers(0, size + 1, (5, 9)), rng.integers(0, size + 1, (5, 9))
    t[rng.random(t.shape) < 0.2] = -1
    classes, prior = rng.integers(0, many, size + 1), np.log(rng.dirichlet(np.ones(many), size + 1)).astype(np.float32)
    w = op01_lm.Attention.fresh(size, many)
    w["q"], w["k"] = w["q"] * np.float32(factor), w["k"] * np.float32(factor)

    def loss(w):
        total = 0.0
        for row, goals in zip(x, t, strict=True):
            for i in np.flatnonzero(goals >= 0):
                s = np.array([w["q"][row[i]] @ w["k"][row[j]] / 4 + w["bias"][i - j] for j in range(i + 1)])
                a = np.exp(s - s.max())
                p = (a / a.sum() @ w["v"][row[: i + 1]] + w["e"][row[i]]) @ w["w"] + prior[row[i]]
                total -= p[classes[goals[i]]] - p.max() - np.log(np.exp(p - p.max()).sum())
        return total

    new, got, _ = op01_lm.train(w, prior, classes, x, t, 1, 0.03)
    exact = {k: v.astype(np.float64) for k, v in w.items()}
    assert math.isclose(got, loss(exact), rel_tol=1e-5)
    seen = 0
    for name, v in exact.items():
        for at in rng.choice(v.size, min(v.size, 40), replace=False):
            old, both = v.flat[at], []
            for d in (1e-5, -1e-5):
                v.flat[at] = old + d
                both.append(loss(exact))
            v.flat[at] = old
            slope = (both[0] - both[1]) / 2e-5
            if abs(slope) > 1e-3:  # the first step of Adam has the size of the rate
                seen += 1
                assert math.isclose(new[name].flat[at] - w[name].flat[at], -0.03 * np.sign(slope), rel_tol=1e-2), (name, at)
    assert seen > 60
    rows, begin = rng.standard_normal((200, 8)).astype(np.float32), np.unique(np.concatenate([[0, 3, 4, 90, 199], rng.integers(0, 200, 40)]))
    assert np.allclose(op01_lm._summed_rows(rows, begin), np.add.reduceat(rows, begin, axis=0), atol=1e-5)


# ------------------------------------------------------------------ 2

def test_trigram_queries_are_necessary():
    r = random.Random(5)
    samples = {
        "assign": ["PassWord = 'abcdef1'", "api_key:\"zzzzzz\"", "APIKEY=abcdefgh", "token: aaaaaaa", "Secret=qqqqqq", "passwd  = zzzzzz9"],
        "access": ["AKIA" + "A1" * 8], "github": [f"gh{c}_" + "aB3" * 12 for c in "pousr"], "slack": [f"xox{c}-" + "a1" * 6 for c in "abprs"],
        "google": ["AIza" + "x" * 35], "jwt": ["eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9], "pem": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
        "stripe": ["sk_live_" + "a" * 24, "rk_live_" + "b" * 24], "hex": ["0f" * 12],
    }
    import re

    for rule in op02_secrets.RULES:
        query = op02_secrets.trigram_query(rule.regex)
        assert bool(query) == (rule.kind != "hex")
        for s in samples[rule.kind]:
            text = "".join(r.choice("abc ") for _ in range(9)) + s
            assert re.search(rule.regex, text)
            assert all(any(all(t in text.lower() for t in a) for a in either) for either in query), (rule.kind, s)


def test_secrets_exact_and_odd_rows(spark):
    rows = [(1, "é secret=token:abcdefgh AKIA" + "Z" * 16 + " ghp_" + "a" * 40), (2, "password=abc password=abcdef"), (3, "0123456789abcdef01234567"), *ODD, (None, "token=abcdef12")]
    docs = _docs(spark, rows).withColumn("kinds", F.lit(1)).withColumn("Secrets", F.lit(2))
    found = op02_secrets.scan(docs)
    assert found.columns[:4] == ["doc_id", "text", "kinds", "Secrets"] and len(found.columns) == 5
    name = found.columns[-1]
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r[name]]) for r in found.collect() if r[name]]
    assert sorted(got, key=str) == sorted(
        [(1, [("access", 24, 44), ("github", 45, 89), ("hex", 49, 89)]), (2, [("assign", 13, 28)]), (3, [("hex", 0, 24)]), (None, [("assign", 0, 14)])], key=str
    )
    clean = {r.doc_id: r.text for r in op02_secrets.redacted(docs).collect() if r.doc_id in (1, 2, 1001)}
    assert clean == {1: "é secret=token:abcdefgh [SECRET] [SECRET]", 2: "password=abc [SECRET]", 1001: None}
    assert op02_secrets.scan(docs.limit(0)).count() == 0
    plan = op02_secrets.redacted(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ 3 and 9

def test_classifiers_odd_rows(spark):
    good = [(i, t.capitalize()) for i, t in _some(80)]
    bad = [(200 + i, " ".join(w + "###" for w in t.split())) for i, t in _some(80, 2)]
    toxic = [(400 + i, t + " you moron") for i, t in _some(60, 3)]
    docs = _docs(spark, good + bad + toxic + ODD).withColumn("Score", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(i, 1, 1) for i, _ in toxic] + [(i, None, None) for i in range(5)] + [(None, 1, 1), (1, 7, 7)], "doc_id long, quality int, toxic int")
    model = op03_quality.fit(op03_quality.with_statistics(docs), labels)
    rows = op03_quality.with_score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["_score"] <= 1 and r["Score"] == "mine" for r in rows)
    assert all((r["_score"] >= 0.3) == (r.doc_id < 200 or r.doc_id >= 400) for r in rows if r.doc_id is not None and r.doc_id < 460)
    assert op03_quality.without_rejected(docs, labels.limit(0)).columns == docs.columns
    assert op03_quality.without_rejected(docs.limit(0), labels).count() == 0
    model = op09_toxicity.fit(docs, labels)
    rows = op09_toxicity.with_score(docs, model).collect()
    assert all((r["_score"] >= 0.5) == (r.doc_id >= 400) for r in rows if r.doc_id is not None and r.doc_id < 460)
    hidden = ["a M0R0N here", "m o r o n", "m.o.r.o.n", "mooooron", "clean words", "m0ron!", "mmoorroonn", "you are a m o r o n", "mo.ron", "m0ron" + "!" * 60, " ".join("alphabetamoronandgammadeltaomegasigmakappabetamoron")]
    got = [r["score"] >= 0.5 for r in op09_toxicity.with_score(_docs(spark, list(enumerate(hidden))).coalesce(1), model).orderBy("doc_id").collect()]
    assert got == [True, True, True, True, False, True, True, True, True, True, True]
    assert op09_toxicity.with_score(docs.limit(0), op09_toxicity.fit(docs.limit(0), labels)).count() == 0


def test_restorer_reads_disguises():
    text = " ".join(["idiot stupid moron trash pathetic worthless loser clown scum disgusting the of and people letter"] * 20)
    w = C.Words(*C.strings(pa.array([text])))
    total = np.zeros(op09_toxicity._SYMBOLS**3)
    for b in op09_toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])]):
        total[np.array(b.column("code"))] = np.array(b.column("n"))
    assert total.sum() == sum(len(x) + 1 for x in H.words(text)) and len(w.start)
    n = total.reshape((op09_toxicity._SYMBOLS,) * 3)
    costs = -np.log((n + 0.1) / (n.sum(2, keepdims=True) + 3))
    r = op09_toxicity.Restorer(costs)
    for seen, meant in {"1d10t": "idiot", "$tup1d": "stupid", "m0r0n": "moron", "tr4sh": "trash", "p4th3t1c": "pathetic", "l0s3r": "loser", "scuuuum": "scum", "lettttter": "letter", "m o r o n": "moron", "mo.ron": "moron", "stu-pid": "stupid", "l.0.s.3.r": "loser"}.items():
        assert r.best(seen) == meant
    spelled = " ".join("the stupid people and the idiot of the disgusting clown letter".replace(" ", ""))
    assert r.best(spelled).split() == "the stupid people and the idiot of the disgusting clown letter".split()
    long = "1d10t " + "x" * 60 + "1y " + " ".join("themoronandtheidiot" * 10) + " m0r0n" + "!" * 60
    w = C.Words(*C.strings(pa.array([long])))
    found = [r.word(x) for _, x in op09_toxicity.disguised(w.offsets, w.data)]
    assert found[0] == b"idiot" and b"moron" in found and len(found) == 4 and max(x.split().count(b"moron") for x in found) == 10


# ------------------------------------------------------------------ 4

def test_chat_snapshots(spark):
    turn = lambda c, i, t: (c, i, "user" if i % 2 == 0 else "assistant", t)
    rows = [turn(1, i, f"t{i}") for i in range(3)] + [turn(2, i, f"t{i}") for i in range(5)] + [turn(3, i, f"t{i}") for i in range(5)] + [turn(4, i, f"t{i}") for i in (0, 1)]
    rows += [turn(5, 0, "t0"), turn(5, 1, "other"), turn(5, 1, "other"), (6, None, None, None), (None, 1, "user", "x"), (7, 0, "user", "<|im_end|>")]
    rows += [turn(8, i, f"long{i}") for i in range(1300)] + [turn(9, i, f"long{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(1))
    got = op04_chat.render(df).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(2, 0, 5), (5, 0, 2), (6, 0, 1), (7, 0, 1), (8, 0, 1300), (8, 1, 1300), (8, 2, 1300)]
    assert got[1].rendered == "<|im_start|>user\nt0<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert got[3].rendered == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    whole = "".join(r.rendered for r in got if r.conv_id == 8)
    assert whole.count("<|im_start|>") == 1300 and whole.index("long511<") < whole.index("long512<")
    assert op04_chat.render(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 5

def _record(k, text):
    p = text.encode()
    return op05_warc.record(k, f"http://x/{k}", p, op05_warc._digest(p), "response", None)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [_record(k, f"<p>{k}</p>" * 40) for k in range(12)]
    parts = [op05_warc.member(r) + op05_warc._EMPTY if packed else r for r in records]
    whole = b"".join(parts)
    assert [x[0] for x in op05_warc.salvage(whole)] == ["record"] * 12
    at = sum(map(len, parts[:4])) + len(parts[4]) // 2
    damaged = whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]
    torn = damaged[: sum(map(len, parts[:9]))] + b"noise" + damaged[sum(map(len, parts[:9])) : -9]
    out = list(op05_warc.salvage(torn))
    pages = [int(x[3]["warc-record-id"][10:-1]) for x in out if x[0] == "record"]
    assert set(pages) >= {0, 1, 2, 3, 5, 6, 7, 8, 9, 10} and 4 not in pages
    gaps = [(x[1], x[2]) for x in out if x[0] == "gap"]
    assert len(gaps) >= 2 and gaps[0][0] == sum(map(len, parts[:4])) and all(a < b for a, b in gaps)
    assert list(op05_warc.salvage(b"")) == [] and [x[0] for x in op05_warc.salvage(b"nothing here")] == ["gap"]


def test_salvage_keeps_long_urls_and_good_records_of_damaged_members():
    pages = lambda out: [int(x[3]["warc-record-id"][10:-1]) for x in out if x[0] == "record"]
    long = op05_warc.record(1, "data:" + "a" * 200_000, b"x", op05_warc._digest(b"x"), "response", None)
    for data in (long, op05_warc.member(long)):
        assert [x[0] for x in op05_warc.salvage(data)] == ["record"]
    r = random.Random(3)
    records = [_record(k, "".join(r.choices("abcdefghijklmnop", k=30_000))) for k in range(12)]
    wrong = [x if k != 5 else x.replace(b"sha1:", b"sha1:X") for k, x in enumerate(records)]
    out = list(op05_warc.salvage(op05_warc.member(b"".join(wrong))))  # one bad record in a good member
    assert pages(out) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11] and [x[0] for x in out].count("gap") == 1
    whole = op05_warc.member(b"".join(records))
    out = list(op05_warc.salvage(whole[: len(whole) * 3 // 4] + op05_warc.member(records[3])))  # a torn one, then a good one
    assert pages(out)[:8] == list(range(8)) and pages(out)[-1] == 3 and any(x[0] == "gap" for x in out)
    out = list(op05_warc.salvage(whole[:-8] + bytes(8)))  # only the check at the end is wrong
    assert pages(out) == list(range(12)) and out[-1][0] == "gap"


def test_salvage_goes_through_noise_once():
    import time

    good = _record(7, "kept")
    noise = random.Random(5).randbytes(4_000_000)
    for junk in (noise * 5, b"WARC/1." * 1_000_000, b"WARC/1.1\r\nA: b\r\n" * 300_000, b"\x1f\x8b\x08" * 200_000, b"WARC/1.1\r\n" * 500_000):
        began = time.time()
        out = list(op05_warc.salvage(good + junk + b"\r\n\r\n" + op05_warc.member(good) + junk))
        assert [x[0] for x in out] == ["record", "gap", "record", "gap"] and time.time() - began < 30
    three = [_record(k, "x" * 50) for k in range(3)]
    for packed in (False, True):
        data = b"".join([three[0], three[1].replace(b"xx", b"yy"), three[2]])
        out = list(op05_warc.salvage(op05_warc.member(data) if packed else data))
        assert [int(x[3]["warc-record-id"][10:-1]) for x in out if x[0] == "record"] == [0, 2] and [x[0] for x in out].count("gap") == 1
    fifty = op05_warc.member(b"".join(_record(k, f"page {k} " * 40) for k in range(50)))
    out = list(op05_warc.salvage(fifty[:-20]))
    assert len([x for x in out if x[0] == "record"]) >= 45 and out[-1][0] == "gap"


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op05_warc, "ARCHIVE_BYTES", 2_000)  # in this process: the writer's own function
    r = random.Random(8)
    batch = pa.table({
        "page_id": range(20), "url": ["u"] * 20, "payload": pa.array([r.randbytes(900) for _ in range(20)], pa.binary()),
        "payload_digest": ["d"] * 20, "record_type": ["response"] * 20, "refers_to": pa.array([None] * 20, pa.int64()),
    }).to_batches()
    sizes = {}
    for out in op05_warc._members(batch):
        for value, archive in zip(out.column("value").to_pylist(), out.column("archive").to_pylist(), strict=True):
            sizes[archive] = sizes.get(archive, 0) + len(value)
    assert len(sizes) > 5 and max(sizes.values()) <= 2_600


def test_archives_on_a_file_system(spark, tmp_path):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c\r\nd", None), (4, "", ""), (5, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (5, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "w")
    op05_warc.write_archives(op05_warc.typed(pages), path)
    back = op05_warc.read_archives(spark, path).collect()
    assert all(r.gap is None for r in back) and len(back) == 7
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in back), key=str)
    assert got == sorted([(0, "response", None, 9), (1, "response", None, 9), (2, "revisit", 1, 9), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 300_000), (5, "response", None, 300_000)], key=str)
    want = {r.page_id: base for r in back for base in [op05_warc._digest(b"<p>\xc3\xa9</p>")] if r.page_id in (1, 2)}
    assert all(r.payload_digest == want[r.page_id] for r in back if r.page_id in want)
    none = str(tmp_path / "none")
    op05_warc.write_archives(op05_warc.typed(pages.limit(0)), none)
    assert op05_warc.read_archives(spark, none).count() == 0
    file = next(tmp_path.glob("w/*/part-*"))
    file.write_bytes(file.read_bytes()[5:] + b"junk")
    file.with_name(f".{file.name}.crc").unlink()  # the local file system's own check
    assert op05_warc.read_archives(spark, path).where("gap IS NOT NULL").count() >= 1
    least = op05_warc.typed(pages, least=5).where("page_id = 4").first()
    assert (least.record_type, least.refers_to) == ("response", None)


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontamination", "encoding"])
def test_pipeline_stage_needs_one_worker_a_task(spark, sf_dir, monkeypatch, stage):
    """Two Python functions one after another in a Spark stage would take two workers for each task, which then stay."""
    plain, plans = DataFrame.mapInArrow, []

    def seen(self, *args, **kw):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *args, **kw)

    monkeypatch.setattr(DataFrame, "mapInArrow", seen)
    dict(corpus_pipeline.STAGES)[stage](spark, C.table(spark, sf_dir, "documents"), sf_dir)
    assert plans
    for plan in plans:
        upto = plan.split("Exchange hash")[0]  # what comes below an exchange by hash is a stage of its own
        assert "InArrow" not in upto and "ArrowInPython" not in upto


# ------------------------------------------------------------------ 6

def test_decontamination_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate((25, 10, 12, 3, 1, 40))] + [(6, None), (7, "!!"), (None, "null id words"), (1, "second text of item one")]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(80))) for i in range(20)] + [(100, "X " + items[0][1].upper() + " y"), (101, items[3][1]), (102, "a null id, words b"), *ODD]
    df = _docs(spark, docs).withColumn("spans", F.lit("mine")).withColumn("N_WORDS", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for item, text in items:
        w = H.words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(item)
    for most, held in ((1 << 20, 16), (800, 16), (800, 3)):  # one block; many, at once and not
        monkeypatch.setattr(op06_decontaminate, "HELD", held)
        found = op06_decontaminate.scan(df, bench, block_bytes=most)
        assert found.columns[:4] == df.columns and found.columns[4:] == ["_N_WORDS".replace("N_WORDS", "n_words"), "_spans", "items"]
        for row in found.collect():
            w = H.words(row.text)
            hit, ids = set(), set()
            for n in {len(g) for g in grams}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in grams:
                        hit.update(range(k, k + n))
                        ids |= grams[tuple(w[k : k + n])]
            assert row["_n_words"] == len(w) and {k for s in row["_spans"] for k in range(s.from_word, s.to_word)} == hit
            assert row["items"] == sorted(i for i in ids if i is not None)
    clean = op06_decontaminate.without_contaminated(df, bench)
    assert clean.columns == df.columns and {100, 101, 102}.isdisjoint({x.doc_id for x in clean.collect()})
    cut = {x.doc_id: x.text for x in op06_decontaminate.without_spans(df, bench).collect()}
    assert cut[100] == "X  y" and cut[101] == "" and cut[102] == "a  b" and cut[1002] == ""
    assert op06_decontaminate.without_contaminated(df, bench.limit(0)).count() == df.count()
    assert op06_decontaminate.scan(df.limit(0), bench).count() == 0


def test_decontamination_holds_the_words_of_a_part_only():
    """With one block, as in the pipeline, what a scan holds doesn't grow with the Arrow batch."""
    grams = pa.table({"words": pa.array([2], pa.int32()), "gram": pa.array([b"w1 w2"], pa.binary()), "item": pa.array([1], pa.int64())})
    sent = types.SimpleNamespace(value=op06_decontaminate._packed(grams))
    texts = [" ".join(f"w{(k + r) % 1000}" for k in range(20_000)) for r in range(80)]  # 8 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    run = op06_decontaminate._scan_of([sent], "text", ("n_words", "spans", "items"), False)
    list(run([batch.slice(0, 1)]))  # what is made once
    tracemalloc.start()
    try:
        (out,) = list(run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.column("n_words").to_pylist() == [20_000] * 80 and set(out.column("items").to_pylist()[0]) == {1}
    assert peak < 40 << 20


def test_decontamination_block_is_bounded_by_bytes():
    words = [f"w{k % 5000}x{k // 5000}".encode() for k in range(100_000)]
    grams = [b" ".join(words[k : k + 10]) for k in range(90_000)]
    table = pa.table({"words": pa.array([10] * 90_000, pa.int32()), "gram": pa.array(grams, pa.binary()), "item": pa.array(range(90_000), pa.int64())})
    said = sum(map(len, grams)) + op06_decontaminate._ROW * len(grams)
    block = op06_decontaminate.Block(table)
    assert block.nbytes <= 1.2 * said
    text = pa.array([b" ".join(words[500:520]).decode()])
    w = C.Words(*C.strings(text))
    assert [(k, ids) for k, _, ids in block.hits(w, w.hashes())] == [(k, [500 + k]) for k in range(11)]


# ------------------------------------------------------------------ 7

def test_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 32))
    for i in range(0, 300, 2):
        u = x[i] / np.linalg.norm(x[i])
        w = rng.standard_normal(32)
        w -= w @ u * u
        c = rng.uniform(0.88, 0.97)
        x[i + 1] = (c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)) * 3
    x[400:430] = x[400]
    x[430:500] = x[400] + 0.05 * rng.standard_normal((70, 32))
    x = x.astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [float("inf")] + [1.0] * 31), (5004, [1.0, None]), (5005, []), (None, [1.0] * 32), (5006, [float(v) for v in x[0][:8]])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    roots, links = H.classes({i: i for i in range(600)}, lambda a, b: near[a, b])
    for block in (1024, 16):
        monkeypatch.setattr(op07_vectors, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in op07_vectors.near_vectors(df, recall=0.9999).collect()}
        assert {i: got[i] for i in range(600)} == {i: (links[i], roots[i]) for i in range(600)}
        assert all(got[i] == (0, i) for i in (None, *range(5000, 5007)))
    assert op07_vectors.near_vectors(df.limit(0)).count() == 0
    doubles = df.where("vec_id < 600").select("vec_id", F.col("embedding").cast("array<double>"))
    assert {r.vec_id: r.n_links for r in op07_vectors.near_vectors(doubles, recall=0.9999).collect()} == {i: links[i] for i in range(600)}


# ------------------------------------------------------------------ 8

def test_jaccard_join_against_all_pairs(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    docs = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(1, 80)))) for i in range(60)]
    for k in range(120):  # a group of near copies, more or less near
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(150)] = f"w{r.randrange(500)}"
        docs.append((100 + k, " ".join(w).upper() + "!"))
    docs += [(300 + k, " ".join(base)) for k in range(30)] + [(400, "a b"), (401, "A, b."), (402, "b a"), *[o for o in ODD if o[0] != 1006]]
    df = _docs(spark, docs).withColumn("class_id", F.lit("x"))
    sets = {i: s for i, t in docs if i is not None and (s := H.shingles(t or ""))}
    roots, links = H.classes(sets, H.jaccard)
    for block in ((30_000, 400_000), (600, 1200)):
        monkeypatch.setattr(op08_jaccard, "BLOCK", block)
        got = {x.doc_id: (x.class_id, x.n_links) for x in op08_jaccard.near_duplicates(df).collect()}
        assert {i: got[i] for i in sets} == {i: (roots[i], links[i]) for i in sets}
        assert all(got[i] == (None, 0) for i in (None, 1001, 1002, 1003))
    kept = op08_jaccard.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == {i for i in sets if roots[i] == i} | {None, 1001, 1002, 1003}
    assert op08_jaccard.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_links_of_long_texts_beside_empty_blocks(spark):
    """Two near copies of 16,000 shingles are dealt into two blocks: often one of these has no members."""
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(16_004))
    df = _docs(spark, [x for k in range(6) for x in ((2 * k, long(k)), (2 * k + 1, long(k) + " end"))])
    got = {x.doc_id: (x.class_id, x.n_links) for x in op08_jaccard.near_duplicates(df).collect()}
    assert got == {k: (k // 2 * 2, 1) for k in range(12)}


@pytest.mark.parametrize("similarity", [0.5, 0.65, 0.8])
def test_jaccard_join_at_any_similarity(spark, similarity):
    r = random.Random(9)
    base = [[f"w{r.randrange(900)}" for _ in range(150)] for _ in range(8)]
    docs = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(1, 80)))) for i in range(30)]
    for k in range(240):
        w = list(base[k % 8])
        for _ in range(r.randint(0, 18)):
            w[r.randrange(150)] = f"w{r.randrange(500)}"
        docs.append((100 + k, " ".join(w)))
    sets = {i: s for i, t in docs if (s := H.shingles(t))}
    _, links = H.classes(sets, lambda a, b: len(a & b) / len(a | b) >= similarity)
    got = {x.doc_id: x.n_links for x in op08_jaccard.near_duplicates(_docs(spark, docs), similarity).collect()}
    assert all(got[i] <= links[i] for i in sets) and sum(got.values()) >= 0.99 * sum(links.values()) > 0


def test_band_shape():
    for similarity, recall in ((0.8, 0.999), (0.5, 0.9)):
        bands, rows = op08_jaccard.shape(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= 256


# ------------------------------------------------------------------ 10

def test_bpe_against_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder, decoder = op10_bpe.opened(op10_bpe.packed_tables(op10_bpe.default_path()))
    r = random.Random(3)
    letters = "\x1c\x1f\x85  ​İabcdefghijklmnopqrstuvwxyzABCéßΣσİñ0123456789'!?<|>/w   ́\t\n漢字😀ﬁ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(2500)]
    texts += ["a" * 3000, "aaaa " * 20, "x<|endoftext|>y <|startoftext|>", "<|endoftext|", "it's we'll 'S don't", "</w> a</w>b", "ΑΣ ΑΣΑ", "", " ", "mississippi" * 40, None]
    texts += ["".join(r.choice("aeinorst'") for _ in range(n)) for n in (1, 127, 128, 129, 160, 700, 20_000)] + ["''s 'tis y'all've 're'le l'l 'é1'd", "abc" * 10_000 + "!" * 5000]
    texts += ["".join(r.choice("aeinorst") for _ in range(r.randint(1, 90))) for _ in range(300)]
    packed = encoder.column(*C.strings(pa.array(texts, pa.string())))
    for x, ids, back in zip(texts, packed.to_pylist(), decoder.column(packed).to_pylist(), strict=True):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and back == t.decode(want, skip_special_tokens=False)


def test_bpe_frames(spark):
    docs = _docs(spark, [(1, "hello world"), *ODD]).withColumn("IDS", F.lit(1))
    got = op10_bpe.encode(docs)
    assert got.columns == ["doc_id", "text", "IDS", "_ids"] and got.count() == docs.count()
    rows = {r.doc_id: (r.n, r.back) for r in op10_bpe.decode(got, ids_col="_ids", name="back").select("doc_id", op10_bpe.unpacked(F.col("_ids")).alias("n"), "back").collect() if r.doc_id in (1, 1001, 1002)}
    assert rows == {1: ([3306, 1002], "hello</w> world</w>"), 1001: ([], ""), 1002: ([], "")}
    long = [r for r in op10_bpe.digest(docs).collect() if r.doc_id == 1005]
    assert long[0].n_tokens == 30_000 and long[0].ids_sha256 == hashlib.sha256(bytes(long[0]._ids)).hexdigest()
    assert op10_bpe.digest(docs).columns == ["doc_id", "text", "IDS", "_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert op10_bpe.digest(docs.limit(0)).count() == 0


def test_bpe_of_a_text_of_50_mb():
    import time

    encoder, decoder = op10_bpe.opened(op10_bpe.packed_tables(op10_bpe.default_path()))
    for text in ("word " * 10_000_000, "ab" * 2_500_000):
        began = time.time()
        ids = encoder.column(*C.strings(pa.array([text], pa.string())))
        assert len(ids[0].as_py()) // 4 >= len(text) // 32 and time.time() - began < 120
        back = decoder.column(ids)[0].as_py().replace(" ", "").replace("</w>", "")
        assert back == text.replace(" ", "")
