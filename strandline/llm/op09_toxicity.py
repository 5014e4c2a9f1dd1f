"""Toxicity by noisy-channel deobfuscation and learnt evidence.

A character trigram model is counted over all documents. What may be disguised
(digits or signs among letters, marks between them, a letter three times
running, most letters twice, letters spelled out one by one) becomes a lattice:
each symbol may stand for itself or, at a cost, for the letters it resembles, a
run for one letter or two, a mark or a blank between spelled letters for nothing
or for a word's end. Viterbi search restores the likeliest words, however long
the lattice is. Evidence are whole words and the beginnings of words, as written
and as restored. Its weight is the log ratio of the shares of toxic and other
training documents that have it (or have it often, for their length), if that is
significant among as many pairs as are tried; each toxic document vouches for its
strongest evidence, up to half as strong, and what too few vouch for is
dropped, so that passages copied along with toxic words do not weigh. The score
is the logistic function of the strongest weight, a part of the others, and
the prior. Evidence is counted, weighed and joined in tables that stay on the
cluster; workers get it in blocks of at most ``BLOCK`` hashes, one after another
for each Arrow batch.

Defined cases: null and empty texts have no evidence and the score of the
prior; labels that are null or neither 0 nor 1 are not learnt from; without
labels the score is 0; words are searched whole, in texts of any length; extra
columns pass through.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .op03_quality import FOLDS, in_fold, labelled

THRESHOLD = 0.5
#: Bytes of the beginnings of words that are evidence.
BEGINNINGS = (4, 5, 6, 8)
#: Hashes of evidence that a worker holds at once; share of the documents with evidence that vouch for it, at least.
BLOCK, VOUCH = 1 << 20, 0.02
#: States that Viterbi search keeps for a symbol; words of at most so many bytes are remembered.
BEAM, REMEMBER = 24, 48
#: Evidence has levels by how often it comes, also for one in so many words; weights of less than
#: LEAST are dropped; what other evidence than the strongest adds.
LEVELS, RATE, LEAST, OTHERS = 4, 128, math.log(4), 0.1

#: What each disguise may stand for, fixed values.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c"}
LOOK_COST, SELF_COST, DOUBLE_COST, MARK_COST, BREAK_COST = 1.5, 4.0, 1.0, 1.0, 1.0
_OTHER, _EDGE, _SYMBOLS = 26, 27, 28
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOOK = np.zeros(256, bool)
for _c in LOOKS:
    _LOOK[ord(_c)] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[0x61:0x7B] = np.arange(26)
_BETWEEN = b".-_*~'"
_MARKS = frozenset(_BETWEEN.decode())


# ------------------------------------------------------------------ character model

def _trigrams(batches):
    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in batches:
        for _, offsets, raw in C.slices(batch, "text"):
            w = C.Words(offsets, raw)
            if not len(w.start):
                continue
            n = w.end - w.start
            at = np.concatenate([[0], np.cumsum(n + 3)])  # two edges before a word, one after
            line = np.full(int(at[-1]), _EDGE, np.int64)
            place = np.repeat(at[:-1] + 2 - w.start, n)
            where = np.repeat(w.start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            line[where + place] = _CLASS[w.data[where]]
            code = (line[:-2] * _SYMBOLS + line[1:-1]) * _SYMBOLS + line[2:]
            between = (line[1:-1] == _EDGE) & (line[2:] == _EDGE)  # one word's end and the next one's begin
            total += np.bincount(code[~between], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of each letter after two others, from all words of ``docs``."""
    rows = docs.select("text").mapInArrow(C.tidied(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(_SYMBOLS**3)
    for code, k in rows:
        n[code] = k
    n = n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _SYMBOLS)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (n + 4 * p2) / (n.sum(2, keepdims=True) + 4)
    return -np.log(p3)


class Restorer:
    """Viterbi search in the lattices of disguised words."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[bytes, bytes] = {}

    def options(self, word: str) -> list[list[tuple[str, float]]]:
        """For each run of one symbol, what it may stand for with the costs: letters, nothing, or a word's end.

        Blanks stand between letters that are spelled out.
        """
        out, k = [], 0
        spelled = " " in word
        if spelled:
            word = word.replace(" ", "")
        doubled = sum(a == b for a, b in zip(word, word[1:], strict=False)) * 3 >= len(word)
        while k < len(word):
            n = 1
            while k + n < len(word) and word[k + n] == word[k]:
                n += 1
            c = word[k]
            if spelled and out:
                out.append([("", 0.0), (" ", BREAK_COST)])
            if c in _MARKS and out and k + n < len(word):
                out.append([("", MARK_COST), (" ", 0.0)])
                k += n
                continue
            if c.isalpha():
                one = [(c, 0.0)]
            else:
                one = [(x, LOOK_COST) for x in LOOKS.get(c, "")] + [(c, SELF_COST)]
            if n > 2 or (n == 2 and doubled):
                out.append([(x, cost) for x, cost in one] + [(x + x, cost + DOUBLE_COST) for x, cost in one])
            else:
                out += [one] * n
            k += n
        return out

    def best(self, word: str) -> str:
        costs = self.costs
        states = {(_EDGE, _EDGE): 0.0}
        trail: list[dict] = []  # of each state where it comes from and by what
        for options in [*self.options(word), [("\n", 0.0)]]:
            after: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple] = {}
            for state, cost in states.items():
                for letters, more in options:
                    (x, y), c = state, cost + more
                    for z in letters:
                        s = _EDGE if z in " \n" else ord(z) - 97 if "a" <= z <= "z" else _OTHER
                        c += costs[x][y][s]
                        x, y = (y, s) if s != _EDGE else (_EDGE, _EDGE)
                    if (x, y) not in after or c < after[x, y]:
                        after[x, y] = c
                        came[x, y] = (state, letters)
            if len(after) > BEAM:
                after = dict(heapq.nsmallest(BEAM, after.items(), key=lambda x: x[1]))
            states = after
            trail.append(came)
        state, out = min(states, key=states.get), []
        for came in reversed(trail):
            state, letters = came[state]
            out.append(letters)
        return "".join(reversed(out)).rstrip("\n")

    def word(self, raw: bytes) -> bytes:
        if (out := self.known.get(raw)) is None:
            out = self.best(raw.decode("utf-8", "replace")).encode()
            if len(raw) <= REMEMBER:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[raw] = out
        return out


# ------------------------------------------------------------------ evidence

def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of the runs without white space."""
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.concatenate([inside, [False]])
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def disguised(offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, bytes]]:
    """(row, word) of what may be a disguised word, marks at the ends and between letters gone."""
    out: list[tuple[int, bytes]] = []
    n = len(data)
    if not n:
        return out
    start, end, row = _tokens(data, offsets)
    letter, look = _LETTER[data], _LOOK[data]
    odd = np.zeros(n, bool)
    beside = np.zeros(n, bool)
    beside[1:] |= letter[:-1]
    beside[:-1] |= letter[1:]
    odd |= look & beside
    odd[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    odd[1:-1] |= np.isin(data[1:-1], np.frombuffer(_BETWEEN, np.uint8)) & letter[:-2] & letter[2:]
    count = np.concatenate([[0], np.cumsum(odd)])
    twice = np.zeros(n, bool)
    twice[1:] = letter[1:] & (data[1:] == data[:-1])
    pairs = np.concatenate([[0], np.cumsum(twice)])
    ends = b"!.,;:?*#%&)(\"'-$|+<{}[]/\\=_~"
    doubled = pairs[end] - pairs[start] >= np.maximum(3, (end - start) // 3)  # most letters come twice
    for k in np.flatnonzero((count[end] > count[start]) | doubled).tolist():
        word = data[start[k] : end[k]].tobytes().rstrip(ends).lstrip(b".,;:?*#%&)\"'-/\\=_~[]")
        if len(word) > 2:
            out.append((int(row[k]), word))
    # letters spelled out: three or more single symbols, one blank between
    size = end - start
    single = (size == 1) & (letter[start] | look[start])
    joined = single[1:] & single[:-1] & (start[1:] - end[:-1] == 1) & (row[1:] == row[:-1])
    k = 0
    at = np.flatnonzero(joined)
    while k < len(at):
        m = k
        while m + 1 < len(at) and at[m + 1] == at[m] + 1:
            m += 1
        a, b = int(at[k]), int(at[m]) + 1
        if b - a >= 2:
            out.append((int(row[a]), b" ".join(bytes([x]) for x in data[start[a : b + 1]].tolist())))
        k = m + 1
    return out


def evidence(offsets: np.ndarray, raw: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every word, beginning of a word, and those of restored words, not distinct; words of each row."""
    w = C.Words(offsets, raw)
    rows, hashes = _hashed(w)
    found = [(r, restorer.word(x)) for r, x in disguised(w.offsets, w.data)]
    if found:
        joined = b"".join(x for _, x in found)
        ends = np.concatenate([[0], np.cumsum([len(x) for _, x in found])])
        v = C.Words(ends, np.frombuffer(joined, np.uint8))
        more, extra = _hashed(v)
        rows = np.concatenate([rows, np.array([r for r, _ in found])[more]])
        hashes = np.concatenate([hashes, extra])
    return rows, hashes, np.diff(w.first)


def _hashed(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = w.end - w.start
    rows, hashes = [w.row], [w.hashes()]
    for n in BEGINNINGS:
        some = size > n
        part = w.start[some]
        value = np.zeros(len(part), np.uint64)
        for k in range(n):
            value = value * np.uint64(257) + w.data[part + k]
        hashes.append(C.mix(value + np.uint64(n << 56)))
        rows.append(w.row[some])
    return np.concatenate(rows), np.concatenate(hashes)


def _counted_in(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows and keys, and how often each comes."""
    order = np.lexsort((rows, keys))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return rows[at], keys[at], np.diff(np.append(at, len(rows)))


def _levels(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which levels of evidence hold, a column each: there; in one word of ``RATE``; twice so; three times so."""
    dense = times * RATE >= words
    return np.column_stack([np.ones(len(times), bool), dense, dense & (times > 1), dense & (times > 2)])


class Table:
    """A block of evidence: weights by hash and level; a level without a weight has 0."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True

    @classmethod
    def of(cls, table: pa.Table, column: str) -> Table:
        """From rows of hash, level and a column of weights."""
        hashes, at = np.unique(table.column("hash").to_numpy().view(np.uint64), return_inverse=True)
        weights = np.zeros((len(hashes), LEVELS), np.float32)
        weights[at, table.column("level").to_numpy()] = table.column(column).to_numpy()
        return cls(hashes, weights)

    def find(self, rows: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places in the table and levels of what is in it; ``words``: the number in each row."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, LEVELS), bool)
        maybe = self.bits[hashes >> np.uint64(44)]
        rows, hashes = rows[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        rows, at, times = _counted_in(rows[same], at[same])
        return rows, at, _levels(times, words[rows])


class Blocks:
    """Evidence dealt by hash into blocks that are broadcast; a worker keeps one where it is the only one."""

    def __init__(self, evidence: DataFrame | None, column: str):
        self.sent, self.only = [], None
        if evidence is None:
            return
        spark, many = evidence.sparkSession, max(1, -(-evidence.count() // BLOCK))
        for k in range(many):
            part = Table.of(evidence.where(F.pmod("hash", F.lit(many)) == k).select("hash", "level", F.col(column).cast("double").alias(column)).toArrow(), column)
            held = io.BytesIO()
            np.savez(held, hashes=part.hashes, weights=part.weights)
            self.sent.append(spark.sparkContext.broadcast(held.getvalue()))

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "only": None}

    def __iter__(self):
        if self.only is not None:
            yield self.only
            return
        for sent in self.sent:
            path = getattr(sent, "_path", None)  # read each time where there are several: the worker keeps none
            raw = sent.load_from_path(path) if path and len(self.sent) > 1 else sent.value
            with np.load(io.BytesIO(raw)) as held:
                block = Table(held["hashes"], held["weights"])
            if len(self.sent) == 1:
                self.only = block
            yield block


def _counter(costs: np.ndarray, blocks: Blocks | None, vouch: bool = False):
    """Counts documents by evidence: all of it, what is in the blocks, or what each one vouches for."""

    def run(batches):
        restorer = Restorer(costs)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, offsets, raw in C.slices(batch, "text"):
                rows, hashes, words = evidence(offsets, raw, restorer)
                if blocks is None:
                    rows, hashes, times = _counted_in(rows, hashes)
                    found = [(hashes, _levels(times, words[rows]))]
                else:
                    found, best = [], np.zeros(len(words))
                    for table in blocks:
                        r, at, holds = table.find(rows, hashes, words)
                        weight = np.where(holds, table.weights[at], 0)
                        np.maximum.at(best, r, weight.max(axis=1, initial=0))
                        holds &= weight > 0  # what is asked for
                        found.append((r, table.hashes[at], holds, weight))
                    if vouch:
                        found = [(h, holds & (weight >= best[r][:, None] - math.log(2))) for r, h, holds, weight in found]
                    else:
                        found = [(h, holds) for _, h, holds, _ in found]
                for h, holds in found:
                    held += [(h[holds[:, k]], np.full(int(holds[:, k].sum()), k)) for k in range(LEVELS)]
                    size += int(holds.sum())
                if size > 2_000_000:
                    yield _counted(held)
                    held, size = [], 0
        if size:
            yield _counted(held)

    return run


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    level, hashes, n = _counted_in(np.concatenate([k for _, k in held]), np.concatenate([h for h, _ in held]))
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(level.astype(np.int64)), pa.array(n.astype(np.int64))], ["hash", "level", "n"])


class Model:
    def __init__(self, costs: np.ndarray, blocks: Blocks, prior: float):
        self.costs, self.blocks, self.prior = costs, blocks, prior
        self.restorer: Restorer | None = None

    def score(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The logistic function of the prior, the strongest evidence, and a part of all other."""
        self.restorer = self.restorer or Restorer(self.costs)
        said = evidence(offsets, raw, self.restorer)
        best, total = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for table in self.blocks:
            rows, at, holds = table.find(*said)
            weight = np.where(holds, table.weights[at], 0).max(axis=1, initial=0)
            np.maximum.at(best, rows, weight)
            np.add.at(total, rows, weight)
        return 1 / (1 + np.exp(-np.clip(self.prior + best + OTHERS * (total - best), -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, name: str = "toxic", folds: int = FOLDS) -> Model:
    """Learn from the labelled rows that aren't held out; the character model, which needs no labels, from all."""
    costs = character_model(docs)
    known = C.written(labelled(labels, name), "labels")
    train = C.written(C.checked_join(docs.select("doc_id", "text").where(~in_fold(F.col("doc_id"), folds)), known, "doc_id", "inner"), "labelled")
    seen = {r[0]: r[1] for r in train.groupBy("label").agg(F.count(F.lit(1))).collect()}
    other, toxic = seen.get(0, 0), seen.get(1, 0)
    if not toxic:
        return Model(costs, Blocks(None, ""), -700.0)
    prior = math.log((toxic + 0.5) / (other + 0.5))

    def counts(label: int, blocks: Blocks | None, n: str, vouch: bool = False) -> DataFrame:
        found = train.where(F.col("label") == label).select("text").mapInArrow(C.tidied(_counter(costs, blocks, vouch)), "hash long, level long, n long")
        return found.groupBy("hash", "level").agg(F.sum("n").alias(n))

    have = C.written(counts(1, None, "have").where("have > 1"), "have")
    # twice the logarithm of how many pairs are tried is what the best of as many chance ones reaches; in a pair that
    # no other document has, each toxic one adds as much as its kind is rare
    bound = 2 * math.log(max(have.count(), 2))
    least = math.ceil(bound / (2 * math.log((toxic + max(other, toxic)) / toxic)))
    have = have.where(F.col("have") >= least)
    clean = counts(0, Blocks(have, "have"), "clean")
    both = have.join(clean, ["hash", "level"], "left").select("hash", "level", "have", F.coalesce("clean", F.lit(0)).alias("clean"))
    weight = F.log((F.col("have") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (other + 1))
    part = lambda n, k, of: F.when(n > 0, n * F.log(n * (toxic + other) / (k * of))).otherwise(0.0)
    a, b = F.col("have").cast("double"), F.col("clean").cast("double")
    fit_of = 2 * (part(a, a + b, toxic) + part(b, a + b, other or 1) + part(toxic - a, toxic + other - a - b, toxic) + part(other - b, toxic + other - a - b, other or 1))
    kept = C.written(both.select("hash", "level", "have", weight.alias("weight")).where((weight >= LEAST) & (fit_of >= bound)), "weights")
    vouched = counts(1, Blocks(kept, "weight"), "vouched", vouch=True)
    kept = kept.join(vouched, ["hash", "level"]).where((F.col("vouched") > 1) & (F.col("vouched") >= VOUCH * F.col("have")))
    return Model(costs, Blocks(C.written(kept.select("hash", "level", "weight"), "evidence"), "weight"), prior)


def with_score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    name = C.free_name(docs.columns, name)

    def run(batches):
        for batch in batches:
            for part, offsets, raw in C.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(offsets, raw))], [*part.schema.names, name])

    return docs.mapInArrow(C.tidied(run), C.with_fields(docs.schema, (name, T.DoubleType())))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from the labels of those that aren't held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
