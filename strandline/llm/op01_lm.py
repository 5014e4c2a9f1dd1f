"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

A text is its words with ASCII letters in lower case, and an end. Words are
split by the first ``PIECES`` merges of a public byte-level vocabulary. Counts
of all words of the training documents (a distributed sum) give, for the pieces
of a word, discounted trigrams that fall back to bigrams and unigrams. One layer
of causal self-attention (query, key and value tables, a bias for each distance)
over the last 16 to 31 pieces tilts the classes of the next piece away from
what the bigrams say. It is trained on all runs of words of all training
documents, a third in each of three rounds of local Adam steps in parallel whose weights are averaged. The score is the mixture of the two, each
being a distribution, with shares fitted on every training run before it is trained on. Scoring walks a
stream of pieces in overlapping windows: 16 queries against 32 keys, so that
every piece is scored once, later pieces and other documents being masked.

The counts of frequent words are broadcast in a table of at most ``HEAD``
words; other words go to their counts by a shuffle join, so that neither hot
words nor the size of the vocabulary matter. Where there are more than
``TRIGRAMS`` distinct trigrams, words get their trigram prices in the same way,
from the whole table: frequent words once, others by a join with their rows.

Defined cases: null and empty texts have one token, the end; texts of any
length are scored whole; rows that repeat an id are scored each; without
training documents the counts are 0; extra columns are not read.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .op03_quality import in_fold

FOLDS = 10
PIECES, CLASSES, WIDTH, STRIDE = 4096, 96, 16, 16
#: Words that are broadcast at most; trigrams, when they are broadcast at all, which is all of them.
HEAD, TRIGRAMS = 300_000, 600_000
#: Words of a run; all runs of all training documents train.
RUN = 10
#: Windows a step; runs, and bytes of them, that a trainer holds at once; so many trainers share what is more than
#: a portion each, and further ones come when each would have over LONG portions; rates of the rounds.
BATCH, PORTION, PORTION_BYTES, TRAINERS, LONG, RATES = 64, 12_000, 4 << 20, 12, 8, (0.03, 0.02, 0.01)
DISCOUNT = 0.75


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str, pieces: int = PIECES) -> tuple[str, dict[bytes, int]]:
    """The pattern that splits words, and the vocabulary's first ``pieces`` merges: itself a vocabulary."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return public_tokenizers.PATTERN, {k: v for k, v in ranks.items() if v < pieces}


class Pieces:
    def __init__(self, said: tuple[str, dict[bytes, int]]):
        import tiktoken

        self.encoding = tiktoken.Encoding("words", pat_str=said[0], mergeable_ranks=said[1], special_tokens={})
        self.size = len(said[1])
        first = np.zeros(self.size, bool)
        for k, v in said[1].items():
            first[v] = k[:1] == b" "
        self.first = first

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words one after another, and where each word begins (and the end)."""
        ids = np.array(self.encoding.encode_ordinary("".join([" " + w for w in words])), np.int32)
        begin = np.flatnonzero(self.first[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(begin) != len(words) or (len(begin) and begin[0]):  # odd white space in a word
            each = [self.encoding.encode_ordinary(" " + w) for w in words]
            ids = np.array([x for e in each for x in e], np.int32)
            begin = np.cumsum([0, *map(len, each)])[:-1]
        return ids, np.append(begin, len(ids)).astype(np.int64)


# ------------------------------------------------------------------ counting words

def _split(offsets: np.ndarray, raw: np.ndarray):
    """Codes of the words of some rows, the distinct words, and where each row's words begin."""
    base = int(offsets[0])
    n = len(offsets) - 1
    texts = pa.StringArray.from_buffers(n, pa.py_buffer((offsets - base).astype(np.int32)), pa.py_buffer(raw[base : int(offsets[-1])]))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    begin = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(full)])[begin]
    words = pc.dictionary_encode(flat.filter(pa.array(full)))
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, begin


class Lookup:
    """Places of strings in a fixed column, by sorted 64-bit hashes; what is found is compared."""

    def __init__(self, words: pa.Array):
        self.words = words
        hashes = string_hashes(words)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def __call__(self, some: pa.Array) -> np.ndarray:
        """The place of each string, or -1."""
        if not len(self.hashes) or not len(some):
            return np.full(len(some), -1)
        hashes = string_hashes(some)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.where(self.hashes[at] == hashes, self.order[at], 0)
        same = pc.equal(some, self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
        return np.where(same, place, -1)


def string_hashes(column: pa.Array) -> np.ndarray:
    offsets, raw = C.strings(column)
    data = raw[int(offsets[0]) : int(offsets[-1])]
    at = offsets - offsets[0]
    out = np.empty(len(column), np.uint64)
    for a, b in C.pieces(at):
        part, begin = data[at[a] : at[b]], at[a : b + 1] - at[a]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * C._power("m", len(part)), out=sums[1:])
        out[a:b] = (sums[begin[1:]] - sums[begin[:-1]]) * C._power("i", len(part) + 1)[begin[:-1]] + np.diff(begin).astype(np.uint64)
    return C.mix(out)


def _merge(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("s", use_threads=False).aggregate([("n", "sum")]).rename_columns(["s", "n"])


def _gather():
    """Words with their counts (kind 0), all runs of words, to train on (kind 1: n has bits for first and last of a
    document), and the number of documents (kind 2)."""
    names = ["kind", "s", "n"]

    def batch_of(kind: int, t: pa.Table):
        for b in t.to_batches(max_chunksize=100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), b.column("s"), b.column("n").cast(pa.int64())], names)

    def run(batches):
        held: list[pa.Table] = []
        size = rows = docs = 0
        for batch in batches:
            for part, offsets, raw in C.slices(batch, "text"):
                codes, words, begin = _split(offsets, raw)
                docs += part.num_rows
                held.append(pa.table({"s": words, "n": np.bincount(codes, minlength=len(words))}))
                rows += len(words)
                if rows > size + 1_000_000:
                    held = [_merge(held)]
                    size = rows = len(held[0])
                    if size > 2_000_000:
                        yield from batch_of(0, held[0])
                        held, size, rows = [], 0, 0
                n = np.diff(begin)
                runs = np.maximum(1, -(-n // RUN))
                doc = np.repeat(np.arange(len(n)), runs)
                k = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
                at = begin[doc] + RUN * k
                flags = (k == 0) + 2 * (at + RUN >= begin[doc + 1])
                cuts = pa.array(np.append(at, begin[-1]).astype(np.int32))  # run after run, all words
                said = pc.binary_join(pa.ListArray.from_arrays(cuts, words.take(pa.array(codes))), " ")
                if len(said):
                    yield from batch_of(1, pa.table({"s": said, "n": flags}))
        if held:
            yield from batch_of(0, _merge(held))
        yield from batch_of(2, pa.table({"s": pa.array([""], pa.string()), "n": [docs]}))

    return run


def _frequent(counted: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach."""
    seen = 0
    for n, k in counted.groupBy(F.least(F.col("n"), F.lit(1_000_000)).alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(1_000_001).toLocalIterator():
        seen += k
        if seen > most:
            return n + 1
    return 1


# ------------------------------------------------------------------ counts of pieces within words

def _trigrams_of(said):
    def run(batches):
        pieces = Pieces(said.value)
        out = pieces.size  # as a context: before a word; as what follows: the word's end
        for batch in batches:
            words, n = batch.column("w").to_pylist(), np.array(batch.column("n"))
            for a in range(0, len(words), 20_000):
                ids, begin = pieces.words(words[a : a + 20_000])
                times = n[a : a + 20_000]
                x, y, z, owner = _contexts(ids, begin, out)
                key = (x * (out + 1) + y) * (out + 1) + z
                keys, at = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, weights=times[owner]).astype(np.int64))], ["key", "n"])

    return run


def _contexts(ids: np.ndarray, begin: np.ndarray, out: int):
    """(before that, before, piece, word) for each piece after a word's first, and for each word's end."""
    size = np.diff(begin)
    owner = np.repeat(np.arange(len(size)), size)
    line = np.full(len(ids) + len(size), out, np.int64)  # a word, then its end
    place = np.arange(len(ids)) + owner
    line[place] = ids
    own = np.empty(len(line), np.int64)
    own[place] = owner
    ends = begin[1:] + np.arange(len(size))
    own[ends] = np.arange(len(size))
    firsts = begin[:-1] + np.arange(len(size))
    k = np.ones(len(line), bool)
    k[firsts] = False
    k = np.flatnonzero(k)
    before = np.where(np.isin(k - 1, firsts), out, line[k - 2])
    return before, line[k - 1], line[k], own[k]


class Ngrams:
    """Discounted trigrams of pieces within words; probabilities are interpolated with shorter contexts."""

    def __init__(self, size: int, keys: np.ndarray, n: np.ndarray, bi: np.ndarray, bi_n: np.ndarray, first: np.ndarray):
        b = self.base = size + 1
        self.first = np.log((first + 0.1) / (first.sum() + 0.1 * len(first)))  # a word's first piece; last: a text's end
        uni = np.bincount(bi % b, weights=bi_n, minlength=b) + 0.1
        self.uni = uni / uni.sum()
        self.two = self._table(bi, bi_n.astype(np.float64))
        self.three = self._table(keys, n.astype(np.float64))

    def _table(self, keys: np.ndarray, n: np.ndarray):
        context = keys // self.base
        contexts, at = np.unique(context, return_inverse=True)
        return keys, n, contexts, np.bincount(at, weights=n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))

    def _with(self, table, key: np.ndarray, short: np.ndarray) -> np.ndarray:
        keys, n, contexts, total, kinds = table
        if not len(keys):
            return short
        context = key // self.base
        c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        seen = contexts[c] == context
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        times = np.where(keys[k] == key, n[k], 0)
        long = (np.maximum(times - DISCOUNT, 0) + DISCOUNT * kinds[c] * short) / total[c]
        return np.where(seen, long, short)

    def logs(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, three=None) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the trigram and the bigram probabilities; ``three``: what trigrams add and leave to bigrams, from a join."""
        two = self._with(self.two, y * self.base + z, self.uni[z])
        if three is not None:
            return np.log(three[0] + three[1] * two), np.log(two)
        return np.log(self._with(self.three, (x * self.base + y) * self.base + z, two)), np.log(two)

    def bigrams(self) -> np.ndarray:
        """Probability of every piece, and of the word's end, after every piece."""
        keys, n, contexts, total, kinds = self.two
        b = self.base
        out = np.tile(self.uni.astype(np.float32), (b, 1))
        out[contexts] = (DISCOUNT * kinds / total).astype(np.float32)[:, None] * self.uni.astype(np.float32)
        out[keys // b, keys % b] += (np.maximum(n - DISCOUNT, 0) / total[np.searchsorted(contexts, keys // b)]).astype(np.float32)
        return out[:-1]


def classes_of(follow: np.ndarray, first: np.ndarray, isfirst: np.ndarray, n: int = CLASSES) -> np.ndarray:
    """A class for each piece and the end: frequent ones alone, others by k-means over their neighbours."""
    size = len(isfirst)
    weight = np.concatenate([np.where(isfirst, first[:size], 0) + np.where(isfirst, 0, (follow[:, :size] * first[:size, None]).sum(0)), first[size:]])
    out = np.full(size + 1, -1)
    alone = np.argsort(-weight)[: n // 3]
    out[alone] = np.arange(len(alone))
    rng = np.random.default_rng(5)
    near = np.concatenate([np.sqrt(follow[:, :size]) @ rng.standard_normal((size, 16)), np.sqrt(follow[:, :size]).T @ rng.standard_normal((size, 16)) / 8], axis=1)
    at = len(alone)
    for kind, share in ((True, 0.6), (False, 0.4)):
        some = np.flatnonzero((isfirst == kind) & (out[:size] < 0))
        k = max(1, min(int((n - len(alone)) * share), len(some), n - at - (1 if kind else 0)))
        if not len(some):
            continue
        x, w = near[some], weight[some] + 1e-12
        middle = x[np.argsort(-w)[:k]]
        for _ in range(12):
            label = np.argmin((middle**2).sum(1)[None, :] - 2 * x @ middle.T, axis=1)
            mass = np.bincount(label, weights=w, minlength=k)
            sums = np.stack([np.bincount(label, weights=w * x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
            middle = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], middle)
        out[some] = at + label
        at += k
    out[out < 0] = 0
    return out


# ------------------------------------------------------------------ attention

_TABLES = ("q", "k", "v", "e")


class Attention:
    """Tables of queries, keys, values and own vectors for pieces (and the begin), a bias for each distance, and
    the classes' weights; the logits are added to the logarithms of the classes' bigram probabilities."""

    NAMES = (*_TABLES, "w", "bias")

    def __init__(self, weights: dict[str, np.ndarray], prior: np.ndarray, classes: np.ndarray):
        self.__dict__.update(weights)
        self.prior, self.classes = prior, classes

    @classmethod
    def fresh(cls, size: int, n: int) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(11)
        some = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        bias = -0.05 * np.arange(2 * STRIDE, dtype=np.float32)
        return {"q": some(size + 1, WIDTH), "k": some(size + 1, WIDTH), "v": some(size + 1, WIDTH), "e": some(size + 1, WIDTH), "w": some(WIDTH, n) * np.float32(0.1), "bias": bias}

    def forward(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, e: np.ndarray, queries: np.ndarray, bias: np.ndarray, valid: np.ndarray):
        """Weights of keys (blocks, a, b), what queries attend to, and, for the ``valid`` places of the flattened queries, the
        vectors given to classes, the classes' exponentials and their sums, from vectors of queries (scaled), keys, values
        and own vectors; ``bias`` (a, b) is added, far below 0 where a key may not be seen."""

        def scores():
            s = np.matmul(q, k.transpose(0, 2, 1))
            s += bias
            return s

        s, total = _exponentials(scores)
        s *= (1 / total).reshape(s.shape[:2])[:, :, None]
        seen = np.matmul(s, v)
        o = (seen + e).reshape(-1, seen.shape[2]).take(valid, axis=0)

        def logits():
            p = o @ self.w
            p += self.prior.take(queries, axis=0)
            return p

        return s, seen, o, *_exponentials(logits)


def _exponentials(make) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of what ``make`` gives, up to a factor for each row of the last axis, and the rows' sums. Rows' maxima
    are taken off only where numbers would get too large or too small without."""
    s = make()
    rows = s.reshape(-1, s.shape[-1])
    ones = np.ones(rows.shape[1], rows.dtype)
    if rows.max() < 60:
        np.exp(rows, out=rows)
        total = rows @ ones
        if total.min() > 1e-20:
            return s, total
        s = make()
        rows = s.reshape(-1, s.shape[-1])
    rows -= rows.max(axis=1, keepdims=True)
    np.exp(rows, out=rows)
    return s, rows @ ones


def _causal(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of b keys (the last a being the queries themselves) a query may see, and the distances."""
    d = np.arange(b - a, b)[:, None] - np.arange(b)[None, :]
    return d >= 0, np.clip(d, 0, 2 * STRIDE - 1)


def train(weights: dict[str, np.ndarray], prior: np.ndarray, classes: np.ndarray, lines: np.ndarray, targets: np.ndarray, steps_seed: int, rate: float, told=None) -> tuple[dict, float, np.ndarray]:
    """One pass of Adam over windows (rows of pieces; a target below 0 doesn't count); the loss, and, where ``told`` has the
    windows' trigram and bigram logarithms and kinds, what each mixture share gives, each window before it is trained on."""
    net = Attention({k: weights[k].copy() for k in ("w", "bias")}, prior, classes)
    table = np.concatenate([weights[k] for k in _TABLES], axis=1)  # a gather and an update for all four
    first = {"table": np.zeros_like(table)} | {k: np.zeros_like(weights[k]) for k in ("w", "bias")}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    wide = lines.shape[1]
    may, apart = _causal(wide, wide)
    hide = np.where(may, np.float32(0), np.float32(-1e9))
    order = np.random.default_rng(steps_seed).permutation(len(lines))
    scale, total, shares = np.float32(1 / math.sqrt(WIDTH)), 0.0, np.zeros((2, len(_GRID)))
    held, size = [], 0
    parts = [slice(k * WIDTH, (k + 1) * WIDTH) for k in range(len(_TABLES))]
    goals, told = classes[targets.ravel()], told and [m.ravel() for m in told]  # of no target: not read
    rank = np.zeros(len(table), np.uint16 if len(table) < 1 << 16 else np.int64)  # short numbers sort by digits
    for step, at in enumerate(range(0, len(order), BATCH), 1):
        some = order[at : at + BATCH]
        x, valid = lines[some], targets[some] >= 0
        if not valid.any():
            continue
        there = np.zeros(len(table), bool)
        there[x] = True
        met = np.flatnonzero(there)  # all pieces of the windows, whether or not a target sees them
        rank[met] = np.arange(len(met))
        long = int(np.flatnonzero(valid.any(axis=0))[-1]) + 1  # no target sees what comes after
        x, valid = x[:, :long], valid[:, :long]
        flat, own = x.ravel(), np.flatnonzero(valid)
        source, cell = flat[own], (some[:, None] * wide + np.arange(long)).ravel()[own]
        vectors = table.take(x, axis=0)
        q, k, v, e = (vectors[:, :, p] for p in parts)
        q = q * scale
        s, seen, o, p, sums = net.forward(q, k, v, e, source, net.bias[apart[:long, :long]] + hide[:long, :long], own)
        r, goal, n = np.arange(len(p)), goals[cell], np.float32(len(p))
        log = np.log(p[r, goal] / sums + 1e-30)
        total -= float(log.sum())
        if told:
            gram, member, lead = (m[cell] for m in told)
            held.append((log + member - prior[source, goal], gram, lead))
            size += len(log)
            if size > 1 << 16:
                shares += _shares(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        p *= (1 / (sums * n))[:, None]
        p[r, goal] -= 1 / n
        grad = {"w": o.T @ p}
        do = np.zeros((len(flat), WIDTH), np.float32)
        do[own] = p @ net.w.T
        do = do.reshape(*x.shape, WIDTH)
        ds = np.matmul(do, v.transpose(0, 2, 1))
        ds -= np.einsum("bij,bij->bi", do, seen)[:, :, None]  # what ds has on average by the weights
        ds *= s
        grad["bias"] = np.bincount(apart[:long, :long].ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * STRIDE).astype(np.float32)
        all_four = np.empty(vectors.shape, np.float32)
        np.matmul(ds, k, out=all_four[:, :, parts[0]])
        all_four[:, :, parts[0]] *= scale
        np.matmul(ds.transpose(0, 2, 1), q, out=all_four[:, :, parts[1]])
        np.matmul(s.transpose(0, 2, 1), do, out=all_four[:, :, parts[2]])
        all_four[:, :, parts[3]] = do
        last = long - np.argmax(valid[:, ::-1], axis=1)
        real = np.flatnonzero(np.arange(long) < np.where(valid.any(axis=1), last, 0)[:, None])  # gradients of others are 0
        line = rank[flat[real]]
        place = np.argsort(line, kind="stable")
        line = line[place]
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        g = np.zeros((len(met), table.shape[1]), np.float32)
        g[line[begin]] = _summed_rows(all_four.reshape(len(flat), -1).take(real[place], axis=0), begin)
        grad["table"] = g
        lr = np.float32(rate * math.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        for name, of, rows in (("table", table, met), ("w", net.w, slice(None)), ("bias", net.bias, slice(None))):
            g, m, u = grad[name], first[name][rows], second[name][rows]
            m *= 0.9
            m += 0.1 * g
            first[name][rows] = m
            g *= g
            g *= 0.01
            u *= 0.99
            u += g
            second[name][rows] = u
            u = np.sqrt(u)
            u += 1e-8
            of[rows] -= lr * m / u
    if held:
        shares += _shares(*map(np.concatenate, zip(*held, strict=True)))
    new = {k: np.ascontiguousarray(table[:, p]) for k, p in zip(_TABLES, parts, strict=True)}
    return {k: new[k] if k in new else getattr(net, k) for k in net.NAMES}, total, shares


def _summed_rows(rows: np.ndarray, begin: np.ndarray, few: int = 4) -> np.ndarray:
    """``np.add.reduceat(rows, begin, axis=0)``: the first rows of all groups at a time, as most groups have few."""
    size = np.diff(np.append(begin, len(rows)))
    out = rows.take(begin, axis=0)
    some = np.arange(len(begin))
    for k in range(1, few):
        some = some[size[some] > k]
        out[some] += rows.take(begin[some] + k, axis=0)
    some = some[size[some] > few]
    if len(some):
        left = size[some] - few
        ends = np.cumsum(left)
        at = np.arange(int(ends[-1])) + np.repeat(begin[some] + few - (ends - left), left)
        left = np.add.reduceat(rows.take(at, axis=0).view(np.complex64), ends - left, axis=0)  # two numbers at a time
        out[some] += left.view(rows.dtype)
    return out


_GRID = np.linspace(0.02, 0.98, 13)


def _shares(attended: np.ndarray, gram: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Summed log-likelihood of each mixture share, for pieces within and at the begin of words."""
    out = np.zeros((2, len(_GRID)))
    top = np.maximum(attended, gram)
    a, b = np.exp(attended - top), np.exp(gram - top)
    for kind in (0, 1):
        some = lead == bool(kind)
        x, y, known = a[some], b[some], float(top[some].sum(dtype=np.float64))
        # a logarithm for the product of 8: each factor is the share of the larger at least
        x, y = (np.pad(v, (0, -len(v) % 8), constant_values=1).reshape(8, -1) for v in (x, y))
        for k, share in enumerate(_GRID):
            out[kind, k] = known + float(np.log((np.float32(share) * x + np.float32(1 - share) * y).prod(axis=0)).sum(dtype=np.float64))
    return out


class Model:
    """All that scoring needs; ``shares``: of attention, for a piece within a word, and for a word's first."""

    def __init__(self, said, ngrams: Ngrams, attention: Attention, shares: tuple[float, float]):
        self.pieces, self.ngrams, self.attention = Pieces(said), ngrams, attention
        self.set_shares(shares)
        self.end = self.pieces.size

    def set_shares(self, shares) -> None:
        shares = np.clip(np.array(shares), 1e-6, 1 - 1e-6)
        self.mix, self.rest = np.log(shares).astype(np.float32), np.log1p(-shares).astype(np.float32)

    def lexicon(self, words: list[str], three=None):
        """Pieces of words and where words begin; logarithms of trigrams and of bigrams for the pieces (the first's is
        that of a first piece), each with those of the words' ends."""
        ids, begin = self.pieces.words(words)
        x, y, z, _ = _contexts(ids, begin, self.end)  # word by word: pieces after the first, then the end
        ends = z == self.end
        inner = np.ones(len(ids), bool)
        inner[begin[:-1]] = False
        out = [ids, begin]
        for logs in self.ngrams.logs(x, y, z, three):
            whole = np.empty(len(ids), np.float32)
            whole[begin[:-1]] = self.ngrams.first[ids[begin[:-1]]]
            whole[inner] = logs[~ends]
            out += [whole, logs[ends].astype(np.float32)]
        return out

    def stream(self, lex, codes: np.ndarray, starts: np.ndarray):
        """Input pieces, targets, trigram and bigram logarithms, whether a target begins a word, and rows, for rows of words."""
        ids, begin, *logs = lex
        rows = len(starts) - 1
        size = np.diff(begin)[codes]
        total = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(begin[codes] - total[:-1], size)
        take += np.arange(int(total[-1]))
        pieces = np.diff(total[starts])
        n = int(total[-1]) + rows
        place = np.arange(len(take))  # targets: a row's pieces, then its end
        place += np.repeat(np.arange(rows), pieces)
        target = np.full(n, self.end, np.int32)
        target[place] = ids[take]
        lead = np.ones(n, bool)
        lead[place] = False
        opens = total[:-1] + np.repeat(np.arange(rows), np.diff(starts))
        lead[opens] = True
        # a word's end goes to what begins after it: the next word's first piece, or the text's end
        closes = total[1:] + np.repeat(np.arange(rows), np.diff(starts))
        out = []
        for whole, ends in (logs[:2], logs[2:]):
            gram = np.full(n, self.ngrams.first[-1], np.float32)
            gram[place] = whole[take]
            gram[closes] += ends[codes]
            out.append(gram)
        source = np.empty(n, np.int32)
        source[1:] = target[:-1]
        source[total[starts[:-1]] + np.arange(rows)] = self.end  # as input: the begin
        return source, target, *out, lead, np.repeat(np.arange(rows), pieces + 1)

    def attended(self, source, target, member, row) -> np.ndarray:
        """Logarithms of the attention model's probabilities of the targets; ``member``: their bigram logarithms."""
        net, n = self.attention, len(source)
        blocks = -(-n // STRIDE)
        pad = blocks * STRIDE - n
        x = np.concatenate([np.full(STRIDE, self.end), source, np.full(pad, self.end)])
        r = np.concatenate([np.full(STRIDE, -1), row, np.full(pad, row[-1] if n else -1)])
        goal = np.concatenate([net.classes[target], np.zeros(pad, np.int64)])
        out = np.empty(blocks * STRIDE, np.float32)
        causal, distance = _causal(STRIDE, 2 * STRIDE)
        scaled = net.q * np.float32(1 / math.sqrt(WIDTH))
        own_logits = net.e @ net.w + net.prior  # what a query gives its logits whatever it attends to
        ones, many = np.ones(2 * STRIDE, np.float32), np.ones(net.w.shape[1], np.float32)
        mixed = np.flatnonzero(r[: blocks * STRIDE : STRIDE] != r[2 * STRIDE - 1 :: STRIDE])  # blocks of several rows
        step = 64  # what a step takes stays in the cache
        gap = net.k.itemsize
        longest = lambda a: float(np.sqrt((a.astype(np.float64) ** 2).sum(axis=-1).max()))
        # bounds of the scores and of the logits: where they hold, nothing has to be held down
        tame = longest(scaled) * longest(net.k) + float(net.bias.max()) < 60
        tame_logits = float((net.v @ net.w).max(axis=0).max() + own_logits.max()) < 60  # what is attended to is a mean of values
        bias = np.where(causal, net.bias[distance], np.float32(-1e9))
        for b in range(0, blocks, step):
            e = min(blocks, b + step)
            some = x[b * STRIDE : (e + 1) * STRIDE]
            own = some[STRIDE:]
            shape, strides = (e - b, 2 * STRIDE, WIDTH), (STRIDE * WIDTH * gap, WIDTH * gap, gap)
            k, v = (np.lib.stride_tricks.as_strided(t.take(some, axis=0), shape, strides) for t in (net.k, net.v))
            s = np.matmul(scaled.take(own, axis=0).reshape(e - b, STRIDE, WIDTH), k.transpose(0, 2, 1))
            s += bias
            if not tame:
                np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            for m in mixed[np.searchsorted(mixed, b) : np.searchsorted(mixed, e)].tolist():
                rows = r[m * STRIDE : (m + 2) * STRIDE]
                s[m - b] *= rows[None, :] == rows[STRIDE:, None]
            o = np.matmul(s, v).reshape(-1, WIDTH)
            o /= np.maximum(s.reshape(-1, 2 * STRIDE) @ ones, 1e-30)[:, None]
            logits = o @ net.w
            logits += own_logits.take(own, axis=0)
            here = slice(b * STRIDE, e * STRIDE)
            top = logits[np.arange(len(logits)), goal[here]]
            if not tame_logits:
                np.minimum(logits, 60, out=logits)
            np.exp(logits, out=logits)
            out[here] = top - np.log(logits @ many)
        goal = net.classes[target]
        return out[:n] + member - net.prior[source, goal]

    def tokens(self, source, target, gram, member, lead, row) -> np.ndarray:
        """Logarithms of the mixture for every target."""
        attended = self.attended(source, target, member, row)
        attended += np.where(lead, self.mix[1], self.mix[0])
        other = gram + np.where(lead, self.rest[1], self.rest[0])
        top = np.maximum(attended, other)
        np.minimum(attended, other, out=other)
        other -= top
        return top + np.log1p(np.exp(other, out=other))


def class_prior(follow: np.ndarray, classes: np.ndarray, first: np.ndarray, n: int = CLASSES) -> np.ndarray:
    """Logarithm of each class's bigram probability after each piece, and at a text's begin (last row)."""
    size = len(follow)
    begin = np.bincount(classes, weights=np.exp(first), minlength=n)
    out = np.empty((size + 1, n))
    for c in range(n):
        out[:size, c] = follow[:, np.flatnonzero(classes[:size] == c)].sum(axis=1) + follow[:, size] * begin[c]
    out[size] = begin
    return np.log(np.maximum(out, 1e-30)).astype(np.float32)


# ------------------------------------------------------------------ training over the cluster

def windows_of(model: Model, runs: list[str], flags: np.ndarray, length: int = 2 * STRIDE, lexicon=None):
    """Windows of input pieces, targets (-1: none), trigram and bigram logarithms and kinds: all of the runs of words."""
    said = pa.array(runs, pa.string())
    some = pc.binary_length(said).to_numpy(zero_copy_only=False) > 0
    split = pc.split_pattern(said, " ")
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False) * some)]).astype(np.int64)
    words = split.filter(pa.array(some)).flatten().dictionary_encode()
    lex = lexicon(words.dictionary) if lexicon else model.lexicon(words.dictionary.to_pylist())
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    source, target, gram, member, lead, row = model.stream(lex, codes, starts)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(begin, len(row)))
    target = np.array(target)
    target[begin[(flags & 1) == 0]] = -1  # not the begin of a text
    target[(begin + size - 1)[(flags & 2) == 0]] = -1  # nor its end
    many = -(-size // length)  # a longer run gives windows one after another
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin, size = np.repeat(begin, many) + nth * length, np.repeat(size, many) - nth * length
    at = np.arange(length)[None, :]
    inside = at < size[:, None]
    place = np.minimum(begin[:, None] + at, len(row) - 1)
    x, t = np.where(inside, source[place], model.end), np.where(inside, target[place], -1)
    return x, t, gram[place], member[place], lead[place]


def _portions(batches):
    """Runs, flags and, where they are there, words priced by a join, so many at once; and whether these are all."""
    held, size, first = [], 0, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # s, n, maybe others
            if len(held) >= PORTION or size >= PORTION_BYTES:
                yield *_columns(held), False
                held, size, first = [], 0, False
            held.append(row)
            size += len(row[0])
    if held:
        yield *_columns(held), first


def _columns(rows: list[tuple]):
    return [r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows] if len(rows[0]) > 2 else None


def _trainer_of(shared, weights, head, seed: int, rate: float):
    """One local pass over a partition's runs, a portion after another: the summed weights, as one row."""

    def run(batches):
        model = _model(shared.value, weights)
        new, loss, total, shares = weights, 0.0, 0, np.zeros((2, len(_GRID)))
        for number, (runs, flags, others, whole) in enumerate(_portions(batches)):
            lexicon = lambda w, o=others: _lexicon(shared.value["key"], model, head.value)(w, o)[0]
            x, t, *told = windows_of(model, runs, flags, lexicon=lexicon)
            n = int((t >= 0).sum())
            if not n:
                continue
            again = max(1, min(18, PORTION // len(x))) if whole else 1  # a small corpus is gone over again
            for k in range(again):
                last = told if k == again - 1 else None
                new, more, found = train(new, model.attention.prior, model.attention.classes, x, t, seed + 100 * k + 1000 * number, rate, last)
            loss, total, shares = loss + more, total + n, shares + found
        if total:
            flat = np.concatenate([new[k].ravel() * np.float32(total) for k in Attention.NAMES])
            yield pa.RecordBatch.from_arrays(
                [pa.array([total]), pa.array([loss]), pa.array([flat.tobytes()], pa.binary()), pa.array([shares.ravel()], pa.list_(pa.float64()))], ["n", "loss", "w", "shares"]
            )

    return run


def _summed(batches):
    """One row for all of a partition's."""
    n, loss, flat, shares = 0, 0.0, None, np.zeros(2 * len(_GRID))
    for batch in batches:
        for k in range(batch.num_rows):
            w = np.frombuffer(batch.column("w")[k].as_buffer(), np.float32)
            flat = w.astype(np.float64) if flat is None else flat + w
            n, loss = n + batch.column("n")[k].as_py(), loss + batch.column("loss")[k].as_py()
            shares = shares + np.array(batch.column("shares")[k].as_py())
    if flat is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([loss]), pa.array([flat.astype(np.float32).tobytes()], pa.binary()), pa.array([shares], pa.list_(pa.float64()))], ["n", "loss", "w", "shares"]
        )


_models: dict[str, Model] = {}


def _model(shared: dict, weights: dict | None = None) -> Model:
    key = shared["key"]
    if key not in _models:
        _models.clear()
        ngrams = Ngrams(len(shared["said"][1]), *shared["ngrams"])  # without trigrams where there are too many
        attention = Attention(dict(weights or shared["weights"]), shared["prior"], shared["classes"])
        _models[key] = Model(shared["said"], ngrams, attention, shared.get("shares", (0.5, 0.5)))
    model = _models[key]
    if weights or "weights" in shared:
        model.attention.__dict__.update(weights or shared["weights"])
    if "shares" in shared:
        model.set_shares(shared["shares"])
    return model


def fit(docs: DataFrame, training, path: str | None = None) -> dict:
    """Counts, n-grams and weights from the rows of ``docs`` (doc_id, text) where ``training`` holds."""
    spark = docs.sparkSession
    said = load_ranks(path or default_path())
    size = len(said[1])
    gathered = docs.where(training).mapInArrow(C.tidied(_gather()), "kind int, s string, n long")
    gathered = C.written(gathered, "gathered")
    counted = gathered.where("kind = 0").groupBy(F.col("s").alias("w")).agg(F.sum("n").alias("n"))
    counted = C.written(counted, "words")
    ends = gathered.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    row = counted.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    total, distinct = (row["n"] or 0) + ends, row["v"] + (ends > 0)
    least = _frequent(counted, HEAD)
    head = counted.where(F.col("n") >= least).toArrow()
    pieces = spark.sparkContext.broadcast(said)
    grams = counted.mapInArrow(C.tidied(_trigrams_of(pieces)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    grams = C.written(grams, "trigrams")
    base = size + 1
    bi = grams.groupBy((F.col("key") % (base * base)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # (PIECES + 1)^2 at most
    first = _first_counts(counted, pieces, size, ends)
    whole = grams.count() <= TRIGRAMS
    tri = (grams if whole else grams.limit(0)).toArrow()
    arrays = []
    for t in (tri, bi):
        keys, n = np.array(t.column("key"), np.int64), np.array(t.column("n"), np.int64)
        order = np.argsort(keys)
        arrays += [keys[order], n[order]]
    ngrams, own = Ngrams(size, *arrays, first), Pieces(said)
    follow = ngrams.bigrams()
    classes = classes_of(follow, np.exp(ngrams.first), own.first)
    prior = class_prior(follow, classes, ngrams.first)
    del follow
    shared = {"key": C.uuid.uuid4().hex, "said": said, "ngrams": (*arrays, first), "classes": classes, "prior": prior}
    priced = None if whole else Priced(head.column("w").combine_chunks(), grams, size, pieces)
    weights, shares, told_bits = Attention.fresh(size, CLASSES), np.array([0.5, 0.5]), None
    runs = gathered.where("kind = 1").select("s", "n")
    if not runs.isEmpty():
        n = runs.count()
        trainers = max(1, min(TRAINERS, n // PORTION), -(-n // (LONG * PORTION)))
        # dealt once, in an order that is the same again; each round takes another third
        part = F.pmod(F.xxhash64("s", "n"), F.lit(len(RATES))).cast("int")
        dealt, names = runs.withColumn("part", part), ["s", "n"]
        if not whole:
            dealt = priced.joined(C.written(dealt.withColumn("row", F.monotonically_increasing_id()), "numbered"), "s")
            names.append("others")
        dealt = dealt.select(*names, "part").repartition(trainers).sortWithinPartitions("part", F.xxhash64("n", "s"), "s", "n")
        dealt = C.written(dealt, "runs")
        sent = spark.sparkContext.broadcast(shared)
        known = priced.head if priced else spark.sparkContext.broadcast((head.column("w").combine_chunks(), None))
        schema, fitted, seen, loss = "n long, loss double, w binary, shares array<double>", np.zeros((2, len(_GRID))), 0, 0.0
        for k, rate in enumerate(RATES):
            third = dealt.where(F.col("part") == k).select(*names)
            told = third.mapInArrow(C.tidied(_trainer_of(sent, weights, known, k, rate)), schema)
            if trainers > TRAINERS:  # the driver gets about the root of their number
                told = told.repartition(math.isqrt(trainers)).mapInArrow(C.tidied(_summed), schema)
            told = told.collect()
            n = sum(r["n"] for r in told)  # a row from each trainer or sum of them
            if not n:
                continue
            fitted += sum(np.array(r["shares"]).reshape(2, -1) for r in told)
            seen, loss = seen + n, loss + sum(r["loss"] for r in told)
            flat = sum(np.frombuffer(r["w"], np.float32).astype(np.float64) for r in told) / n
            at = 0
            for name in Attention.NAMES:
                w = weights[name]
                weights[name] = flat[at : at + w.size].astype(np.float32).reshape(w.shape)
                at += w.size
        shares, told_bits = _GRID[fitted.argmax(axis=1)], loss / max(seen, 1) / math.log(2)
        sent.destroy()
        if not priced:
            known.destroy()
    return shared | {"weights": weights, "shares": tuple(map(float, shares)), "head": head, "least": least, "total": total, "distinct": distinct, "ends": ends, "class_bits": told_bits, "counted": counted, "priced": priced}


def _first_counts(counted: DataFrame, pieces, size: int, ends: int) -> np.ndarray:
    def run(batches):
        own = Pieces(pieces.value)
        out = np.zeros(size + 1, np.int64)
        for batch in batches:
            words, n = batch.column("w").to_pylist(), np.array(batch.column("n"))
            for a in range(0, len(words), 20_000):
                ids, begin = own.words(words[a : a + 20_000])
                out += np.bincount(ids[begin[:-1]], weights=n[a : a + 20_000], minlength=size + 1).astype(np.int64)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["piece", "n"])

    out = np.zeros(size + 1)
    for piece, n in counted.mapInArrow(C.tidied(run), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[piece] = n
    out[size] = ends
    return out


def _chosen(lexicon: list, known: np.ndarray, more: list) -> list:
    """A lexicon of some words: those with a place in ``lexicon`` from there, the others from ``more`` in order."""
    head = known >= 0
    place = known[head]
    size, first = np.empty(len(known), np.int64), np.zeros(len(known), np.int64)
    size[head], size[~head] = np.diff(lexicon[1])[place], np.diff(more[1])
    first[head] = lexicon[1][place]
    begin = np.concatenate([[0], np.cumsum(size)])
    old = np.repeat(head, size)
    take = (np.repeat(first - begin[:-1], size) + np.arange(int(begin[-1])))[old]
    out = [None, begin]
    for k in (0, 2, 3, 4, 5):
        words = k in (3, 5)  # a value for each word, else for each piece
        whole = np.empty(len(known) if words else int(begin[-1]), lexicon[k].dtype)
        whole[head if words else old] = lexicon[k][place if words else take]
        whole[~(head if words else old)] = more[k]
        if k:
            out.append(whole)
        else:
            out[0] = whole
    return out


class Lexicon:
    """The lexicon of frequent words, and of others: with trigram prices from a join, or by the model's own trigrams."""

    def __init__(self, model: Model, words: pa.Array, three=None):
        self.model, self.lookup, self.joined = model, Lookup(words), three is not None
        self.whole = model.lexicon(words.to_pylist(), three)

    def __call__(self, said: pa.Array, others: list | None) -> tuple[list, np.ndarray]:
        """The lexicon of ``said``, and places in that of frequent words; ``others``: rows' lists of priced words."""
        known = self.lookup(said)
        more, three = said.filter(pa.array(known < 0)).to_pylist(), None
        if self.joined:
            prices = {o["w"]: o for row in others for o in row or ()}
            three = [np.array([v for w in more for v in prices[w][k]], np.float64) for k in ("a", "b")]
        return _chosen(self.whole, known, self.model.lexicon(more, three)), known


_lexicons: dict[str, Lexicon] = {}


def _lexicon(key: str, model: Model, head: tuple) -> Lexicon:
    if key not in _lexicons:  # once for a worker, not for each task
        _lexicons.clear()
        _lexicons[key] = Lexicon(model, *head)
    return _lexicons[key]


# ------------------------------------------------------------------ trigram prices from the whole table

def _entries_of(said):
    """(id, at, key, context) for every piece of words after the first, and their ends."""

    def run(batches):
        pieces = Pieces(said.value)
        base = pieces.size + 1
        for batch in batches:
            words, number = batch.column("w").to_pylist(), batch.column("id")
            for a in range(0, len(words), 20_000):
                ids, begin = pieces.words(words[a : a + 20_000])
                x, y, z, owner = _contexts(ids, begin, pieces.size)
                at = np.arange(len(owner)) - begin[owner]  # as many as the word has pieces
                context = x * base + y
                yield pa.RecordBatch.from_arrays([number.slice(a, 20_000).take(pa.array(owner)), pa.array(at), pa.array(context * base + z), pa.array(context)], ["id", "at", "key", "context"])

    return run


def _others_of(head, text: str):
    def run(batches):
        lookup = Lookup(head.value[0])
        for batch in batches:
            for part, offsets, raw in C.slices(batch, text):
                codes, said, begin = _split(offsets, raw)
                codes_row = np.repeat(np.arange(part.num_rows), np.diff(begin))
                some = lookup(said)[codes] < 0
                key = np.unique(codes_row[some] * max(1, len(said)) + codes[some])
                row, code = np.divmod(key, max(1, len(said)))
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(row)), said.take(pa.array(code))], ["row", "w"])

    return run


class Priced:
    """Words' trigram prices, where the table of trigrams is too large to broadcast: for each entry (see ``_contexts``)
    a and b, its probability being a and b times that of the bigram."""

    def __init__(self, words: pa.Array, grams: DataFrame, size: int, pieces):
        self.grams, self.pieces, self.spark = grams, pieces, grams.sparkSession
        context = F.floor(F.col("key") / F.lit(size + 1)).cast("long").alias("context")
        contexts = grams.groupBy(context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        self.contexts = C.written(contexts, "contexts")
        told = self.of(self.spark.createDataFrame(pa.table({"w": words}))).toArrow()
        place = Lookup(told.column("w").combine_chunks())(words)
        three = [np.array(told.column(k).combine_chunks().take(pa.array(place)).flatten(), np.float64) for k in ("a", "b")]
        self.head = self.spark.sparkContext.broadcast((words, three))

    def of(self, words: DataFrame) -> DataFrame:
        """(w, a, b) for distinct words."""
        words = C.written(words.withColumn("id", F.monotonically_increasing_id()), "numbered")  # a word may be long
        rows = C.written(words.mapInArrow(C.tidied(_entries_of(self.pieces)), "id long, at long, key long, context long"), "entries")
        rows = C.checked_join(C.checked_join(rows, self.contexts, "context", "left"), self.grams, "key", "left")
        a = F.coalesce(F.greatest(F.col("n") - F.lit(DISCOUNT), F.lit(0.0)) / F.col("total"), F.lit(0.0)).alias("a")
        b = F.coalesce(F.lit(DISCOUNT) * F.col("kinds") / F.col("total"), F.lit(1.0)).alias("b")
        rows = rows.select("id", F.struct("at", a, b).alias("e")).groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("e"))
        return words.join(rows, "id").select("w", F.col("e.a").alias("a"), F.col("e.b").alias("b"))

    def joined(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` (with a number ``row``) and ``others``: their words that aren't frequent, with prices."""
        others = C.written(rows.select("row", text).mapInArrow(C.tidied(_others_of(self.head, text)), "row long, w string"), "others")
        prices = C.written(self.of(others.select("w").distinct()), "prices")
        told = C.checked_join(others, prices, "w", "inner").groupBy("row").agg(F.collect_list(F.struct("w", "a", "b")).alias("others"))
        return rows.join(told, "row", "left")


_heads: dict[str, np.ndarray] = {}


def _scorer_of(shared, head):
    def run(batches):
        model = _model(shared.value)
        words, counts, z, ends, three = head.value
        key = shared.value["key"]
        lexicon = _lexicon(key, model, (words, three))
        if key not in _heads:
            _heads.clear()
            _heads[key] = np.log10(np.append(counts + 0.1, 0.1) / z)  # the last: a word without a place
        logs = _heads[key]
        for batch in batches:
            for part, offsets, raw in C.slices(batch, "text"):
                codes, said, begin = _split(offsets, raw)
                lex, known = lexicon(said, part.column("others").to_pylist() if three else None)
                stream = model.stream(lex, codes, begin)
                score = np.bincount(stream[-1], weights=model.tokens(*stream), minlength=part.num_rows) / math.log(10)
                is_head = known[codes] >= 0
                row = np.repeat(np.arange(part.num_rows), np.diff(begin))
                n_known = np.bincount(row[is_head], minlength=part.num_rows) + int(ends > 0)
                base = np.bincount(row, weights=logs[known[codes]], minlength=part.num_rows)
                base = base + math.log10((ends + 0.1) / z)
                key, times = np.unique(row[~is_head] * len(said) + codes[~is_head], return_counts=True) if len(said) else (np.zeros(0, np.int64),) * 2
                cuts = np.searchsorted(key, np.arange(part.num_rows + 1) * max(1, len(said)))
                tail = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), said.take(pa.array(key % max(1, len(said)))))
                often = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(times.astype(np.int64)))
                columns = [part.column(k) for k in range(part.num_columns) if part.schema.names[k] not in ("text", "others")]
                names = [n for n in part.schema.names if n not in ("text", "others")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(begin) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), tail, often],
                    [*names, "n_tokens", "n_known", "base_score", "score", "tail", "often"],
                )

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    z = model["total"] + 0.1 * (model["distinct"] + 1)
    sent = spark.sparkContext.broadcast({k: model[k] for k in ("key", "said", "ngrams", "classes", "prior", "weights", "shares")} | {"key": model["key"] + "s"})
    words = model["head"]
    head = spark.sparkContext.broadcast((words.column("w").combine_chunks(), np.array(words.column("n"), np.float64), z, model["ends"], model["priced"] and model["priced"].head.value[1]))
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("tail", T.ArrayType(T.StringType())), ("often", T.ArrayType(T.LongType()))]
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([keyed.schema["doc_id"], keyed.schema["row"], *(T.StructField(*f) for f in fields)])
    if model["priced"]:
        keyed = model["priced"].joined(C.written(keyed, "keyed"), "text").select("doc_id", "text", "row", "others")
    rows = C.written(keyed.mapInArrow(C.tidied(_scorer_of(sent, head)), schema), "scored")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "often")).alias("t")).select("row", F.col("t.tail").alias("w"), F.col("t.often").alias("often"))
    rare = model["counted"].where(F.col("n") < model["least"])
    gain = F.col("often") * (F.log10((F.col("n") + 0.1) / F.lit(0.1)))
    more = tail.join(rare, "w").groupBy("row").agg(F.sum("often").alias("more_known"), F.sum(gain).alias("more_base"))
    return rows.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that aren't held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), FOLDS)
    model = fit(docs, ~held)
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["total"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
