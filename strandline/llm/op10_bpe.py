"""BPE encoding by backtracking, exact merges in linear time, and decoding by an offset table.

An Aho-Corasick automaton over the reversed tokens, walked from a piece's end,
gives the longest token that begins at each symbol. The encoder takes the
longest token that may follow the one before; a pair may stand side by side if
no merge across their border would have come before the merges that made them
(walked for a pair, then remembered in a table of fixed size). If no token fits
it steps back. All tables are arrays, made on the driver and broadcast: they
are bounded by the vocabulary. All distinct pieces of a part of the input go
forward together, a symbol or a token a step; what few are left, long ones, are
walked one by one. Pieces are the splits of white-space-free chunks, so distinct
chunks are encoded once for each part of the input.

Defined cases: null and empty texts have no ids and decode to an empty string;
special tokens in a text become their ids; texts of any length are encoded
whole; extra columns pass through, and clashing names get underscores in front.
"""

from __future__ import annotations

import io
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Pairs that a worker remembers (a power of two); own positions of a segment of a long piece; pieces that are few.
REMEMBER, SEGMENT, FEW = 1 << 19, 128, 24
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BLANK = regex.compile("[\t-\r ]+")
_LETTER, _DIGIT, _MARK = 0, 1, 2
_KIND = np.full(256, _MARK, np.uint8)
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x30:0x3A] = _DIGIT


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    at = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [at[b] for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What encoder and decoder need of a tokenizer file: bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    pattern = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "vocab": model["vocab"], "merges": merges, "suffix": model.get("end_of_word_suffix") or "",
        "special": {t["content"]: t["id"] for t in said["added_tokens"]}, "pattern": pattern,
    }


# ------------------------------------------------------------------ tables, made once on the driver

def _displaced(rows: dict[int, list[tuple[int, int]]], n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows laid over each other: the value of (row, column) stands at place base[row] + column, if owner says so."""
    size = 2 * sum(map(len, rows.values())) + 4 * width + 1024
    owner, value, base = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(n, np.int32)
    free = np.ones(size, bool)
    low, last, many = width, 0, 0  # no place below low is free that a row of one column could take
    for row in sorted(rows, key=lambda r: -len(rows[r])):
        columns = np.array(sorted(c for c, _ in rows[row]))
        if len(columns) != many:
            many, last = len(columns), last // 2  # rows of as many columns go on from where the one before fitted
        at, step = last, 64
        if len(columns) == 1:
            while not free[low]:
                low += 1
            at = low - int(columns[0])
        else:
            while True:
                if at + step + int(columns[-1]) >= len(free):
                    more = len(free)
                    owner, value = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (owner, value))
                    free = np.concatenate([free, np.ones(more, bool)])
                fits = free[np.arange(at, at + step)[:, None] + columns].all(axis=1)
                if fits.any():
                    last = at = at + int(fits.argmax())
                    break
                at, step = at + step, min(4096, 2 * step)
        base[row] = at
        for c, v in rows[row]:
            owner[at + c], value[at + c], free[at + c] = row, v, False
    end = int(base.max()) + width + 1
    pad = max(0, end - len(owner))
    return base, np.pad(owner, (0, pad), constant_values=-1)[:end], np.pad(value, (0, pad), constant_values=-1)[:end]


def tables(said: dict) -> dict[str, np.ndarray]:
    """The arrays of an encoder: own ids are in the order of the merges."""
    vocab, merges, suffix = said["vocab"], said["merges"], said["suffix"]
    made = {a + b for a, b in merges}
    first = sorted((t for t in vocab if t not in made), key=vocab.get)
    own = {t: k for k, t in enumerate(first)}
    symbols = byte_symbols()  # a byte within a piece is a symbol by itself, a piece's last one 256 further
    known = {c: (b,) for b, c in enumerate(symbols)} | {c + suffix: (256 + b,) for b, c in enumerate(symbols) if suffix}
    spelled = [known.get(t) for t in first]  # None: no text has it
    left, right = list(range(len(first))), list(range(len(first)))
    pairs: dict[int, list[tuple[int, int]]] = {}
    for a, b in merges:
        k, x, y = len(spelled), own[a], own[b]
        own[a + b] = k
        spelled.append(spelled[x] + spelled[y] if spelled[x] and spelled[y] else None)
        left.append(x)
        right.append(y)
        pairs.setdefault(x, []).append((y, k))
    n = len(spelled)
    outer = np.zeros(n, np.uint32)
    for t, k in own.items():
        outer[k] = vocab[t]
    out = dict(zip(("pair_base", "pair_owner", "pair_made"), _displaced(pairs, n, n), strict=True))
    out |= {"outer": outer, "left": np.array(left, np.int32), "right": np.array(right, np.int32), "size": np.array([len(s or ()) for s in spelled], np.int32)}
    # a token that its own letters do not merge to never comes out
    ids = np.arange(n, dtype=np.int32)
    real = (out["left"] == ids) | may_follow(out, out["left"], out["right"], ids)
    tokens = {spelled[k]: k for k in np.flatnonzero(real).tolist() if spelled[k]}
    shorter = np.full(n, -1, np.int32)
    for s, k in tokens.items():
        shorter[k] = next((tokens[s[:m]] for m in range(len(s) - 1, 0, -1) if s[:m] in tokens), -1)
    # the automaton of the reversed tokens
    goto: list[dict[int, int]] = [{}]
    ends = [-1]
    for s, k in tokens.items():
        at = 0
        for c in reversed(s):
            if (after := goto[at].get(c)) is None:
                after = goto[at][c] = len(goto)
                goto.append({})
                ends.append(-1)
            at = after
        ends[at] = k
    fail = [0] * len(goto)
    line = list(goto[0].values())
    for at in line:  # grows: by breadth
        for c, after in goto[at].items():
            back = fail[at]
            while back and c not in goto[back]:
                back = fail[back]
            fail[after] = goto[back].get(c, 0)
            if ends[after] < 0:
                ends[after] = ends[fail[after]]
            line.append(after)
    out |= dict(zip(("goto_base", "goto_owner", "goto_next"), _displaced({k: list(g.items()) for k, g in enumerate(goto) if g}, len(goto), 512), strict=True))
    return out | {"fail": np.array(fail, np.int32), "longest": np.array(ends, np.int32), "shorter": shorter}


def may_follow(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
    """Whether tokens a and b, side by side, stay two; with ``below``, until the merge that makes ``below``."""
    fits = np.ones(len(a), bool)
    at = np.arange(len(a))
    a, b = a.astype(np.int32), b.astype(np.int32)
    limit = np.full(len(a), np.iinfo(np.int32).max, np.int32) if below is None else below.astype(np.int32)
    while len(at):
        place = t["pair_base"][a] + b
        made = np.where(t["pair_owner"][place] == a, t["pair_made"][place], np.iinfo(np.int32).max)
        apart = made >= limit
        fits[at[~apart]] = False
        # undo the later of the two merges; where that token is a symbol, the other one's
        x, y = t["right"][a], t["left"][b]
        by_a = ((a > b) & (x != a)) | ((a <= b) & (y == b))
        stop = (x == a) & (y == b)
        limit = np.where(by_a, a, b + 1)
        a, b = np.where(by_a, x, a), np.where(by_a, b, y)
        on = apart & ~stop
        at, a, b, limit = at[on], a[on], b[on], limit[on]
    return fits


_made: dict[str, bytes] = {}


def packed_tables(path: str) -> bytes:
    if path not in _made:
        said = load_vocabulary(path)
        known = {i: t for t, i in said["vocab"].items()} | {i: t for t, i in said["special"].items()}
        texts = [(known[i] + " ").encode() if i in known else b"" for i in range(max(known) + 1)]
        rest = json.dumps({"special": said["special"], "pattern": said["pattern"], "suffix": bool(said["suffix"])}).encode()
        held = io.BytesIO()
        np.savez_compressed(
            held, rest=np.frombuffer(rest, np.uint8), texts=np.frombuffer(b"".join(texts), np.uint8),
            offsets=np.cumsum([0, *map(len, texts)]).astype(np.int32), **tables(said),
        )
        _made.clear()
        _made[path] = held.getvalue()
    return _made[path]


# ------------------------------------------------------------------ encoding

class Encoder:
    def __init__(self, t: dict[str, np.ndarray]):
        rest = json.loads(t["rest"].tobytes())
        self.t = t
        self.shift = 256 if rest["suffix"] else 0
        self.reach = int(t["size"].max())
        self.special = rest["special"]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pieces = regex.compile(rest["pattern"].replace(r"[^\s", f"[^{_SPACE}"))
        #: Whether the pattern is the one whose pieces ``_ascii`` finds by arrays.
        self.plain = rest["pattern"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.known = np.full(REMEMBER, -1, np.int64)
        self.views = {k: memoryview(np.ascontiguousarray(t[k])) for k in ("size", "shorter")}

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may stand after a: remembered, or walked."""
        key = (a.astype(np.int64) << 31) | b
        slot = (key * np.int64(0x9E3779B97F4A7C1) >> np.int64(40)) & np.int64(REMEMBER - 1)
        held = self.known[slot]
        fits = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            walked = may_follow(self.t, keys >> 31, keys & np.int64((1 << 31) - 1))
            fits[new] = walked[back]
            self.known[slot[new]] = key[new] << 1 | fits[new]
        return fits

    def _ascii(self, data: np.ndarray, begin: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Where pieces begin in lower-cased chunks one after another: at changes of kind, at digits, around contractions."""
        n = len(data)
        kind = _KIND[data]
        cut = np.ones(n, bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[begin] = True
        some = np.flatnonzero((data == 0x27) & cut & inside)
        if len(some):
            some = some[(some + 1 < n) & ~np.isin(some + 1, begin)]
            padded = np.concatenate([data, np.zeros(2, np.uint8)])
            x, y = padded[some + 1], padded[some + 2]
            chunk = np.searchsorted(begin, some, side="right")
            end = np.append(begin, n)[chunk]
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            two = (some + 2 < end) & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
            for which, size in ((one, 1), (two, 2)):
                at = some[which]
                cut[at + 1] = False
                after = at + 1 + size
                cut[after[after < n]] = True
        return np.flatnonzero(cut & inside)

    def split(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the pieces of chunks (texts without white space and special tokens), the pieces' begins and ends, and their chunks."""
        offsets, raw = C.strings(chunks)
        data = C._LOWER[raw[int(offsets[0]) : int(offsets[-1])]]
        offsets = offsets - offsets[0]
        full = np.flatnonzero(np.diff(offsets))
        beyond = np.concatenate([[0], np.cumsum(data >= 0x80)])
        odd = np.diff(beyond[offsets]) > 0 if self.plain else np.diff(offsets) > 0
        inside = np.repeat(~odd, np.diff(offsets))
        begin = self._ascii(data, offsets[:-1][full], inside)
        owner = np.searchsorted(offsets, begin, side="right") - 1
        end = np.append(begin[1:], len(data))
        end = np.minimum(end, offsets[owner + 1])
        strange = np.flatnonzero(odd)
        if len(strange):
            more, sizes, owners = [], [], []
            for k, text in zip(strange.tolist(), chunks.take(pa.array(strange)).to_pylist(), strict=True):
                for p in self.pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()):
                    p = p.encode()
                    more.append(p)
                    sizes.append(len(p))
                    owners.append(k)
            at = len(data) + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
            begin, end, owner = np.concatenate([begin, at[:-1]]), np.concatenate([end, at[1:]]), np.concatenate([owner, np.array(owners, np.int64)])
            order = np.argsort(owner, kind="stable")
            begin, end, owner = begin[order], end[order], owner[order]
        return data, begin, end, owner

    def matches(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place of the pieces: the automaton goes over all of them from their ends."""
        t, longest = self.t, np.full(len(data) + 1, -1, np.int32)
        many = np.maximum(1, -(-(end - begin) // SEGMENT))
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        low, last = np.repeat(begin, many) + nth * SEGMENT, np.repeat(end, many)
        own = np.minimum(low + SEGMENT, last)
        high = np.minimum(own + self.reach - 1, last)  # no token reaches further
        order = np.argsort(low - high, kind="stable")
        low, own, high, last = low[order], own[order], high[order], last[order]
        size = high - low
        state = np.zeros(len(low), np.int32)
        base, owner, after, fail, ends = t["goto_base"], t["goto_owner"], t["goto_next"], t["fail"], t["longest"]
        m, steps = len(low), int(size[0]) if len(size) else 0
        for step in range(steps):
            while size[m - 1] <= step:
                m = int(np.searchsorted(-size[:m], -step, side="left"))
            place = high[:m] - 1 - step
            c = data[place].astype(np.int32)
            if self.shift:
                c += np.where(place == last[:m] - 1, np.int32(self.shift), np.int32(0))
            s = state[:m]
            at = base[s] + c
            good = owner[at] == s
            new = np.where(good, after[at], 0)
            rest = np.flatnonzero(~good & (s != 0))
            s = s[rest]
            while len(rest):
                s = fail[s]
                at = base[s] + c[rest]
                good = owner[at] == s
                new[rest[good]] = after[at[good]]
                on = ~good & (s != 0)
                rest, s = rest[on], s[on]
            state[:m] = new
            mine = place < own[:m]
            longest[place[mine]] = ends[new[mine]]
        return longest

    def merge(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own ids of the pieces, those of a piece from its begin on, and how many each has."""
        longest = self.matches(data, begin, end)
        size, shorter = self.t["size"], self.t["shorter"]
        out, n = np.zeros(len(data), np.int32), np.ones(len(begin), np.int64)
        token = longest[begin]
        whole = size[token] == end - begin
        out[begin[whole]] = token[whole]
        act = np.flatnonzero(~whole)
        closed = np.zeros(len(data) + 1, bool)  # places from which there is no way on
        at, depth, before, token = begin[act].copy(), np.zeros(len(act), np.int64), np.full(len(act), -1, np.int32), token[act]
        while len(act) > FEW:
            first, stop = begin[act], end[act]
            to = at + size[token]
            fits = (to == stop) | ~closed[to]
            some = np.flatnonzero(fits & (before >= 0))
            fits[some] = self.follows(before[some], token[some])
            # taken
            went = np.flatnonzero(fits)
            out[(first + depth)[went]] = token[went]
            depth[went] += 1
            before[went], at[went] = token[went], to[went]
            # not taken: a shorter one, or a step back
            stay = np.flatnonzero(~fits)
            less = shorter[token[stay]]
            back = stay[less < 0]
            token[went] = longest[at[went]]  # at a piece's end: not used
            token[stay] = less
            if len(back):
                closed[at[back]] = True
                depth[back] -= 1
                token[back] = out[first[back] + depth[back]]
                at[back] -= size[token[back]]
                before[back] = np.where(depth[back] > 0, out[first[back] + np.maximum(depth[back] - 1, 0)], -1)
            done = at == stop
            if done.any():
                n[act[done]] = depth[done]
                on = ~done
                act, at, depth, before, token = act[on], at[on], depth[on], before[on], token[on]
        for k, a, d, b, x in zip(act.tolist(), at.tolist(), depth.tolist(), before.tolist(), token.tolist(), strict=True):
            n[k] = self._alone(int(begin[k]), int(end[k]), a, d, b, x, memoryview(longest), memoryview(out), closed)
        return out, n

    def _alone(self, first: int, stop: int, at: int, depth: int, before: int, token: int, longest, out, closed) -> int:
        """One piece on from where it stands; how many ids it has."""
        sizes, shorter, remembered = self.views["size"], self.views["shorter"], {}
        while at < stop:
            while True:
                to = at + sizes[token]
                if to == stop or not closed[to]:
                    if before < 0:
                        break
                    if (fits := remembered.get((before, token))) is None:
                        if len(remembered) > REMEMBER:
                            remembered.clear()
                        fits = remembered[before, token] = bool(self.follows(np.array([before]), np.array([token]))[0])
                    if fits:
                        break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                closed[at] = True
                depth -= 1
                token = out[first + depth]
                at -= sizes[token]
                before = out[first + depth - 1] if depth else -1
            out[first + depth] = token
            depth += 1
            before, at, token = token, to, longest[to]
        return depth

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and where each one's begin (and the end)."""
        data, begin, end, owner = self.split(texts)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        own, n = self.merge(data, begin, end)
        ids = self.t["outer"][own[_runs(begin, n)]]
        count = np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(count)])

    def whole(self, text: str) -> bytes:
        """The ids of any text: special tokens first, then chunk by chunk."""
        out, at = [], 0
        plain = lambda s: self.chunks(pa.array(_BLANK.split(s), pa.string()))[0].astype("<u4").tobytes()
        for m in self.specials.finditer(text):
            out += [plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, plain(text[at:])])

    def column(self, offsets: np.ndarray, raw: np.ndarray) -> pa.Array:
        """The packed ids of some rows."""
        n = len(offsets) - 1
        base = int(offsets[0])
        texts = pa.StringArray.from_buffers(n, pa.py_buffer((offsets - base).astype(np.int32)), pa.py_buffer(raw[base : int(offsets[-1])]))
        odd = np.zeros(n, bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(texts)
        codes = pc.dictionary_encode(split.flatten())
        ids, begin = self.chunks(codes.dictionary)
        code = codes.indices.to_numpy(zero_copy_only=False)
        size = np.diff(begin)[code] if len(code) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = ids[_runs(begin[code], size)].astype("<u4") if len(code) else np.zeros(0, "<u4")
        ends = 4 * np.concatenate([[0], np.cumsum(size)])[at]
        out = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
        if odd.any():
            values = out.to_pylist()
            for r in np.flatnonzero(odd).tolist():
                values[r] = self.whole(texts[r].as_py())
            out = pa.array(values, pa.binary())
        return out


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each run of so many places."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - size), size) + np.arange(total)


class Decoder:
    """Token texts one after another; each id's place is in a table of offsets."""

    def __init__(self, t: dict[str, np.ndarray]):
        self.texts, self.offsets = t["texts"], t["offsets"].astype(np.int64)

    def column(self, packed: pa.Array) -> pa.Array:
        offsets, raw = C.strings(pc.cast(packed, pa.binary()).view(pa.string()))
        ids = raw[int(offsets[0]) : int(offsets[-1])].view("<u4").astype(np.int64) if len(raw) else np.zeros(0, np.int64)
        ids = np.where(ids < len(self.offsets) - 1, ids, -1)
        size = np.where(ids >= 0, np.diff(self.offsets)[ids], 0)
        data = self.texts[_runs(self.offsets[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[(offsets - offsets[0]) // 4]
        full = np.flatnonzero(np.diff(at))
        keep = np.ones(len(data), bool)
        keep[at[1:][full] - 1] = False  # the space behind a text's last token
        gone = np.zeros(len(at), np.int64)
        gone[full + 1] = 1
        at = at - np.cumsum(gone)
        return pa.StringArray.from_buffers(len(packed), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[keep]))


# ------------------------------------------------------------------ frames

_opened: dict[str, tuple] = {}


def opened(packed: bytes) -> tuple[Encoder, Decoder]:
    with np.load(io.BytesIO(packed)) as held:
        t = {k: held[k] for k in held.files}
    return Encoder(t), Decoder(t)


def _tools(key: str, sent) -> tuple[Encoder, Decoder]:
    """Once for a worker."""
    if key not in _opened:
        _opened.clear()
        _opened[key] = opened(sent.value)
    return _opened[key]


def _sent(spark: SparkSession, path: str | None) -> tuple[str, object]:
    C.bounded_batches(spark)
    return path or default_path(), spark.sparkContext.broadcast(packed_tables(path or default_path()))


def encode(docs: DataFrame, path: str | None = None, *, text_col: str = "text", name: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text, packed as little-endian unsigned 32-bit numbers, and, where
    ``decoded`` names a column, with what they decode to, in one pass."""
    key, sent = _sent(docs.sparkSession, path)
    name = C.free_name(docs.columns, name)
    names = [name] if decoded is None else [name, C.free_name([*docs.columns, name], decoded)]

    def run(batches):
        for batch in batches:
            encoder, decoder = _tools(key, sent)
            for part, offsets, raw in C.slices(batch, text_col):
                ids = encoder.column(offsets, raw)
                more = [ids] if decoded is None else [ids, decoder.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *names])

    kinds = zip(names, (T.BinaryType(), T.StringType()), strict=False)
    return docs.mapInArrow(C.tidied(run), C.with_fields(docs.schema, *kinds))


def unpacked(ids) -> F.Column:
    """A packed column as an array of longs, by SQL functions."""
    part = lambda h, k: F.substring(h, k, 2)
    one = lambda h: F.conv(F.concat(part(h, 7), part(h, 5), part(h, 3), part(h, 1)), 16, 10).cast("long")
    return F.transform(F.regexp_extract_all(F.hex(ids), F.lit("(.{8})"), F.lit(1)), one)


def decode(frame: DataFrame, path: str | None = None, *, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``frame`` with the text of packed ids: tokens as the vocabulary spells them, a space between each.

    Null ids decode to an empty string, ids that the vocabulary lacks to nothing.
    """
    key, sent = _sent(frame.sparkSession, path)
    name = C.free_name(frame.columns, name)

    def run(batches):
        for batch in batches:
            _, decoder = _tools(key, sent)
            ids = pc.fill_null(batch.column(ids_col), b"")
            for a, b in C.pieces(C.strings(ids.view(pa.string()))[0]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.column(ids.slice(a, b - a))], [*part.schema.names, name])

    return frame.mapInArrow(C.tidied(run), C.with_fields(frame.schema, (name, T.StringType())))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids (packed), their number and hash, and the hash of the text that they decode to.

    Columns of ``docs`` pass through; names that clash get underscores in front.
    """
    taken = list(docs.columns)
    names = []
    for n in ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"):
        names.append(C.free_name([*taken, *names], n))
    ids, back, count, ids_hash, back_hash = names
    found = encode(docs, path, name=ids, decoded=back)
    return found.select(
        *[F.col(f"`{c}`") for c in taken], ids, F.floor(F.length(ids) / 4).cast("long").alias(count),
        F.sha2(F.col(ids), 256).alias(ids_hash), F.sha2(F.col(back), 256).alias(back_hash),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids", "text")
