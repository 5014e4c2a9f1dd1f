"""Sequential coders in Python: state is carried from symbol to symbol, so a block is what runs in parallel.

Every encoder has its decoder; nothing here knows of Spark.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np

#: Fixed values of the residual model: buckets, clamp of contexts, growth and limit of counts for buckets and top bits.
BUCKETS, CLAMP, GROW, LIMIT, TOP_GROW, TOP_LIMIT = 65, 16, 32, 1 << 14, 24, 1 << 13
#: Start and share of the running mean of the adaptive Rice coder: fixed values.
RICE_START, RICE_SHARE = 16.0, 0.02
_MASK = (1 << 64) - 1


class RangeEncoder:
    """A range coder that carries through bytes held back."""

    def __init__(self):
        self.low, self.range, self.held, self.out, self.first = 0, 0xFFFFFFFF, 0, bytearray(), True
        self.byte = 0

    def encode(self, cum: int, freq: int, total: int) -> None:
        step = self.range // total
        self.low += step * cum
        self.range = step * freq
        while self.range < 1 << 24:
            self.range <<= 8
            self._shift()

    def _shift(self) -> None:
        if self.low < 0xFF000000 or self.low > 0xFFFFFFFF:
            carry = self.low >> 32
            if not self.first:
                self.out.append((self.byte + carry) & 255)
            for _ in range(self.held):
                self.out.append((255 + carry) & 255)
            self.held, self.first = 0, False
            self.byte = (self.low >> 24) & 255
        else:
            self.held += 1
        self.low = (self.low & 0x00FFFFFF) << 8

    def bits(self, value: int, n: int) -> None:
        while n > 16:
            n -= 16
            self.encode((value >> n) & 0xFFFF, 1, 1 << 16)
        if n:
            self.encode(value & ((1 << n) - 1), 1, 1 << n)

    def finish(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class RangeDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.range, self.code = data, 4, 0xFFFFFFFF, int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def value(self, total: int) -> int:
        self.step = self.range // total
        return min(self.code // self.step, total - 1)

    def take(self, cum: int, freq: int) -> None:
        self.code -= self.step * cum
        self.range = self.step * freq
        while self.range < 1 << 24:
            self.range <<= 8
            self.code = (self.code << 8) | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1

    def bits(self, n: int) -> int:
        out = 0
        while n > 16:
            v = self.value(1 << 16)
            self.take(v, 1)
            out, n = (out << 16) | v, n - 16
        if n:
            v = self.value(1 << n)
            self.take(v, 1)
            out = (out << n) | v
        return out


class _Counts:
    """Adaptive counts of some symbols in one context."""

    def __init__(self, n: int, grow: int, limit: int):
        self.f, self.total, self.grow, self.limit = [1] * n, n, grow, limit

    def saw(self, s: int) -> None:
        self.f[s] += self.grow
        self.total += self.grow
        if self.total >= self.limit:
            self.f = [(x + 1) >> 1 for x in self.f]
            self.total = sum(self.f)

    def put(self, coder: RangeEncoder, s: int) -> None:
        coder.encode(sum(self.f[:s]), self.f[s], self.total)
        self.saw(s)

    def get(self, coder: RangeDecoder) -> int:
        want, cum, s = coder.value(self.total), 0, 0
        while cum + self.f[s] <= want:
            cum += self.f[s]
            s += 1
        coder.take(cum, self.f[s])
        self.saw(s)
        return s


class _Residuals:
    """The model that residual encoder and decoder share: buckets by the two before, then the top bit below the highest."""

    def __init__(self):
        self.buckets: dict[int, _Counts] = {}
        self.tops: dict[tuple[int, int], _Counts] = {}
        self.a = self.b = 0

    def bucket(self) -> _Counts:
        c = self.context = min(self.a, CLAMP) * (CLAMP + 1) + min(self.b, CLAMP)
        if c not in self.buckets:
            self.buckets[c] = _Counts(BUCKETS, GROW, LIMIT)
        return self.buckets[c]

    def top(self, k: int) -> _Counts:
        key = (self.context, k)
        if key not in self.tops:
            self.tops[key] = _Counts(2, TOP_GROW, TOP_LIMIT)
        return self.tops[key]

    def saw(self, k: int) -> None:
        self.a, self.b = k, self.a


def zigzag(r: int) -> int:
    return 2 * r if r >= 0 else -2 * r - 1


def unzigzag(u: int) -> int:
    return u >> 1 if u & 1 == 0 else -(u + 1 >> 1)


def _halved(counts: list[int]) -> int:
    """Counts halved in place, none below 1; their sum."""
    counts[:] = [(x + 1) >> 1 for x in counts]
    return sum(counts)


def residuals_encode(values) -> bytes:
    """The buckets, top bits and rests of residuals, by the coder and the model above in one loop of plain numbers."""
    low, span, held, byte, first, out = 0, 0xFFFFFFFF, 0, 0, True, bytearray()
    buckets: dict[int, list] = {}
    tops: dict[int, list] = {}
    a = b = 0

    def shift() -> None:  # a byte of ``low`` out, or held back where a carry may still come
        nonlocal low, held, byte, first
        if low < 0xFF000000 or low > 0xFFFFFFFF:
            carry = low >> 32
            if not first:
                out.append((byte + carry) & 255)
            if held:
                out.extend(bytes([(255 + carry) & 255]) * held)
            held, first = 0, False
            byte = (low >> 24) & 255
        else:
            held += 1
        low = (low & 0x00FFFFFF) << 8

    values = values.tolist() if isinstance(values, np.ndarray) else values
    for r in values:
        r = int(r)
        u = 2 * r if r >= 0 else -2 * r - 1
        k = u.bit_length()
        c = (a if a < CLAMP else CLAMP) * (CLAMP + 1) + (b if b < CLAMP else CLAMP)
        held_counts = buckets.get(c)
        if held_counts is None:
            held_counts = buckets[c] = [[1] * BUCKETS, BUCKETS]
        f, total = held_counts
        step, n = span // total, f[k]
        low += step * sum(f[:k])
        span = step * n
        while span < 1 << 24:
            span <<= 8
            shift()
        f[k] = n + GROW
        total += GROW
        held_counts[1] = total if total < LIMIT else _halved(f)
        if k > 1:
            top = tops.get(c << 7 | k)
            if top is None:
                top = tops[c << 7 | k] = [1, 1]
            s, total = u >> (k - 2) & 1, top[0] + top[1]
            step = span // total
            if s:
                low += step * top[0]
            span = step * top[s]
            while span < 1 << 24:
                span <<= 8
                shift()
            top[s] += TOP_GROW
            if total + TOP_GROW >= TOP_LIMIT:
                _halved(top)
            n = k - 2
            while n > 0:
                many = n - 16 if n > 16 else 0
                size = n - many if not many else 16
                span //= 1 << size
                low += span * (u >> many & (1 << size) - 1)
                while span < 1 << 24:
                    span <<= 8
                    shift()
                n = many
        a, b = k, a
    for _ in range(5):
        shift()
    return bytes(out)


def residuals_decode(data: bytes, n: int) -> list[int]:
    span, code, at, size, out = 0xFFFFFFFF, int.from_bytes(data[:4].ljust(4, b"\0"), "big"), 4, len(data), []
    buckets: dict[int, list] = {}
    tops: dict[int, list] = {}
    a = b = 0
    for _ in range(n):
        c = (a if a < CLAMP else CLAMP) * (CLAMP + 1) + (b if b < CLAMP else CLAMP)
        held = buckets.get(c)
        if held is None:
            held = buckets[c] = [[1] * BUCKETS, BUCKETS]
        f, total = held
        step = span // total
        want = code // step
        if want >= total:
            want = total - 1
        cum = k = 0
        for x in f:
            if cum + x > want:
                break
            cum += x
            k += 1
        code -= step * cum
        span = step * x
        while span < 1 << 24:
            span <<= 8
            code = code << 8 | (data[at] if at < size else 0)
            at += 1
        f[k] = x + GROW
        total += GROW
        held[1] = total if total < LIMIT else _halved(f)
        u = 1 if k else 0
        if k > 1:
            top = tops.get(c << 7 | k)
            if top is None:
                top = tops[c << 7 | k] = [1, 1]
            total = top[0] + top[1]
            step = span // total
            s = 1 if code // step >= top[0] else 0
            if s:
                code -= step * top[0]
            span = step * top[s]
            while span < 1 << 24:
                span <<= 8
                code = code << 8 | (data[at] if at < size else 0)
                at += 1
            top[s] += TOP_GROW
            if total + TOP_GROW >= TOP_LIMIT:
                _halved(top)
            u, left = 2 | s, k - 2
            while left > 0:
                bits = left if left <= 16 else 16
                span //= 1 << bits
                v = code // span
                if v >> bits:
                    v = (1 << bits) - 1
                code -= span * v
                while span < 1 << 24:
                    span <<= 8
                    code = code << 8 | (data[at] if at < size else 0)
                    at += 1
                u, left = u << bits | v, left - bits
        a, b = k, a
        out.append(u >> 1 if u & 1 == 0 else -(u + 1 >> 1))
    return out


def residuals_bits(values) -> float:
    """What the model says that residuals take, without a coder."""
    from math import log2

    model, bits = _Residuals(), 0.0
    for r in values:
        u = zigzag(int(r))
        k = u.bit_length()
        c = model.bucket()
        bits -= log2(c.f[k] / c.total)
        c.saw(k)
        if k > 1:
            t = model.top(k)
            s = u >> (k - 2) & 1
            bits -= log2(t.f[s] / t.total)
            t.saw(s)
            bits += k - 2
        model.saw(k)
    return bits


def rice_encode(values) -> bytes:
    mean, acc, n, out = RICE_START, 0, 0, bytearray()
    for r in values:
        u = zigzag(int(r))
        k = max(0, int(mean).bit_length() - 1)
        q = u >> k
        acc = (acc << (q + 1)) | (((1 << q) - 1) << 1)
        acc = (acc << k) | (u & ((1 << k) - 1))
        n += q + 1 + k
        while n >= 8:
            n -= 8
            out.append(acc >> n & 255)
        acc &= (1 << n) - 1
        mean += (u - mean) * RICE_SHARE
    if n:
        out.append(acc << (8 - n) & 255)
    return bytes(out)


def rice_decode(data: bytes, n: int) -> list[int]:
    at, mean, out = 0, RICE_START, []
    bit = lambda i: data[i >> 3] >> (7 - (i & 7)) & 1
    for _ in range(n):
        k = max(0, int(mean).bit_length() - 1)
        q = 0
        while bit(at):
            q, at = q + 1, at + 1
        at += 1
        u = q
        for _ in range(k):
            u, at = u << 1 | bit(at), at + 1
        out.append(unzigzag(u))
        mean += (u - mean) * RICE_SHARE
    return out


def _context(x: np.ndarray, step: int, bits: int) -> np.ndarray:
    """The hash of what comes before each place: every older number ``step`` bits further up, exclusive-or, until none is left of ``bits``."""
    out = np.zeros(len(x), np.uint64)
    for k in range(1, min(len(x) - 1, -(-bits // step)) + 1):
        out[k:] ^= x[:-k] << np.uint64(step * (k - 1))
    return out & np.uint64((1 << bits) - 1)


def _last(context: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place the value where its context last came, else 0."""
    order = np.argsort(context.astype(np.uint16) if not len(context) or context.max() < 1 << 16 else context, kind="stable")
    line = context[order]
    again = np.flatnonzero(line[1:] == line[:-1])
    out = np.zeros_like(values)
    out[order[again + 1]] = values[order[again]]
    return out


def fcm(words, bits: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Context-hash predictions of 64-bit words: (selectors, exclusive ors) with the better of two tables.

    Contexts are made of the words alone, so all places are predicted at once.
    """
    w = np.asarray(words, np.uint64)
    last = np.concatenate([np.zeros(1, np.uint64), w])[: len(w)]
    d = w - last
    a = w ^ _last(_context(w >> np.uint64(48), 6, bits), w)
    b = w ^ (last + _last(_context(d >> np.uint64(40), 2, bits), d))
    return (a > b).astype(np.uint8), np.minimum(a, b)


def unfcm(chosen, left, bits: int = 12) -> list[int]:
    size = (1 << bits) - 1
    table, deltas, h, g, last, out = {}, {}, 0, 0, 0, []
    for c, x in zip(chosen, left, strict=True):
        a, b = table.get(h, 0), (last + deltas.get(g, 0)) & _MASK
        w = x ^ (b if c else a)
        d = (w - last) & _MASK
        table[h], deltas[g] = w, d
        h, g, last = (h << 6 ^ w >> 48) & size, (g << 2 ^ d >> 40) & size, w
        out.append(w)
    return out


def fcm_encode(words) -> bytes:
    chosen, left = fcm(words)
    planes = left.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zlib.compress(np.packbits(chosen).tobytes() + planes, 9)


def fcm_decode(data: bytes, n: int) -> list[int]:
    raw = zlib.decompress(data)
    size = -(-n // 8)
    chosen = np.unpackbits(np.frombuffer(raw[:size], np.uint8))[:n]
    left = np.frombuffer(raw[size:], np.uint8).reshape(8, n).T.copy().view("<u8").ravel()
    return unfcm(chosen.tolist(), left.tolist())


def lms(values, order: int = 16, shift: int = 10, back: bool = False) -> list[int]:
    """Residuals of a sign-sign adaptive filter, or with ``back`` the values from residuals."""
    weights, past, out = [0] * order, [0] * order, []
    for x in values:
        guess = sum(w * p for w, p in zip(weights, past, strict=True)) >> shift
        e, v = (x, x + guess) if back else (x - guess, x)
        out.append(v if back else e)
        if e:
            s = 1 if e > 0 else -1
            weights = [w + (s if p > 0 else -s if p < 0 else 0) for w, p in zip(weights, past, strict=True)]
        past = [v, *past[:-1]]
    return out


#: Taps and shift of each filter of a cascade, fixed values.
STAGES = ((16, 10), (256, 13), (512, 14))


def cascade(values: np.ndarray, back: bool = False) -> np.ndarray:
    """Linear extrapolation, then sign-sign adaptive filters one after another, each over what the one before leaves; or back."""
    x = np.asarray(values, np.int64)
    if not back:
        x = np.concatenate([x[:2], x[2:] - 2 * x[1:-1] + x[:-2]]) if len(x) > 2 else x.copy()
    for taps, shift in reversed(STAGES) if back else STAGES:
        x = _filtered(x, taps, shift, back)
    if back and len(x) > 2:
        out = x.tolist()
        for i in range(2, len(out)):
            out[i] += 2 * out[i - 1] - out[i - 2]
        x = np.array(out, np.int64)
    return x


def _filtered(x: np.ndarray, taps: int, shift: int, back: bool) -> np.ndarray:
    """What the weighted sum of the ``taps`` values before misses; weights move by the signs of value and miss."""
    out = np.empty_like(x)
    known = np.concatenate([np.zeros(taps, np.int64), np.zeros_like(x) if back else x])  # oldest first
    signs = np.sign(known)
    weights = np.zeros(taps, np.int64)
    for i, v in enumerate(x.tolist()):
        guess = int(weights @ known[i : i + taps]) >> shift
        miss = v if back else v - guess
        out[i] = v + guess if back else miss
        if back:
            known[taps + i] = v + guess
            signs[taps + i] = np.sign(v + guess)
        if miss:
            weights += signs[i : i + taps] if miss > 0 else -signs[i : i + taps]
    return out


#: What a symbol's count grows by, the total at which counts are halved, and the places that are told apart; fixed values.
GROW, HALVE, PLACES = 32, 1 << 16, 64


class _Placed:
    """Counts of symbols after a symbol at a place in its line."""

    def __init__(self, symbols: int):
        self.symbols, self.held = symbols, {}

    def counts(self, before: int, place: int) -> list[int]:
        return self.held.setdefault((before, min(place, PLACES - 1)), [1] * self.symbols)

    def saw(self, counts: list[int], s: int) -> None:
        counts[s] += GROW
        if sum(counts) >= HALVE:
            counts[:] = [(c + 1) >> 1 for c in counts]


def placed_encode(lines: list[list[int]], symbols: int) -> bytes:
    """Lines of symbols, each coded given the one before it and its place in the line."""
    coder, model = RangeEncoder(), _Placed(symbols)
    for line in lines:
        before = symbols
        for place, s in enumerate(line):
            counts = model.counts(before, place)
            coder.encode(sum(counts[:s]), counts[s], sum(counts))
            model.saw(counts, s)
            before = s
    return coder.finish()


def placed_decode(data: bytes, lengths: list[int], symbols: int) -> list[list[int]]:
    coder, model, out = RangeDecoder(data), _Placed(symbols), []
    for n in lengths:
        line, before = [], symbols
        for place in range(n):
            counts = model.counts(before, place)
            target, s, low = coder.value(sum(counts)), 0, 0
            while low + counts[s] <= target:
                low += counts[s]
                s += 1
            coder.take(low, counts[s])
            model.saw(counts, s)
            line.append(s)
            before = s
        out.append(line)
    return out


def calic(plane: np.ndarray, back: bool = False) -> np.ndarray:
    """Residuals of gradient-adjusted predictions with the mean error of each texture context taken off, or back."""
    h, w = plane.shape
    src, out = plane.tolist(), [[0] * w for _ in range(h)]
    img = out if back else src
    sums, counts = {}, {}
    for y in range(h):
        for x in range(w):
            at = lambda j, i: img[j][i] if 0 <= j and 0 <= i < w else 0
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            d, ww, nn = at(y - 1, x + 1), at(y, x - 2), at(y - 2, x)
            if x and y:
                grad = (abs(a - c) + abs(b - nn) + abs(d - nn)) - (abs(a - ww) + abs(b - c) + abs(b - d))
                base = (a + b >> 1) + (d - c >> 2)
                guess = a if grad > 80 else b if grad < -80 else base + a >> 1 if grad > 32 else base + b >> 1 if grad < -32 else 3 * base + a >> 2 if grad > 8 else 3 * base + b >> 2 if grad < -8 else base
            else:
                guess = a if x else b if y else 128
                grad = 0
            texture = sum(1 << i for i, v in enumerate((a, b, c, d, ww, nn)) if v < guess)
            key = (texture, min(3, abs(grad).bit_length() // 2))
            n = counts.get(key, 0)
            guess += int(sums.get(key, 0) / n) if n else 0
            r = src[y][x]
            e = r if back else r - guess
            out[y][x] = e + guess if back else e
            sums[key], counts[key] = sums.get(key, 0) + e, n + 1
            if n + 1 >= 256:
                sums[key], counts[key] = int(sums[key] / 2), (n + 1) // 2
    return np.array(out, np.int64).reshape(h, w)


def huffman_lengths(freqs: list[int], limit: int = 15) -> list[int]:
    """Code lengths of least cost, none over ``limit``, by package-merge; a symbol alone takes 1 bit."""
    used = [(f, (s,)) for s, f in enumerate(freqs) if f > 0]
    out = [0] * len(freqs)
    if len(used) < 2:
        for _, (s,) in used:
            out[s] = 1
        return out
    leaves, row = sorted(used), []
    for _ in range(limit):
        row = list(heapq.merge(leaves, [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]))
    for _, group in row[: 2 * len(used) - 2]:
        for s in group:
            out[s] += 1
    return out
