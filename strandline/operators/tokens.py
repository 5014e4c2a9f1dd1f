"""Token parses of byte strings: literals, dictionary entries and matches, by least cost; and their coding.

A trained model is a dictionary of patterns, a text to match into, and
frequencies of symbols. It is small by construction and goes to executors as a
broadcast value.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import chain

from .coders import RangeDecoder, RangeEncoder
from .mining import SHORT_CAPS

#: Greatest distance, least match, bits of a total of frequencies.
WINDOW, LEAST, TOTAL = 1 << 19, 3, 1 << 16
_SLOTS = 24
#: Recent distances that a match may name by their place instead.
REPEATS = 4


def value_slot(v: int) -> tuple[int, int]:
    """For v of 1 or more: floor of log2, and the rest."""
    k = v.bit_length() - 1
    return k, v - (1 << k)


class Frequencies:
    """Static frequencies over symbols 0..n-1, none below 1, of about TOTAL in all."""

    def __init__(self, counts: list[int]):
        whole = sum(counts)
        self.freq = [max(1, c * TOTAL // whole) for c in counts]
        self.cum = [0]
        for f in self.freq:
            self.cum.append(self.cum[-1] + f)
        self.total = self.cum[-1]
        self.costs = [math.log2(self.total / f) for f in self.freq]

    def cost(self, s: int) -> float:
        return self.costs[s]

    def put(self, coder: RangeEncoder, s: int) -> None:
        coder.encode(self.cum[s], self.freq[s], self.total)

    def get(self, coder: RangeDecoder) -> int:
        s = bisect_right(self.cum, coder.value(self.total)) - 1
        coder.take(self.cum[s], self.freq[s])
        return s


@dataclass
class Model:
    """``main``: bytes, then patterns, then length slots of matches; ``dist``: distance slots, then recent distances."""

    patterns: list[bytes] = field(default_factory=list)
    blob: bytes = b""
    counts: list[int] | None = None
    dist_counts: list[int] | None = None

    def __post_init__(self):
        n = 256 + len(self.patterns) + _SLOTS
        self.main = Frequencies([c + 1 for c in self.counts] if self.counts else [1] * n)
        self.dist = Frequencies([c + 1 for c in self.dist_counts] if self.dist_counts else [1] * (_SLOTS + REPEATS))
        self.heads: dict[bytes, list[int]] = {}
        for k, p in enumerate(self.patterns):
            self.heads.setdefault(p[:2], []).append(k)
        for v in self.heads.values():
            v.sort(key=lambda k: (-len(self.patterns[k]), k))
        self.places = places(self.blob)
        self.id = zlib.crc32(b"\0".join(self.patterns) + self.blob + repr((self.counts, self.dist_counts)).encode())

    def match_cost(self, length: int, distance: int) -> float:
        a, b = value_slot(length), value_slot(distance)
        return self.main.cost(256 + len(self.patterns) + a[0]) + a[0] + self.dist.cost(b[0]) + b[0]


def depth_for(n: int) -> int:
    """Earlier places that are tried: more for small inputs. Fixed values 128, 2048 and 2^22."""
    return max(128, min(2048, (1 << 22) // max(n, 1)))


def _common(data: bytes, a: int, b: int) -> int:
    n, step = len(data), 32
    k = 0
    while b + k + step <= n and data[a + k : a + k + step] == data[b + k : b + k + step]:
        k += step
    while b + k < n and data[a + k] == data[b + k]:
        k += 1
    return k


def worth(length: int, distance: int) -> bool:
    return length >= LEAST and distance <= SHORT_CAPS.get(length, WINDOW)


def places(blob: bytes) -> dict[bytes, list[int]]:
    """Where each three bytes begin."""
    out: dict[bytes, list[int]] = {}
    for i in range(len(blob) - 2):
        out.setdefault(blob[i : i + 3], []).append(i)
    return out


def matches(data: bytes, start: int, depth: int, known: dict[bytes, list[int]] | None = None):
    """For each place from ``start`` the least distance of each match length, longest first.

    ``known``: the places of what comes before ``start``, which many inputs may share.
    """
    known = places(data[:start]) if known is None else known
    own: dict[bytes, list[int]] = {}
    out = []
    for i in range(max(0, start - 2), len(data)):
        key = data[i : i + 3]
        if i >= start:
            found: list[tuple[int, int]] = []
            if len(key) == 3:
                best = 2
                near = own.get(key, ())
                for j in chain(reversed(near[-depth:]), reversed(known.get(key, ())[-(depth - len(near)) :]) if len(near) < depth else ()):
                    if i - j > WINDOW:
                        break
                    k = _common(data, j, i)
                    if k > best:
                        found.append((k, i - j))
                        best = k
            out.append(found[::-1])
        own.setdefault(key, []).append(i)
    return out


def parse(data: bytes, model: Model, depth: int | None = None, greedy: bool = False, lazy: bool = False) -> list[tuple]:
    """Tokens ('b', byte), ('d', pattern) and ('m', length, distance) of least cost; ``greedy``: longest first; ``lazy``:
    what saves most over bytes one by one, but a byte where the next place saves still more."""
    start = len(model.blob)
    whole = model.blob + data
    found = matches(whole, start, depth or depth_for(len(data)), model.places)
    n = len(data)
    options: list[list[tuple[float, int, tuple]]] = []
    for i in range(n):
        here = [(model.main.cost(data[i]), 1, ("b", data[i]))]
        for p in model.heads.get(data[i : i + 2], ()):
            if data.startswith(model.patterns[p], i):
                here.append((model.main.cost(256 + p), len(model.patterns[p]), ("d", p)))
        for length, distance in found[i]:
            if worth(length, distance):
                here.append((model.match_cost(length, distance), length, ("m", length, distance)))
        options.append(here)
    if lazy:
        plain = [0.0]
        for b in data:
            plain.append(plain[-1] + model.main.cost(b))
        top = [max((plain[i + o[1]] - plain[i] - o[0], k) for k, o in enumerate(here)) for i, here in enumerate(options)]
        out, i = [], 0
        while i < n:
            _, size, token = options[i][0] if i + 1 < n and top[i + 1][0] > top[i][0] else options[i][top[i][1]]
            out.append(token)
            i += size
        return out
    if greedy:
        out, i = [], 0
        while i < n:
            _, size, token = max(options[i], key=lambda o: (o[1], -o[0]))
            out.append(token)
            i += size
        return out
    best = [0.0] * (n + 1)
    take: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        best[i], size, token = min(((c + best[i + s], s, t) for c, s, t in options[i]), key=lambda o: o[0])
        take[i] = (size, token)
    out, i = [], 0
    while i < n:
        out.append(take[i][1])
        i += take[i][0]
    return out


def cost(tokens: list[tuple], model: Model) -> float:
    return sum(model.main.cost(t[1]) if t[0] == "b" else model.main.cost(256 + t[1]) if t[0] == "d" else model.match_cost(t[1], t[2]) for t in tokens)


def expand(tokens: list[tuple], model: Model) -> bytes:
    out = bytearray(model.blob)
    for t in tokens:
        if t[0] == "b":
            out.append(t[1])
        elif t[0] == "d":
            out += model.patterns[t[1]]
        else:
            at = len(out) - t[2]
            if at < 0:
                raise ValueError("a match reaches before the begin")
            for k in range(t[1]):  # a match may overlap itself
                out.append(out[at + k])
    return bytes(out[len(model.blob) :])


def _distances(tokens: list[tuple]) -> list[int]:
    """The distances of matches as the coder tells them: places among recent ones, or negative."""
    return repeated_offsets([t[2] for t in tokens if t[0] == "m"], REPEATS)


def compress(data: bytes, model: Model, depth: int | None = None) -> bytes:
    tokens = parse(data, model, depth)
    coder, distances = RangeEncoder(), iter(_distances(tokens))
    for t in tokens:
        if t[0] == "b":
            model.main.put(coder, t[1])
        elif t[0] == "d":
            model.main.put(coder, 256 + t[1])
        else:
            a, rest = value_slot(t[1])
            model.main.put(coder, 256 + len(model.patterns) + a)
            coder.bits(rest, a)
            if (d := next(distances)) >= 0:
                model.dist.put(coder, _SLOTS + d)
            else:
                b, more = value_slot(-d)
                model.dist.put(coder, b)
                coder.bits(more, b)
    head = model.id.to_bytes(4, "big") + zlib.crc32(data).to_bytes(4, "big") + len(data).to_bytes(4, "big") + len(tokens).to_bytes(4, "big")
    return head + coder.finish()


def decompress(blob: bytes, model: Model) -> bytes:
    """The text back; ValueError for another model's blob or a damaged one."""
    if len(blob) < 16 or int.from_bytes(blob[:4], "big") != model.id:
        raise ValueError("another model")
    crc, size, n = (int.from_bytes(blob[k : k + 4], "big") for k in (4, 8, 12))
    coder, tokens, done, recent = RangeDecoder(blob[16:]), [], 0, []
    for _ in range(n):
        s = model.main.get(coder)
        if s < 256:
            tokens.append(("b", s))
            done += 1
        elif s < 256 + len(model.patterns):
            tokens.append(("d", s - 256))
            done += len(model.patterns[s - 256])
        else:
            a = s - 256 - len(model.patterns)
            length = (1 << a) + coder.bits(a)
            b = model.dist.get(coder)
            if b >= _SLOTS and b - _SLOTS >= len(recent):
                raise ValueError("damaged")
            distance = recent.pop(b - _SLOTS) if b >= _SLOTS else (1 << b) + coder.bits(b)
            if distance in recent:
                raise ValueError("damaged")
            recent = [distance, *recent][:REPEATS]
            tokens.append(("m", length, distance))
            done += length
        if done > size:
            raise ValueError("damaged")
    out = expand(tokens, model)
    if len(out) != size or zlib.crc32(out) != crc:
        raise ValueError("damaged")
    return out


def repeated_offsets(distances: list[int], size: int = 16) -> list[int]:
    """Distances as places in a cache of recent ones (moved to its front), or -distance."""
    cache: list[int] = []
    out = []
    for d in distances:
        if d in cache:
            out.append(cache.index(d))
            cache.remove(d)
        else:
            out.append(-d)
        cache = [d, *cache][:size]
    return out


def distances_back(coded: list[int], size: int = 16) -> list[int]:
    cache: list[int] = []
    out = []
    for c in coded:
        d = -c if c < 0 else cache.pop(c)
        out.append(d)
        cache = [d, *cache][:size]
    return out


#: Greatest sizes of a text to match into, and lengths of the segments that it is made of: each pair is tried.
BLOBS = tuple((most, size) for most in (512, 2048, 8192) for size in (32, 128, 512))
_UNIT = 8


def select_blob(samples: list[bytes], most: int, size: int) -> bytes:
    """Segments of the samples that cover what comes often, ``most`` bytes of them, the best last, nearest to the data.

    A segment's score is how often its runs of ``_UNIT`` bytes come in all; runs of a segment that is taken count no
    more. The best is looked for again and again among scores that only fall, so a heap of old scores will do.
    """
    whole = b"".join(samples)
    if len(whole) <= most:
        return whole
    often: dict[bytes, int] = {}
    for i in range(len(whole) - _UNIT + 1):
        often[whole[i : i + _UNIT]] = often.get(whole[i : i + _UNIT], 0) + 1
    score = lambda i: sum(often[whole[j : j + _UNIT]] for j in range(i, min(i + size, len(whole)) - _UNIT + 1))
    line = [(-score(i), i) for i in range(0, len(whole) - _UNIT + 1, max(1, size // 4))]
    heapq.heapify(line)
    taken, total = [], 0
    while line and total < most:
        old, i = heapq.heappop(line)
        if (now := -score(i)) != old:
            if now < 0:
                heapq.heappush(line, (now, i))
            continue
        if now == 0:
            break
        part = whole[i : i + min(size, most - total)]
        taken.append(part)
        total += len(part)
        for j in range(i, min(i + size, len(whole)) - _UNIT + 1):
            often[whole[j : j + _UNIT]] = 0
    return b"".join(reversed(taken))


def train(samples: list[bytes], patterns: list[bytes], blobs: list[bytes]) -> Model:
    """The model with the text, of some, under which held-out samples cost least: the last fifth (all of under five)."""
    cut = len(samples) * 4 // 5 if len(samples) >= 5 else len(samples)
    seen, held = samples[:cut], samples[cut:] or samples
    best = None
    for blob in blobs or [b""]:
        first = Model(patterns, blob)
        main, dist = [0] * (256 + len(patterns) + _SLOTS), [0] * (_SLOTS + REPEATS)
        for s in seen:
            tokens = parse(s, first, 32)
            for d in _distances(tokens):
                dist[_SLOTS + d if d >= 0 else value_slot(-d)[0]] += 1
            for t in tokens:
                if t[0] == "b":
                    main[t[1]] += 1
                elif t[0] == "d":
                    main[256 + t[1]] += 1
                else:
                    main[256 + len(patterns) + value_slot(t[1])[0]] += 1
        model = Model(patterns, blob, main, dist)
        bits = sum(cost(parse(s, model, 32), model) for s in held)
        if best is None or bits < best[0]:
            best = (bits, model)
    return best[1]
