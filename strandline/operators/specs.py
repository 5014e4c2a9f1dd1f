"""Reversible byte steps, chains of them as specifications, and the choice of the chain under which data packs best.

A specification is a tuple of (step, argument). Its bytes: the number of steps,
then a code and an argument for each.
"""

from __future__ import annotations

import zlib

import numpy as np

from . import coders as K

Spec = tuple[tuple[str, int], ...]
#: Codes of steps, fixed values.
CODES = {"delta": 0, "split": 1, "xor": 2, "fcm": 3}
#: The specifications that are tried, fixed values, in the order in which ties are broken.
SPECS: tuple[Spec, ...] = (
    (),
    (("delta", 1),),
    (("delta", 2),),
    (("delta", 4),),
    (("split", 2),),
    (("split", 2), ("delta", 1)),
    (("split", 2), ("delta", 2)),
    (("delta", 4), ("split", 2)),
    (("xor", 8),),
    (("xor", 8), ("split", 8)),
    (("split", 8),),
    (("xor", 4), ("split", 4)),
    (("fcm", 16),),
)


def _lanes(data: bytes, stride: int) -> tuple[np.ndarray, int]:
    """Bytes as rows of ``stride``, filled up with zeros."""
    n = len(data)
    rows = np.zeros(-(-n // stride) * stride, np.uint8)
    rows[:n] = np.frombuffer(data, np.uint8)
    return rows.reshape(-1, stride), n


def delta(data: bytes, stride: int, back: bool = False) -> bytes:
    """Each byte less the one ``stride`` before it, modulo 256."""
    rows, n = _lanes(data, stride)
    if back:
        return np.cumsum(rows, axis=0, dtype=np.uint8).tobytes()[:n]
    return np.diff(rows, axis=0, prepend=np.zeros((1, stride), np.uint8)).tobytes()[:n]


def xor(data: bytes, stride: int, back: bool = False) -> bytes:
    """Each byte exclusive-or the one ``stride`` before it."""
    rows, n = _lanes(data, stride)
    if back:
        return np.bitwise_xor.accumulate(rows, axis=0).tobytes()[:n]
    out = rows.copy()
    out[1:] ^= rows[:-1]
    return out.tobytes()[:n]


def split(data: bytes, n: int, back: bool = False) -> bytes:
    """The bytes at places 0, n, 2n ..., then those at 1, n + 1 ..., and so on."""
    if not back:
        return b"".join(data[k::n] for k in range(n))
    out, at = np.empty(len(data), np.uint8), 0
    for k in range(n):
        size = len(range(k, len(data), n))
        out[k::n] = np.frombuffer(data, np.uint8, size, at)
        at += size
    return out.tobytes()


def fcm(data: bytes, bits: int, back: bool = False) -> bytes:
    """64-bit words by context-hash prediction: a length, the coded words, and the bytes that fill no word."""
    if back:
        n = int.from_bytes(data[:4], "little")
        size = int.from_bytes(data[4:8], "little")
        words = np.array(K.fcm_decode(data[8 : 8 + size], n), np.uint64)
        return words.astype("<u8").tobytes() + data[8 + size :]
    n = len(data) // 8
    coded = K.fcm_encode(np.frombuffer(data[: 8 * n], "<u8"))
    return n.to_bytes(4, "little") + len(coded).to_bytes(4, "little") + coded + data[8 * n :]


STEPS = {"delta": delta, "split": split, "xor": xor, "fcm": fcm}


def apply(data: bytes, spec: Spec) -> bytes:
    for name, argument in spec:
        data = STEPS[name](data, argument)
    return data


def invert(data: bytes, spec: Spec) -> bytes:
    for name, argument in reversed(spec):
        data = STEPS[name](data, argument, back=True)
    return data


def to_bytes(spec: Spec) -> bytes:
    return bytes([len(spec), *(x for name, argument in spec for x in (CODES[name], argument))])


def from_bytes(said: bytes) -> Spec:
    names = {v: k for k, v in CODES.items()}
    if not said or len(said) != 1 + 2 * said[0] or any(c not in names for c in said[1::2]):
        raise ValueError("not a specification")
    return tuple((names[said[1 + 2 * k]], said[2 + 2 * k]) for k in range(said[0]))


def packed_size(data: bytes, spec: Spec) -> int:
    """Bytes of ``data`` under a specification and a fast deflate."""
    return len(zlib.compress(apply(data, spec), 6))


def packed_sizes(data: bytes, specs: tuple[Spec, ...] = SPECS) -> list[int]:
    """``packed_size`` under each of several specifications; steps that they begin with alike are taken once."""
    done: dict[Spec, bytes] = {(): data}
    for spec in specs:
        for k in range(1, len(spec) + 1):
            if spec[:k] not in done:
                done[spec[:k]] = apply(done[spec[: k - 1]], spec[k - 1 : k])
    return [len(zlib.compress(done[spec], 6)) for spec in specs]


def text(spec: Spec) -> str:
    return "+".join(f"{name}{argument}" for name, argument in spec) or "none"
