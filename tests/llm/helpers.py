"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import collections
import itertools
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str) -> list[str]:
    return WORD.findall(lower(text))


def shingles(text: str, size: int = 5) -> frozenset:
    w = words(text)
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def classes(items: dict, alike) -> tuple[dict, dict]:
    """Smallest reachable id and number of links of each item."""
    parent, links = {i: i for i in items}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(items), 2):
        if alike(items[i], items[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in items}, links


def jaccard(a, b) -> bool:
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8
