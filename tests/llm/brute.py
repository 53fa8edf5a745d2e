"""Brute-force versions of the training-data operators, in plain Python."""

from __future__ import annotations

import collections
import hashlib
import re


def near(rows):
    """rows: (doc_id, text) -> [(doc_id, set size, component)]."""
    def of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w] if w else []))

    sets = [of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def repeats(rows, window):
    """rows: (doc_id, text) -> [(doc_id, words, removed, digest)]."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def exact(rows):
    """rows: (doc_id, text) -> [(doc_id, keep_id, group size, digest)], and how many rows of each digest are kept: one."""
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d if d is not None else float("inf"), d))
    return [(d, min(groups[n := re.sub(r"[\x20\x09-\x0D]", "", t or "")])[2], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for d, t in rows]
