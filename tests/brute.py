"""Brute-force statements of the semantics, for small fixtures only."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter

import numpy as np

def windows(text, size, overlap):
    starts = itertools.count(0, max(size - overlap, 1))
    out = []
    for s in itertools.takewhile(lambda s: s < len(text), starts):
        out.append(text[s : s + size])
        if s + size >= len(text):
            break
    return [w for w in map(str.strip, out) if w]


def hash_vector(tokens, dim=384, name="blake2b"):
    v = np.zeros(dim)
    for w in tokens:
        raw = w.encode()
        d = hashlib.blake2b(raw, digest_size=8).digest() if name == "blake2b" else hashlib.md5(raw).digest()
        v[int.from_bytes(d[:4], "big") % dim] += -1.0 if d[4] & 1 else 1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def cosine(a, b):
    n = min(len(a), len(b))
    scale = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a[:n], b[:n])) / scale if scale else 0.0


def top(scores, k):
    """Positions of the k largest, first come first on ties."""
    order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 10), i))
    return order[:k]


def bm25(texts, query, k1=1.5, b=0.75):
    """Scores of token lists for a list of query tokens."""
    docs = [Counter(t) for t in texts]
    sizes = [sum(d.values()) for d in docs]
    mean = max(sum(sizes) / max(len(sizes), 1), 1)
    df = Counter(w for d in docs for w in d)
    out = []
    for d, size in zip(docs, sizes):
        norm = k1 * (1 - b + b * max(size, 1) / mean)
        terms = (w for w in query if d[w])
        out.append(
            sum(
                math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (k1 + 1) / (d[w] + norm)
                for w in terms
            )
        )
    return out
