"""Plain versions of the operators, in straight Python, to hold results against."""

import hashlib
import re

import xxhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def simhash(text):
    words = SPACE.findall((text or "").encode().lower())
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, threshold=4):
    """doc_id -> smallest doc_id reachable."""
    items = list(fps.items())
    root = {d: d for d, _ in items}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if (x ^ y).bit_count() <= threshold:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in items}


def dedup(texts, window=50):
    """doc_id -> (words, kept); texts in order of doc_id."""
    first, out = {}, {}
    for d, t in sorted(texts.items()):
        words = SPACE.findall((t or "").encode())
        gone = set()
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), d) < d:
                gone.update(range(i, i + window))
        out[d] = (words, [w for i, w in enumerate(words) if i not in gone])
    return out


def secrets(text):
    """Base spans (start, order, stop, kind) sorted."""
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def copies(texts, shingle=5, least=0.8):
    """doc_id -> smallest doc_id reachable over pairs of similar texts that have a word."""
    sets = {}
    for d, t in texts.items():
        w = SPACE.findall((t or "").encode().lower())
        if w:
            sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}
