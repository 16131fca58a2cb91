"""Plain versions of the operators, for small tables."""

import re

import numpy as np
import xxhash


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def similar(a, b, k=5):
    """Whether the sets of k-word shingles have a Jaccard similarity of 0.8 or more."""
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return 10 * len(x & y) >= 8 * len(x | y)


def classes(items, linked):
    """The least item that each one reaches."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def words(text):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(docs, items, window=10):
    out = {}
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(window, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[s : s + n]:
                        hit.update(range(p, p + n))
                        names.add("null" if item_id is None else str(item_id))
        out[doc_id] = (len(own), len(hit), sorted(names))
    return out


def cosine(a, b):
    x, y = np.asarray(a, "f8"), np.asarray(b, "f8")
    return float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y))
