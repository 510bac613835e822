"""Plain reference versions of the corpus operators."""

import collections
import hashlib
import re

LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text, lower=False):
    return SPACED.findall((text or "").translate(LOW) if lower else text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=50):
    """rows: (id, text) -> sorted (id, n_words, n_removed, sha256 of what is kept)."""
    big = 1 << 63
    first = {}
    words = [(big if i is None else i, spaced(t)) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), i)
    out = []
    for (i, _), (n, w) in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < n:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def overlap(rows, items, window=10):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(len(w), window)
        for s in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[s : s + k])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (g := tuple(w[s : s + k])) in grams:
                    hit.update(range(s, s + k))
                    found |= grams[g]
        listed = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return out


def shingle_counts(text, k=5):
    w = spaced(text, True)
    k = min(k, len(w))
    return collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if k else collections.Counter()


def prob_jaccard(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a.keys() & b.keys())


def near_groups(texts, threshold=0.8):
    """Group number (least index) of each text, by all pairs."""
    sets = [shingle_counts(t) for t in texts]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if find(i) != find(j) and (a == b or (a.keys() & b.keys() and prob_jaccard(a, b) >= threshold)):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    return [find(i) for i in range(len(texts))]
