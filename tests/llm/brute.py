"""Plain versions of the operators, one text at a time."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substring(docs, window=13):
    """doc_id -> (n_words, n_removed, kept_sha256) for unique ids"""
    low = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            low[k] = min(low.get(k, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs, k=4, percent=80):
    """doc_id -> (n_shingles, component_id, kept)"""
    sets = {d: shingles(t, k) for d, t in docs}
    index, up = {}, {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sorted(sets.items()):
        seen = {}
        for x in s:
            for e in index.setdefault(x, []):
                seen[e] = seen.get(e, 0) + 1
            index[x].append(d)
        for e, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}
