"""Plain versions of the operators, for small tables."""

import hashlib
import itertools

import xxhash


def substrings(rows, window=13):
    """rows: (doc_id, text) -> {index: (n_words, n_removed, sha)}"""
    least = {}
    words = [(t or "").encode().split() for _, t in rows]
    big = float("inf")
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, big), big if d is None else d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (big if d is None else d):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def simhash(rows, width=3, radius=3):
    fps = [(d, fingerprint(t, width)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    low = {}
    for d, f in fps:
        if d is not None:
            low[find(f)] = min(low.get(find(f), d), d)
    return [(d, f"{f:016x}", low.get(find(f))) for d, f in fps]


def jaccard_groups(texts, width=5, least=0.8):
    """For each text the smallest index reachable over pairs of that similarity of shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def one_edit(a, b):
    """Whether the strings differ by exactly one inserted, deleted or replaced character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(counts, ratio=10):
    """{word: (n, n_near, form, form_n, root)} by comparing all pairs."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def merkle(digests, fan=8):
    """All levels of a tree, leaves first."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + fan]).encode()).hexdigest() for i in range(0, len(last), fan)])
    return levels


def climb(levels, i, own, fan=8):
    """Siblings on the path of leaf i, and the root when its digest is ``own``."""
    beside = []
    for level in levels[:-1]:
        run = level[i // fan * fan : i // fan * fan + fan]
        run[i % fan] = own
        beside += run[: i % fan] + run[i % fan + 1 :]
        own, i = hashlib.sha256("".join(run).encode()).hexdigest(), i // fan
    return beside, own
