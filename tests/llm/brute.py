"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def shingle_set(text, k=5):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard(rows):
    """rows: (doc_id, text) with distinct ids in ascending order."""
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    return sorted((rows[i][0], len(sets[i]), rows[root[i]][0]) for i in range(len(rows)))


def repeats(rows, length=100):
    seen, out = set(), []
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, k in zip(b, gone) if not k)
        spans = sum(1 for x in range(len(gone)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_scores(rows, test_fold=1):
    counts = collections.Counter()
    for i, t in rows:
        if fold(i) != test_fold:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        tokens = [*words(t), None]
        out[i] = (fold(i) == test_fold, len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens))
    return out
