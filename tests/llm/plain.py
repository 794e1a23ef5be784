"""Plain, slow versions of what the operators compute."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(ids, links):
    """The smallest id that each id reaches."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_pairs(texts):
    """Pairs of ids with Jaccard likeness of 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    return [
        (a, b)
        for a, b in combinations([i for i, s in sets.items() if s], 2)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]


def line_key(line):
    key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    return key if len(key) >= 10 else None


def kept_lines(texts):
    """id -> (lines, dropped, kept text)."""
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    holders = {}
    for i, ls in lines.items():
        for key in {line_key(x) for x in ls} - {None}:
            holders.setdefault(key, set()).add(i)
    out = {}
    for i, ls in lines.items():
        stay = [x for x in ls if line_key(x) is None or min(holders[line_key(x)]) == i]
        out[i] = (len(ls), len(ls) - len(stay), "\n".join(stay))
    return out
