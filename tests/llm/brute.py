"""Brute-force versions to hold the operators against."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = WORDS.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_duplicates(docs, size, percent):
    """docs: (doc_id, text) with distinct ids. doc_id: (n_shingles, component_id)."""
    sets = {d: frozenset(shingle_set(t, size)) for d, t in docs}
    by: dict = {}
    for d, s in sets.items():
        by.setdefault(s, []).append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for s, ids in by.items():
        for d in ids[1:] if s else ():
            join(ids[0], d)
    inverted: dict = {}
    for s, ids in by.items():
        for x in s:
            inverted.setdefault(x, []).append(ids[0])
    for s, ids in by.items():
        counts: dict = {}
        rare = sorted(s, key=lambda x: len(inverted[x]))[: len(s) - -(-len(s) * percent // 100) + 1]
        for x in rare:
            for d in inverted[x]:
                counts[d] = 1
        for d in counts:
            if d > ids[0]:
                both = len(s & sets[d])
                if 100 * both >= percent * (len(s) + len(sets[d]) - both):
                    join(ids[0], d)
    return {d: (len(sets[d]), find(d)) for d in sets}
