"""Plain versions of the operators, for tests on small tables, and the awkward rows they are tested on."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, score string, block string, n long, key string"


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def awkward_docs(spark, seed=1):
    """Nulls everywhere, empty and long texts, copies, near copies, repeated rows, shared passages, clashing column names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, base = text(60), text(200)
    rows = [(0, base), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One  two"), (6, base), (6, base), (7, base.upper()),
            (None, base), (None, None), (8, text(3000) + "\n\n" + passage), (9, passage + "\n" + text(80)), (10, text(30) + " " + passage)]
    for i in range(11, 40):
        w = base.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(i, text(rng.randint(1, 40)) + rng.choice([".", "!\n", "\n\n", ""]) + text(rng.randint(0, 40))) for i in range(40, 90)]
    return spark.createDataFrame([(i, t, "x", "y", 1, None) for i, t in rows], DOCS).repartition(3)


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def similar(rows, k, share):
    """Component per doc_id of (doc_id, text) rows by comparing all pairs of sets."""
    rows = [(i, shingles(t, k)) for i, t in rows if i is not None]
    distinct = {}
    for i, s in rows:
        distinct.setdefault(s, []).append(i)
    sets = [s for s in distinct if s]
    links = [(m[0], x) for s, m in distinct.items() if s for x in m[1:]]
    for x, s in enumerate(sets):
        links += [(distinct[s][0], distinct[t][0]) for t in sets[:x]
                  if 100 * len(s & t) >= share * len(s | t)]
    return components({i for i, _ in rows}, links)


def cut_repeats(rows, k):
    """(words, removed flags) per row: words under windows of k that start in a document with a smaller id."""
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for a in range(len(w) - k + 1):
                key = tuple(w[a: a + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for a in range(len(w) - k + 1):
                if first[tuple(w[a: a + k])] < i:
                    gone[a: a + k] = [True] * k
        out.append((i, w, gone))
    return out
