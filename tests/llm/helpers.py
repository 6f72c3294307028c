"""Tables with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALLER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977} token{i % 1009}" for i in range(60_000))
BASE = " ".join(f"plain{i}" for i in range(120))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, node long, kept boolean, _text string, n long, copies long"


def odd_documents(spark):
    texts = [
        (1, None, "s1"), (2, "", "s1"), (3, " \t\n", "s2"), (4, "one two", None), (5, "One  TWO", "s2"), (6, "é É one", "s3"), (7, LONG, "s1"), (8, LONG, "s1"),
        (9, BASE, "s2"), (10, BASE + " more", "s2"), (11, BASE.replace("plain60 ", "other "), "s2"), (12, BASE.upper(), "s3"), (13, "a b c d e", "s3"), (14, "a b c d e f", "s3"),
        (9, BASE, "s2"), (None, "one two", "s1"), (None, None, None), (15, "x" * 300_000, "s4"), (16, "Ärger über Öl ist groß", "s5"),
    ]
    rows = [(i, t, None if i == 4 else "en", s, len(t) if t else 0, -1, "clash", -1, False, "clash", -1, -1) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((4, 1, 0), (9, 0, 1), (10, 1, None), (None, 0, 0), (9, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def shingles(text):
    w = WORD.findall((text or "").translate(SMALLER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))


def near_components(rows):
    """doc_id -> (set size, smallest reachable id), by comparing all that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    by, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    met = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in met:
        k = len(sets[a] & sets[b])
        if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]
