import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SMALL
from helpers import LONG, SMALLER, no_documents, odd_documents
from oracle import assert_same
from ranksheaf.llm import divergence, registry

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, documents=3, top=200):
    """rows: (lang, source, text)."""
    words, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(TERM.findall((text or "").translate(SMALLER)))
        words[lang, source].update(found)
        held[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= documents]
        total = {s: sum(words[lang, s][t] for t in kept) for s in sources}
        p = lambda n, s, v=len(kept): 1 + 10**9 * (n + 1) // (s + v)
        p_all = {t: p(sum(words[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        share = {s: {t: p(words[lang, s][t], total[s]) for t in kept} for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, f(share[s][t], p_all[t])) for t in kept if words[lang, s][t] and share[s][t] > p_all[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:limit])]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_agrees_with_sql(spark):
    assert_same(registry.op12_source_divergence(spark, SMALL), registry.ORACLE_SQL["op12_source_divergence"], SMALL)


@pytest.mark.parametrize("how", [{}, {"postings": 7, "held": 3}, {"postings": 40, "broadcast_bytes": 0}])
def test_odd_cases(spark, how):
    docs = odd_documents(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect() if r.text is None or len(r.text) < 10**6]
    rng = random.Random(3)
    rows += [(lang, f"s{rng.randrange(6)}", " ".join(rng.choice(["Straße", "ß", "é", "É", "日本", "x1y", "don't", "the", "THE", "a_b"]) for _ in range(rng.randrange(40)))) for lang in ("en", None, "", "de") for _ in range(40)]
    rows += [("xx", "only", "alone alone"), ("yy", "a", "never kept"), ("yy", "b", "nor this"), ("zz", "a", ""), ("zz", None, None), ("zz", "", "7 8 9")]
    df = spark.createDataFrame([(*r, 0, 0, "clash") for r in rows], "lang string, source string, text string, n int, slot int, term string").repartition(5)
    assert found(divergence.divergence(df, top=5, **how)) == brute(rows, top=5)


def test_empty_table_and_long_texts(spark):
    assert divergence.divergence(no_documents(spark)).count() == 0
    rows = [("en", "a", LONG), ("en", "b", LONG), ("en", "b", LONG[:5000]), ("en", "c", None)]
    assert found(divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"))) == brute(rows)


def test_accumulators_at_large_counts():
    """Products past 64 bits are formed exactly; rows cut into pieces give the same sums."""
    rng = np.random.default_rng(1)
    starts = np.array([0, 2, 5, 6])
    slots, counts = np.array([0, 1, 0, 1, 2, 2]), np.array([3 * 10**10, 5, 7, 10**12, 2, 9])
    totals = np.array([4 * 10**10 + 3, 10**12 + 8, 14])
    zero = [1 + 10**9 // int(t) for t in totals]
    table = [[zero[g]] * 3 for g in range(3)]
    for t in range(3):
        for i in range(starts[t], starts[t + 1]):
            table[slots[i]][t] = 1 + 10**9 * (int(counts[i]) + 1) // int(totals[slots[i]])
    got = divergence.row_accumulators(slots, counts, starts, totals)
    assert all(got[a, b] == sum((x - y) ** 2 // y for x, y in zip(table[a], table[b], strict=True)) for a in range(3) for b in range(3) if a != b)
    lengths = rng.integers(1, 9, 50)
    slots = np.concatenate([np.sort(rng.permutation(9)[:n]) for n in lengths])
    starts, counts = np.concatenate(([0], np.cumsum(lengths))), rng.integers(1, 100, lengths.sum())
    want = divergence.row_accumulators(slots, counts, starts, np.full(9, 900))
    divergence.PIECE, kept = 4, divergence.PIECE
    assert (divergence.row_accumulators(slots, counts, starts, np.full(9, 900)) == want).all()
    divergence.PIECE = kept
