import random

import pytest

from terrace.llm import hashing
from terrace.llm.graph import components
from terrace.llm.near_dedup import NearDedup, near_duplicates
from tests.llm.helpers import documents


def brute(rows, how):
    """Components over all pairs, on sets of words."""
    sets = []
    for doc, text in rows:
        w = (text or "").encode().translate(hashing.LOWER).split()
        k = how.shingle
        sets.append((doc, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= how.similarity * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, s) in enumerate(sets):
        groups.setdefault(find(i), []).append((doc, len(s)))
    out = []
    for members in groups.values():
        ids = [d for d, _ in members if d is not None]
        out += [(d, n, min(ids) if ids else None) for d, n in members]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("shingle", "similarity"), [(3, 85), (5, 80)])
def test_agrees_with_all_pairs(spark, shingle, similarity):
    r = random.Random(shingle)
    words = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([30, 80, 200]))]
        for _ in range(r.choice([1, 3, 12, 60])):
            copy = [r.choice(words) if r.random() < r.choice([0, 0.005, 0.02, 0.06]) else w for w in base]
            rows.append((number, " ".join(copy).replace("w1", "W1")))
            number += 1
    r.shuffle(rows)
    how = NearDedup(shingle=shingle, similarity=similarity)
    assert result(near_duplicates(documents(spark, rows), how)) == brute(rows, how)


def test_large_group_about_the_threshold(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(204)]
    rows = []
    for number in range(200):  # 20 places of two variants each: two texts are near if at most 4 differ, and all share large buckets
        text = list(base)
        for place in range(20):
            if r.random() < 0.5:
                text[5 + 10 * place] = f"v{place}"
        rows.append((number, " ".join(text)))
    how = NearDedup(small=2, chunk=16, slice=5000)  # nearly all buckets are large ones, with few members that all others meet first
    expected = brute(rows, how)
    assert 2 < len({c for _, _, c in expected}) < 190
    assert result(near_duplicates(documents(spark, rows), how)) == expected


def test_pairs_at_the_threshold_meet_as_surely_at_80_as_at_85():
    def meet(how):
        return (1 - (1 - (how.similarity / 100) ** how.width) ** how.side) ** 2

    assert meet(NearDedup()) >= meet(NearDedup(shingle=3, similarity=85, width=3)) > 0.9998


def test_odd_texts(spark):
    found = near_duplicates(documents(spark), NearDedup(shingle=3, similarity=85)).collect()
    by = {(r.doc_id, r.n_shingles): r for r in found}
    assert len(found) == 12
    assert by[2, 12].component_id == 1 and not by[2, 12].kept and by[1, 12].kept
    assert by[3, 0].kept and by[4, 0].component_id == 4  # wordless texts are linked with nothing
    assert [r.kept for r in found if r.doc_id == 7] == [True, True]
    assert by[9, 1].n_shingles == 1 and by[10, 1].component_id == 10
    assert [r.kept for r in found if r.doc_id is None] == [True, True]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 7), (6, 6), (None, 1), *((100 + k, 99) for k in range(50)), (120, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[9] == got[8] == got[7] == 7 and 6 not in got
    assert {got[k] for k in (1, 2, 3, 4, 5, 99, 120, 149)} == {1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_sets():
    a, b, c, d, e = hashing.shingle_sets([b"a b c a b c", b" a\tb\nc ", b"", b"a b", b"b a"], 3)
    assert len(a) == 3 and len(b) == 1 and b[0] in a and len(c) == 0 and len(d) == 1 and d[0] != e[0]


def test_query(spark, sf_dir, duck):
    from terrace.llm import queries
    from tests.oracle import same

    name = "op8_minhash_near_dedup"
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.SQL[name])


def test_overlaps_are_counted_as_sets():
    import numpy as np

    from terrace.llm.near_dedup import overlaps

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, k)) for k in (0, 1, 10, 40, 40)]
    expected = [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert overlaps(sets, sets).tolist() == expected
