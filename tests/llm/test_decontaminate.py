import hashlib
import random
import re

import pytest

from terrace.llm import decontaminate, queries
from terrace.llm.decontaminate import contamination
from tests.llm.helpers import documents
from tests.oracle import same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    out = []
    for doc, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            m = min(13, len(v))
            if item is None or not v:
                continue
            windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    ids.add(str(item))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [True, False], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed, few, monkeypatch):
    if not few:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    r = random.Random(seed)
    pool = ["Alpha", "beta", "gamma", "été", "x1"]  # few words: many chance runs and ties
    line = lambda n: " ".join(r.choice(pool) + r.choice(["", ",", "!"]) for _ in range(n))
    items = [(k, line(n)) for k, n in enumerate([13, 14, 20, 40, 12, 3, 1, 0, 13])] + [(None, line(20)), (50, None), (3, line(30))]
    items += [(60, items[2][1]), (2, items[0][1])]
    rows = [(k, line(r.choice([0, 1, 5, 12, 13, 30, 90]))) for k in range(30)]
    rows += [(100 + k, line(40) + " " + t.upper() + " " + line(40)) for k, (_, t) in enumerate(items[:5])]
    rows += [(None, rows[3][1]), (None, None), (7, rows[7][1]), (8, None)]
    if seed == 2:  # no short items
        items = [x for x in items if len(words(x[1])) >= 13]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(documents(spark, rows), bench)
    assert sorted((tuple(x)[:1] + tuple(x)[2:] for x in found.collect()), key=repr) == brute(rows, items)


@pytest.mark.parametrize("few", [True, False], ids=["broadcast", "shuffled"])
def test_odd_texts_and_empty_tables(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    bench = spark.createDataFrame([(1, "long " * 15)], "item_id long, text string")
    found = contamination(documents(spark), bench).collect()
    assert len(found) == 12 and {r.doc_id for r in found if r.contaminated} == {9}
    assert [r.n_hit for r in found if r.doc_id == 9] == [20_000]
    assert {r.n_items for r in contamination(documents(spark), bench.limit(0)).collect()} == {0}
    assert contamination(documents(spark, []), bench).count() == 0


def test_query(spark, sf_dir, duck):
    name = "op6_winnowing_decontamination"
    df = queries.QUERIES[name](spark, sf_dir)
    same(df, duck, queries.SQL[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_by_shuffle(spark, sf_dir, duck, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    name = "op6_winnowing_decontamination"
    df = queries.QUERIES[name](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    same(df, duck, queries.SQL[name])
