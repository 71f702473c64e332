import tracemalloc
import zlib
from collections import Counter
from math import lgamma, log

import numpy as np
import pyarrow as pa
import pytest

from terrace.llm import ctw, hashing
from tests.llm.helpers import documents


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def log_kt(a, b):
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi)


class Plain:
    """The same model with dictionaries and recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, Counter()
        for t in texts:
            s = ctw.MARK * depth + t + ctw.MARK
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    node = 1
                    for k in range(7, -1, -1):
                        bit = s[i] >> k & 1
                        self.n[s[i - d : i], node, bit] += 1
                        node = 2 * node + bit
        self.longer = {}
        for c, node, _ in list(self.n):
            if c:
                self.longer.setdefault((c[1:], node), set()).add(c)
        self.memo = {}

    def counts(self, c, node):
        return self.n[c, node, 0], self.n[c, node, 1]

    def weighted(self, c, node):
        if (c, node) not in self.memo:
            own = log_kt(*self.counts(c, node))
            self.memo[c, node] = own if len(c) == self.depth else np.logaddexp(own, sum(self.weighted(x, node) for x in self.longer[c, node])) - log(2)
        return self.memo[c, node]

    def one(self, context, node):
        p, rest = 0.0, 1.0
        for d in range(self.depth + 1):
            c = context[len(context) - d :]
            if not sum(self.counts(c, node)):
                return 0.5 if d == 0 else before
            a, b = self.counts(c, node)
            kt = (b + 0.5) / (a + b + 1)
            before = p + rest * kt
            own = 1.0 if d == self.depth else np.exp(log_kt(a, b) - log(2) - self.weighted(c, node))
            p, rest = p + rest * own * kt, rest * (1 - own)
        return before

    def byte(self, context, symbol):
        total, node = 0.0, 1
        for k in range(7, -1, -1):
            bit = symbol >> k & 1
            one = self.one(context, node)
            total += np.log10(one if bit else 1 - one)
            node = 2 * node + bit
        return total

    def score(self, t):
        s = ctw.MARK * self.depth + t + ctw.MARK
        return sum(self.byte(s[i - self.depth : i], s[i]) for i in range(self.depth, len(s)))


ROWS = [(k, t) for k, t in enumerate(["the cat sat", "The cat ran", "a dog sat on the mat", "", "été au lac", "the the the", "zebra", "cat", "on a mat", "qq", "The dog", "lake"] * 2)] + [(None, "the null cat"), (100, None), (101, "unseen ~bytes~ {}")]


@pytest.mark.parametrize("depth", [3, 4])
def test_agrees_with_a_plain_model(spark, depth):
    found = {(r.doc_id, r.score): r for r in ctw.lm_scores(documents(spark, ROWS), ctw.Ctw(depth=depth, block_bytes=60, group_rows=20)).collect()}
    assert len(found) == len(ROWS)
    low = lambda t: (t or "").encode().translate(hashing.LOWER)
    model = Plain([low(t) for d, t in ROWS if not held(d)], depth)
    tokens = Counter(w for d, t in ROWS if not held(d) for w in [*low(t).split(), None])
    n, v = sum(tokens.values()), len(tokens)
    by = {}
    for r in found.values():
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in ROWS:
        (r,) = by[doc]
        words = [*low(text).split(), None]
        assert r.held_out == held(doc) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(words), sum(tokens[w] > 0 for w in words))
        assert abs(r.base_score - sum(np.log10((tokens[w] + 1) / (n + v + 1)) for w in words)) < 1e-9
        assert abs(r.score - model.score(low(text))) < 1e-6


def test_probabilities_of_all_bytes_sum_to_one():
    texts = [b"abracadabra", b"abra", b"cad"]
    keys, n = ctw.block_keys(texts, np.array([True, True, False]), 3)
    grams = keys[keys < ctw._WORD]
    levels = ctw.ladder(grams, n[keys < ctw._WORD], 3, 0)
    for above, level in zip([None, *levels[:0:-1]], levels[::-1]):
        level.descend(above)
    for context in (b"abr", b"xyz", b"zra"):
        every = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** ctw.gram_logs(every, levels)).sum() - 1) < 1e-9


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100.5, 1e6])
    assert np.allclose(ctw._lgamma(x), [lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_odd_texts(spark):
    found = ctw.lm_scores(documents(spark)).collect()
    assert len(found) == 12 and all(r.score < 0 and r.n_tokens >= 1 for r in found)
    assert ctw.lm_scores(documents(spark, [])).count() == 0
    only = next(k for k in range(100) if held(k))
    (r,) = ctw.lm_scores(documents(spark, [(only, "ab")])).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and abs(r.score - 24 * np.log10(0.5)) < 1e-9


def test_a_block_needs_memory_for_its_keys_and_a_piece_not_for_all_its_texts():
    rng = np.random.default_rng(7)
    words = [bytes(w) for w in rng.integers(97, 123, (40_000, 8), dtype=np.uint8)]

    def peak(n):
        texts = [b" ".join(words[k:] + words[:k]) for k in range(n)]
        trained = np.arange(n) % 7 != 2
        tracemalloc.start()
        keys, counts = ctw.block_keys(texts, trained, 4)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (counts[keys >= ctw._WORD] == trained.sum()).all()
        return most

    peak(2)
    assert peak(40) < 1.3 * peak(8)


def test_texts_of_a_block_are_scored_batch_by_batch():
    texts = [b"the cat sat", b"a dog", b"", b"the the"]
    trained = np.array([True, True, False, True])
    keys, n = ctw.block_keys(texts, trained, 4)
    values = np.where(keys < ctw._WORD, -0.5, n)
    whole = ctw.block_scores(texts, keys, values, 4, 10, 5, 3)
    taken = []

    def batch(kind, ids, value, text):
        taken.append(kind)
        return pa.record_batch({"kind": pa.array(kind, pa.int32()), "id": pa.array(ids, pa.int64()), "value": pa.array(value, pa.float64()), "text": pa.array(text, pa.string())})

    def batches():
        turned, half = np.arange(len(keys))[::-1], len(keys) // 2
        ids = keys.view(np.int64)
        yield batch([0] * half, ids[turned[:half]], values[turned[:half]], [None] * half)
        rest = len(keys) - half
        yield batch([0] * rest + [1], [*ids[turned[half:]], None], [*values[turned[half:]], None], [None] * rest + ["The cat sat"])
        yield batch([1, 2], [7, 8], [None] * 2, ["a dog", None])
        yield batch([1], [9], [None], ["the the"])

    found = ctw.scored_in(batches(), 4, 10, 5, 3)
    first = next(found)
    assert len(taken) == 2 and first.column("doc_id").to_pylist() == [None]
    every = pa.Table.from_batches([first, *found]).to_pydict()
    assert every["doc_id"] == [None, 7, 8, 9] and every["held_out"] == [False, False, True, False] and set(every["train_tokens"]) == {10}
    for name, expected in whole.items():
        assert np.allclose(every[name], expected, rtol=0, atol=1e-12)


def test_batches_do_not_change_results(spark):
    def run():
        return sorted(map(tuple, ctw.lm_scores(documents(spark, ROWS), ctw.Ctw(block_bytes=200)).collect()), key=str)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, usual = spark.conf.get(name), run()
    spark.conf.set(name, "3")
    try:
        found = run()
    finally:
        spark.conf.set(name, before)
    assert [r[:5] for r in found] == [r[:5] for r in usual]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in usual], rtol=0, atol=1e-9)
