import random
import re

import numpy as np

from terrace.llm import quality
from terrace.llm.queries import QUERIES
from tests.llm.helpers import documents


def test_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op5_nbsvm_quality"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_slots_do_not_depend_on_the_batch():
    how = quality.Quality()
    texts = [b"One two two three.", b"", b"   ", b"A", b"junk*** more%%% junk***", b"One two two three."]
    slots, begins = quality.features(texts, how)
    alone = [quality.features([t], how)[0] for t in texts]
    for k, own in enumerate(alone):
        assert np.array_equal(slots[begins[k] : begins[k + 1]], own)
    assert len(alone[1]) == len(alone[2]) == 0 and np.array_equal(alone[0], alone[5])


def plain_features(text, how):
    """N-grams of words and of word shapes, as sets of tuples."""
    words = re.findall(r"[^\x20\t-\r]+", "".join(c.lower() if c.isascii() else c for c in text))
    originals = re.findall(r"[^\x20\t-\r]+", text)
    shapes = []
    for k, w in enumerate(originals):
        signs = "".join("a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in w)
        shapes.append((re.sub(r"(.)\1+", r"\1", signs), k > 0 and words[k] == words[k - 1]))
    return {("w", *words[i : i + n]) for n in how.word_n for i in range(len(words) - n + 1)} | {("s", *shapes[i : i + n]) for n in how.shape_n for i in range(len(shapes) - n + 1)}


def test_features_are_the_distinct_grams():
    how = quality.Quality(dimensions=1 << 31)
    r = random.Random(2)
    texts = [" ".join(r.choice(["One", "one", "ab", "AB", "12", "x1", "é", "***", "a-b"]) for _ in range(r.randint(0, 30))) for _ in range(60)]
    slots, begins = quality.features([t.encode() for t in texts], how)
    assert [int(b - a) for a, b in zip(begins, begins[1:])] == [len(plain_features(t, how)) for t in texts]


def test_ratios_and_margin_on_a_case_worked_out_by_hand():
    how = quality.Quality(dimensions=4, epochs=400)
    rows = quality.Rows.of([np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])] * 2)
    labels = np.array([True, True, False, False] * 2)
    model = quality.fit(rows, labels, how)
    # Slot 0 is in four good rows of 6 + 4 smoothed counts, slot 1 in four bad ones, slot 2 in both alike, slot 3 in none.
    assert np.allclose(model.weight[1], [np.log(5) ** 2, np.log(5) ** 2, 0, 0], atol=1e-5)
    assert model.weight[0][0] > 0 > model.weight[0][1] and abs(model.weight[0][0] + model.weight[0][1]) < 0.05 and abs(model.bias) < 0.05


def test_dual_coordinate_descent_separates():
    how = quality.Quality(dimensions=64)
    rng = np.random.default_rng(0)
    labels = rng.random(200) < 0.7
    rows = [np.unique(np.concatenate((rng.integers(8, 64, 6), [int(y)]))) for y in labels]
    model = quality.fit(quality.Rows.of(rows), labels, how)
    margins = np.array([model.weight[0][r].sum() / np.sqrt(model.weight[1][r].sum()) + model.bias for r in rows])
    assert np.mean((margins > 0) == labels) > 0.98


def test_odd_texts_and_labels(spark):
    rows = [(k, ("good words here and there. " if k % 3 else "bad!! *** %%% ") * 20) for k in range(60)]
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0) for k in range(60)] + [(None, 1), (5, None), (6, 7), (4, 0), (4, 1), (999, 1)], "doc_id long, quality int")
    model = quality.train(documents(spark, rows), labels, held_out=0)
    odd = documents(spark)
    named = quality.scored(odd, model)
    assert named.columns[-2:] == ["_score", "predicted"] and {r.score for r in named.collect()} == {"mine"}
    found = quality.scored(odd, model, score_to="__s", predicted_to="__p").collect()
    assert len(found) == 12 and all(0 <= r["__s"] <= 1 for r in found)
    blank = {r["__s"] for r in found if not (r.text or "").strip()}
    assert len(blank) == 1
    assert quality.scored(documents(spark, []), model).count() == 0
    nothing = quality.train(documents(spark, []), labels.limit(0))
    assert quality.scored(odd, nothing, score_to="__s", predicted_to="__p").count() == 12
    one_class = quality.train(documents(spark, rows), labels.where("quality = 1"), held_out=0)
    assert {r["__p"] for r in quality.scored(odd, one_class, score_to="__s", predicted_to="__p").collect()} == {1}
