import datetime as dt
import json
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.llm import exact_topk, fixity, licenses, queries, tool_calls
from tests.llm.helpers import documents
from tests.oracle import same


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_merkle_fixity", "op9_nra_top_k", "op10_tool_call_linking"])
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.SQL[name])


# --- licences ---------------------------------------------------------------------------------------------------------

MIT = " ".join(licenses.SENTENCES[k] for k in ("mitgrant", "mitnotice", "mitasis", "mitliable"))
CASES = [
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("text before\nThis work is licensed under the GNU General Public License, version 3.\nafter", "GPL-3.0-only"),
    (re.sub(r"(.{40,60}) ", r"\1\n", MIT), "MIT"),
    ("\n".join(licenses.SENTENCES[k] for k in ("bsdgrant", "bsdsource", "bsdbinary", "bsdasis")), "BSD-2-Clause"),
    ("\n".join(licenses.SENTENCES[k] for k in ("bsdgrant", "bsdsource", "bsdbinary", "bsdendorse", "bsdasis")), "BSD-3-Clause"),
    (licenses.SENTENCES["bsdgrant"], ""),
    (" ".join(licenses.SENTENCES[k] for k in ("gplfree3", "gplhope", "gpldetails", "gplcopy")), "GPL-3.0-or-later"),
    (" ".join(licenses.SENTENCES[k] for k in ("gplfree2", "gplhope", "gpldetails")), "GPL-2.0-or-later"),
    ("RELEASED UNDER THE MIT LICENSE!  Licensed under CC BY-NC 4.0. Released under the MIT License", "MIT,CC-BY-NC-4.0"),
    ("All rights reserved", "LicenseRef-All-Rights-Reserved"),
    ("A licence is mentioned here.", ""),
    (None, ""),
    ("", ""),
]


def test_licences(spark):
    rows = [(k, t) for k, (t, _) in enumerate(CASES)]
    df = licenses.recognise(documents(spark, rows))
    assert {r.doc_id: r.licenses for r in df.collect()} == {k: e for k, (_, e) in enumerate(CASES)}
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert licenses.recognise(documents(spark)).count() == 12
    assert licenses.recognise(documents(spark, [])).count() == 0


# --- fixity -----------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"hash": F.lit(1), "node": F.lit(2), "length": F.lit(3)})


def test_audit_finds_what_differs(spark):
    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" * (k % 7)) for k in range(700)]
    mine = fixity.manifest(pages(spark, rows)).persist()
    assert mine.count() == 700
    first = mine.where("file_no = 1").orderBy("slot").collect()
    assert [r.slot for r in first] == list(range(256)) and [r.page_id for r in first] == list(range(256, 512))
    assert all(a.offset + a.length == b.offset for a, b in zip(first, first[1:]))
    assert fixity.audit(mine, mine).count() == 0
    bad = mine.where("page_id != 300").withColumn("record_sha256", F.when(F.col("page_id").isin(5, 699), F.sha2(F.lit("x"), 256)).otherwise(F.col("record_sha256")))
    extra = mine.limit(1).withColumns({"file_no": F.lit(9).cast("long"), "slot": F.lit(0).cast("long")})
    got = {(r.file_no, r.slot): r.damage for r in fixity.audit(mine, bad.unionByName(extra)).collect()}
    assert got == {(0, 5): "corrupt", (2, 187): "corrupt", (1, 44): "missing", (9, 0): "extra"}
    assert fixity.roots(mine).count() == 3


def test_odd_pages(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", None), (None, None, None), (None, "u", "b"), (2, "u", "é" * 30_000)] + [(4, "u", str(k)) for k in range(600)]
    found = fixity.manifest(pages(spark, rows)).collect()
    assert len(found) == 605 and sum(r.copies for r in found) == 606
    assert max(r.slot for r in found if r.file_no == 0) < 512 and min(r.file_no for r in found) < 0
    empty = fixity.manifest(pages(spark, []))
    assert empty.count() == 0 and fixity.audit(empty, empty).count() == 0


def test_audit_query_with_repeated_ids(spark, tmp_path):
    hurt = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 97 == 0]
    even, odd = next(k for k in hurt if k % 2 == 0), next(k for k in hurt if k % 2)
    rows = [(k, "u", str(k)) for k in range(40) if k not in hurt] + [(even, "u", "a"), (even, "u", "a"), (even, "u", "b"), (even, "u", None), (odd, "u", "a"), (odd, "u", "b"), (None, "u", "c"), (None, "u", "c")]
    rows += [(even + 1, "u", str(k)) for k in range(600)]  # a file of two parts and more
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.QUERIES["op3_merkle_fixity"](spark, str(tmp_path)).collect()
    assert sum(r.copies for r in found) == len(rows) and len(found) == len(set(rows))
    assert len({(r.file_no, r.part, r.slot) for r in found}) == len(found) and max(r.part for r in found) > 0
    assert len({(r.file_no, r.part) for r in found}) == len({(r.file_no, r.part, r.root_sha256) for r in found})
    state = lambda k: "sound" if k not in hurt else "missing" if k % 2 else "corrupt"
    assert all(r.state == state(r.page_id) for r in found)


# --- top-k ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=8), 1)], "x") for k in range(300)]  # rounded: many ties
    rows += [(k, None, "x") for k in (400, 401)] + [(450, [float("nan")] * 8, "x"), (500, [1.0, None] * 4, "x"), (None, [0.1] * 8, "x"), (550, [], "x"), (600, [1.0, 2.0], "x"), (601, [float("inf"), 1.0], "x"), (50, rows[50][1], "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_topk.top_k(df, exact_topk.TopK(block=block, query_block=3)).collect()}
    whole = {k: np.floor(256 * np.array(v)).astype(int) for k, v, _ in rows[:300]}
    expected = {}
    for q in range(0, 300, 50):
        order = sorted(((-int(whole[q] @ whole[k]), k) for k in whole if k != q))[:5]
        expected |= {(q, i + 1): (k, -s) for i, (s, k) in enumerate(order)}
    assert found == expected  # 600 has no like but the query itself, 450 and 500 take no part


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 1, 256 * 512), (2, 2, 0)]
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_every_vector_of_a_repeated_id_is_a_candidate(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 1, 256 * 768), (2, 1, 256 * 512), (3, 2, 0)]


def test_reading_stops_early_where_it_can():
    rng = np.random.default_rng(1)
    vectors = rng.integers(0, 3, (4000, 4))
    vectors[17] = 500
    vectors[99] = 400
    lists = exact_topk.Lists(np.arange(4000), vectors)
    (found,) = lists.top(np.array([[1, 1, 1, 1]]), np.array([-1]), exact_topk.TopK(k=2))
    assert list(found[1]) == [17, 99] and found[3] < 4000


@pytest.mark.parametrize("size", [24, 4000, 1 << 31])
@pytest.mark.parametrize("slice_", [1, 7, 64])
def test_lists_agree_with_all_products(size, slice_):
    rng = np.random.default_rng(size % 97 + slice_)
    vectors, queries = rng.integers(-size, size, (50, 6)) // 8, rng.integers(-size, size, (9, 6)) // 8
    own = np.arange(0, 90, 10)  # the later ones are no vector's
    found = {i: (x.tolist(), s.tolist()) for i, x, s, _ in exact_topk.Lists(np.arange(50), vectors).top(queries, own, exact_topk.TopK(slice=slice_))}
    for i, q in enumerate(queries.tolist()):
        best = sorted((-sum(a * b for a, b in zip(q, v)), k) for k, v in enumerate(vectors.tolist()) if k != own[i])[:5]
        assert found[i] == ([k for _, k in best], [-s for s, _ in best])


def test_scores_beyond_doubles_are_exact():
    big = 1 << 28
    vectors = np.array([[big, 1], [big, 2], [big, 0], [-big, 5]])
    ((_, ids, scores, _),) = exact_topk.Lists(np.arange(4), vectors).top(np.array([[big, 1]]), np.array([-1]), exact_topk.TopK(k=3))
    assert ids.tolist() == [1, 0, 2] and scores.tolist() == [(big << 28) + x for x in (2, 1, 0)]
    with pytest.raises(OverflowError):
        list(exact_topk.Lists(np.arange(1), vectors[:1] << 30).top(vectors[:1] << 30, np.array([-1]), exact_topk.TopK()))


# --- tool calls -------------------------------------------------------------------------------------------------------

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
SCHEMA = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}}}}}


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [
        (1, "a", 0, "f", '{"a": 1}', ["d"]), (1, "b", 1, "f", '{"b": ["xyz"], "a": -1.5, "z": 0}', ["a"]), (1, "c", 2, "g", "{}", []), (1, "d", 3, "f", "{not json", ["c", "none"]),
        (1, "a", 5, "f", '{"a": 9}', None), (2, "x", 0, "f", None, ["y"]), (2, "y", 1, "f", '{"a": true}', ["x"]), (None, "n", 0, "f", "{}", None), (3, None, 0, "f", "{}", None),
    ]
    results = [(1, "a", "one"), (1, "a", "another"), (1, "lost", "late"), (2, "y", None), (None, "n", "x")]
    found = {(r.conv_id, r.call_id): r for r in tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, call_id string, content string"), SCHEMA).collect()}
    assert {k: r.state for k, r in found.items()} == {(1, "a"): "linked", (1, "b"): "unanswered", (1, "c"): "unanswered", (1, "d"): "unanswered", (1, "lost"): "orphan", (2, "x"): "cycle", (2, "y"): "cycle"}
    order = sorted("abcd", key=lambda c: (found[1, c].position, found[1, c].hops))
    assert order.index("c") < order.index("d") < order.index("a") < order.index("b")
    assert found[1, "a"].line == '{"arguments":{"a":1},"id":"a","name":"f","result":"another"}'
    assert found[1, "b"].errors == "/a: type;/b/0: maxLength;/z: unknown"
    assert (found[1, "c"].errors, found[1, "d"].errors, found[2, "y"].errors, found[2, "x"].errors) == ("tool: unknown", "arguments: not JSON", "/a: type", "/: type")
    assert json.loads(found[1, "lost"].line) == {"id": "lost", "result": "late"}


def test_cycles_are_told_from_what_waits_for_them():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 8)
        edges = sorted({(str(r.randrange(n)), str(r.randrange(n))) for _ in range(r.randint(1, 12))})
        reach = {a: {b for x, b in edges if x == a} for a in map(str, range(n))}
        for _ in range(n):
            reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
        got = tool_calls.on_cycles(pd.DataFrame([(1, a, b) for a, b in edges], columns=["conv_id", "call_id", "other"]))
        assert set(got.call_id) == {a for a in reach if a in reach[a]} and set(got.conv_id) <= {1}


def test_forward_chains_cycles_and_what_follows_them(spark):
    calls = [(1, f"c{k}", k, "f", "{}", [f"c{k + 1}"] if k < 6 else None) for k in range(7)]  # each waits for the next turn
    calls += [(2, "p", 0, "f", "{}", ["q"]), (2, "q", 1, "f", "{}", ["p"]), (2, "after", 2, "f", "{}", ["q"]), (2, "before", 9, "f", "{}", None), (2, "self", 4, "f", "{}", ["self", "before"])]
    found = {(r.conv_id, r.call_id): r for r in tool_calls.positions(spark.createDataFrame(calls, CALLS)).collect()}
    assert {k for k, r in found.items() if r.cyclic} == {(2, "p"), (2, "q"), (2, "self")}
    assert sorted(range(7), key=lambda k: (found[1, f"c{k}"].position, found[1, f"c{k}"].hops)) == list(range(6, -1, -1))
    assert (found[2, "after"].position, found[2, "p"].position) == (2, 0)


def test_no_calls(spark):
    none = spark.createDataFrame([], CALLS)
    assert tool_calls.link(none, spark.createDataFrame([], "conv_id long, call_id string, content string"), {}).count() == 0


def test_canonical():
    assert tool_calls.canonical({"b": [1.0, 2.5, None, True], "a": {"é": "x\n"}}) == '{"a":{"é":"x\\n"},"b":[1,2.5,null,true]}'
    assert tool_calls.errors_of(3, {"enum": [1, 2]}) == ["/: enum"] and tool_calls.errors_of("ab", {"pattern": "^b"}) == ["/: pattern"]


def test_library_does_not_need_the_subpackage():
    import pathlib

    import terrace

    root = pathlib.Path(terrace.__file__).parent
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and "terrace.llm" in p.read_text()]
    assert users == [] and dt
