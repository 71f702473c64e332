"""Thin queries over the shared tables, one per operator, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import ctw, decontaminate, exact_topk, fixity, licenses, near_dedup, packing, pii, quality, tool_calls
from terrace.llm.common import cut, table

#: The tokenizer file of op2 and of the pipeline, by name among the public ones.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = near_dedup.near_duplicates(docs, near_dedup.NearDedup(shingle=3, similarity=85, width=3))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), e AS (SELECT doc_id, unnest(s) AS g FROM s
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


@query("op6_winnowing_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_md5")


SQL["op6_winnowing_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM bw
), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
), hits AS (SELECT doc_id, item, dw.m, i FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), ids AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op5_nbsvm_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op4_semicrf_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(tokenizer_path()))


@query("op9_nra_top_k")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings")).drop("depth")


SQL["op9_nra_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op7_context_tree_weighting")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(table(spark, sf_dir, "documents"))


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


SQL["op1_license_scan"] = licenses.recognise_sql()


@query("op3_merkle_fixity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archive of ``pages`` with its place, hash and root, and its state in a replica.

    The replica is written from the same pages and then suffers known damage: of
    the records whose id has a crc32 divisible by 97 those of odd id are lost and
    the others have one character of their body changed.
    """
    how = fixity.Archive()
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mine = cut(fixity.manifest(pages, how))
    hurt = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % 97 == 0, F.lit(False))
    record = lambda html: F.sha2(fixity.record_text(F.col("page_id"), F.col("url").cast("string"), html), 256)
    bent = pages.where(hurt & (F.abs("page_id") % 2 == 0)).select(
        "page_id", record(F.col("html").cast("string")).alias("record_sha256"), record(F.overlay(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit("~"), F.lit(1), F.lit(1))).alias("bent_sha256")
    )
    # Several pages of one id are told apart by their records.
    kept = mine.where(~(hurt & (F.abs("page_id") % 2 == 1))).join(bent.distinct(), ["page_id", "record_sha256"], "left")
    replica = cut(kept.select("file_no", "part", "slot", F.coalesce("bent_sha256", "record_sha256").alias("record_sha256")))
    levels = max(fixity.levels_of(mine, how), fixity.levels_of(replica, how))
    ours = fixity.tree(mine, how, levels)
    found = fixity.differences(ours, fixity.tree(replica, how, levels), how)
    states = mine.join(found, ["file_no", "part", "slot"], "left").join(fixity.roots_of(ours), ["file_no", "part"])
    return states.select("file_no", "part", "slot", "page_id", "offset", "length", "copies", "record_sha256", "root_sha256", F.coalesce("damage", F.lit("sound")).alias("state"))


SQL["op3_merkle_fixity"] = r"""
WITH RECURSIVE crc(k, t) AS (
  SELECT CAST(i AS BIGINT), list_reduce([CAST(i AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256) AS r(i)
), tab AS (SELECT list(t ORDER BY k) AS t FROM crc
), p AS (
  SELECT page_id, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(page_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, c: xor(a >> 8, tab.t[1 + (xor(a, c) & 255)]))) AS crc32
  FROM (SELECT page_id, url, html FROM pages), tab
), u AS (SELECT page_id, rec, crc32, count(*) AS copies FROM p GROUP BY ALL
), m AS (
  SELECT page_id // 256 AS file_no, row_number() OVER w - 1 AS slot, page_id, CAST(sum(strlen(rec)) OVER w - strlen(rec) AS BIGINT) AS "offset", CAST(strlen(rec) AS BIGINT) AS length, copies, sha256(rec) AS record_sha256, crc32
  FROM u WINDOW w AS (PARTITION BY page_id // 256 ORDER BY page_id, sha256(rec))
), one AS (SELECT file_no, slot // 16 AS node, sha256(string_agg(record_sha256, '' ORDER BY slot)) AS h FROM m GROUP BY ALL
), root AS (SELECT file_no, sha256(string_agg(h, '' ORDER BY node)) AS root_sha256 FROM one GROUP BY ALL)
SELECT file_no, CAST(0 AS BIGINT) AS part, slot, page_id, "offset", length, copies, record_sha256, root_sha256, CASE WHEN crc32 % 97 <> 0 THEN 'sound' WHEN page_id % 2 = 1 THEN 'missing' ELSE 'corrupt' END AS state
FROM m JOIN root USING (file_no)
"""


#: What a user's turn asks of the tool "reply", as the schema of its arguments.
REPLY = {
    "type": "object",
    "required": ["chars", "conversation", "prompt", "turn"],
    "additionalProperties": False,
    "properties": {"chars": {"type": "integer", "minimum": 8, "maximum": 1500}, "conversation": {"type": "integer"}, "prompt": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}},
}


@query("op10_tool_call_linking")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of ``conversations`` as a call of "reply", the assistant's next turn as its result.

    A call waits for the call two turns before it.  Other turns of the assistant
    are results without a call.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    named = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.length("text").alias("chars"), F.col("conv_id").alias("conversation"), F.col("text").alias("prompt"), "turn"))
    calls = turns.where("role = 'user'").select("conv_id", named(0).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(named(2)).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", named(1).alias("call_id"), F.col("text").alias("content"))
    return tool_calls.link(calls, results, {"reply": REPLY})


SQL["op10_tool_call_linking"] = """
WITH c AS (SELECT conv_id, conv_id || ':' || turn AS call_id, turn, text FROM conversations WHERE role = 'user'
), r AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, turn AS "position",
  CASE WHEN c.call_id IS NULL THEN NULL ELSE CAST(0 AS INTEGER) END AS hops,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS state,
  CASE WHEN c.call_id IS NULL THEN '' WHEN length(text) < 8 THEN '/chars: minimum' WHEN length(text) > 1500 THEN '/chars: maximum' ELSE '' END AS errors,
  CASE WHEN c.call_id IS NULL THEN '{"id":' || to_json(r.call_id) || ',"result":' || to_json(content) || '}'
    ELSE '{"arguments":{"chars":' || length(text) || ',"conversation":' || c.conv_id || ',"prompt":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(c.call_id)
      || ',"name":"reply","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' END AS line
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
