"""Benchmark decontamination by winnowing, in DataFrame functions only.

Documents and items become words.  Of every run of ``window`` words both sides
keep the smallest hash of its ``gram``-word grams, so two texts that share any
``window`` words share a kept hash.  A document's kept hashes are looked up
among the items'; each hit is extended to the windows around it, and those are
compared as text.

The items' hashes and windows are broadcast while they hold few bytes, and then
no text is shuffled.  Beyond that only (document, hash) pairs are dealt out, with
a salt against passages that many documents share; the texts of the documents
that were hit follow them by key, once.

An item of fewer than ``window`` words is one window.  Such lengths, if there
are any, are looked up as runs of just so many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import cut, lower_ascii, prepare

#: Benchmark hashes or windows of up to so many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row and a reference take besides their text.
_ROW, _ENTRY = 48, 24
#: A hash or window that is joined by shuffle goes to so many tasks.
SALTS = 16
_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of lower-cased text: runs of digits, a-z and everything beyond ASCII; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _SPLIT), "")


def _run(words: Column, at: Column, n: int) -> Column:
    """The ``n`` words from index ``at``, as text."""
    return F.array_join(F.slice(words, at + 1, n), " ")


def _starts(words: Column, n: int) -> Column:
    """0 .. size - n; empty if there are fewer words."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def grams_of(words: Column, gram: int) -> Column:
    return F.transform(_starts(words, gram), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))


def kept_of(grams: Column, span: int) -> Column:
    """The distinct minima of all runs of ``span`` hashes."""
    return F.array_distinct(F.transform(_starts(grams, span), lambda i: F.array_min(F.slice(grams, i + 1, span))))


def _held(df: DataFrame, size: Column) -> tuple[DataFrame, bool]:
    """``df``, written, and whether its rows, of ``size`` bytes each, are few enough to broadcast."""
    df = cut(df)
    n = df.agg(F.sum(size + _ROW)).first()[0] or 0
    return df, n <= BROADCAST_BYTES


def _looked_up(rows: DataFrame, held: tuple[DataFrame, bool], key: str, by: list[str], how: str) -> DataFrame:
    """``rows`` joined to ``held`` by ``key``; beyond broadcasting, the rows of one key are dealt out by ``by``."""
    known, few = held
    if few:
        return rows.join(F.broadcast(known), key, how)
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS))).join(salted, [key, "salt"], how).drop("salt")


def _windows_of(items: DataFrame, runs: Column) -> tuple[DataFrame, bool]:
    """win and the items that hold it."""
    windows = items.select("item", F.explode(runs).alias("win")).groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    size = F.octet_length("win") + F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + _ENTRY)
    return _held(windows, size)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 5, parts: int = 20
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_md5, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of an item's window is hit.  contaminated: some
    word is hit, and ``parts`` times the hit words are at least all words.  Null,
    empty and wordless texts have no words and are clean; items without words or
    without an id are passed over, and items with equal id count once.  Equal
    (doc_id, text) rows get one result each.  Other columns are not read.
    """
    if gram > window:
        raise ValueError("gram must not exceed window")
    spark = prepare(docs.sparkSession)
    span = window - gram + 1
    items = cut(benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).where("item is not null and size(w) > 0"))
    long, short = items.where(F.size("w") >= window), items.where(F.size("w") < window)
    prints = _held(long.select(F.explode(kept_of(grams_of(F.col("w"), gram), span)).alias("h")).distinct(), F.lit(8).cast("long"))
    windows = _windows_of(long, F.transform(_starts(F.col("w"), window), lambda i: _run(F.col("w"), i, window)))

    key = ["doc_id", "text_md5"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_md5"), words_of(F.col(text)).alias("w"))
    rows = rows.select(*key, F.size("w").alias("n_words"), "w", F.when(F.size("w") >= window, grams_of(F.col("w"), gram)).alias("g"))
    none = F.array().cast("array<long>")
    kept = F.coalesce(kept_of(F.col("g"), span), none)
    if prints[1]:
        # A null among the kept hashes carries the document's own row through the map-side join.
        marked = rows.select("*", F.explode(F.concat(F.array(F.lit(None).cast("long")), kept)).alias("h"))
        hit = marked.join(F.broadcast(prints[0].withColumn("known", F.lit(True))), "h", "left").where("h is null or known").drop("known")
    else:
        pairs = _looked_up(rows.select(*key, F.explode(kept).alias("h")), prints, "h", key, "left_semi")
        hashes = pairs.groupBy(*key).agg(F.collect_set("h").alias("hs")).withColumnsRenamed({"doc_id": "hit_id", "text_md5": "hit_md5"})
        hit = rows.join(hashes, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_md5") == F.col("hit_md5")))
        hit = hit.select(*key, "n_words", "w", "g", F.explode("hs").alias("h"))
    around = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(_starts(F.col("g"), 1), lambda p: F.get(F.col("g"), p) == F.col("h")),
                lambda p: F.sequence(F.greatest(p - (span - 1), F.lit(0)), F.least(p, F.col("n_words") - window)),
            )
        )
    )
    placed = hit.select(*key, "n_words", "w", F.explode(F.when(F.col("h").isNull(), F.array(F.lit(-1))).otherwise(around)).alias("s"))
    placed = placed.select(*key, "n_words", "s", F.when(F.col("s") >= 0, _run(F.col("w"), F.col("s"), window)).alias("win"))
    if prints[1] and windows[1]:
        found = placed.join(F.broadcast(windows[0]), "win", "left").where("s = -1 or items is not null").select(*key, "n_words", "s", F.lit(window).alias("len"), "items")
    else:
        spans = _looked_up(placed.where("s >= 0"), windows, "win", [*key, "s"], "inner").select(*key, "n_words", "s", F.lit(window).alias("len"), "items")
        found = spans.unionByName(rows.select(*key, "n_words", F.lit(-1).alias("s"), F.lit(window).alias("len"), F.lit(None).cast("array<string>").alias("items")))

    lengths = sorted(r[0] for r in short.select(F.size("w")).distinct().collect())  # at most window - 1 numbers
    for m in lengths:
        whole = _windows_of(short.where(F.size("w") == m), F.array(F.array_join("w", " ")))
        at = rows.select(*key, "n_words", "w", F.explode(_starts(F.col("w"), m)).alias("s"))
        at = at.select(*key, "n_words", "s", _run(F.col("w"), F.col("s"), m).alias("win"))
        found = found.unionByName(_looked_up(at, whole, "win", [*key, "s"], "inner").select(*key, "n_words", "s", F.lit(m).alias("len"), "items"))

    copies = F.count(F.when(F.col("s") == -1, 1))
    merged = found.groupBy(*key).agg(
        F.first("n_words").cast("long").alias("n_words"), copies.alias("copies"), F.array_sort(F.collect_set(F.when(F.col("s") >= 0, F.struct("s", "len")))).alias("spans"), F.collect_set("items").alias("items")
    )
    # Spans in order of their start: each adds what lies beyond the furthest end so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["s"] + x["len"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["s"] + x["len"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    merged = merged.select("doc_id", "text_md5", "n_words", "copies", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    return merged.select(
        "doc_id",
        "text_md5",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
