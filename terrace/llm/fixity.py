"""Fixity audit of WARC archives by Merkle trees.

Records are laid into archive files in order; each has an offset and a SHA-256.
Within a file the records' hashes are leaves, and every ``fan`` neighbours,
which are one range of offsets, make a node, up to one root a file.  Replicas are
compared from the roots down: only children of nodes that differ are looked at,
so an audit of a sound replica reads one row a file, and a damaged one adds a
path of nodes for each damaged range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import cut, prepare


@dataclass(frozen=True)
class Archive:
    """``records`` ids a file; files with more than twice as many records are split by content."""

    records: int = 256
    fan: int = 16


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record; its length is that of the body in bytes.  Nulls are written as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, how: Archive = Archive(), *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per distinct record: file_no, part, slot, page_id, offset, length, copies, record_sha256.

    A file holds a range of ids; records are ordered by id and then by hash.  Equal
    rows are one record with its number of copies.  Rows without an id go to files
    of negative number by their hash.  A file that many rows share (a repeated id)
    is split into parts by hash, so no file is much longer than intended.  Other
    columns are not read.
    """
    prepare(pages.sparkSession)
    text = record_text(F.col(page_id), F.col(url).cast("string"), F.col(html).cast("string"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("record_sha256"))
    rows = rows.groupBy("page_id", "length", "record_sha256").agg(F.count("*").alias("copies"))
    file_no = F.coalesce(F.floor(F.col("page_id") / how.records).cast("long"), -1 - F.pmod(F.xxhash64("record_sha256"), F.lit(1 << 20)))
    rows = cut(rows.withColumn("file_no", file_no))
    counts = rows.groupBy("file_no").agg(F.count("*").alias("n")).where(F.col("n") > 2 * how.records)
    rows = rows.join(counts, "file_no", "left").withColumn("part", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_sha256"), F.ceil(F.col("n") / how.records)))).drop("n")
    order = Window.partitionBy("file_no", "part").orderBy("page_id", "record_sha256", "length")
    return rows.select(
        "file_no", F.col("part").cast("long").alias("part"), (F.row_number().over(order) - 1).cast("long").alias("slot"), "page_id",
        (F.sum("length").over(order) - F.col("length")).alias("offset"), "length", "copies", "record_sha256",
    )


def levels_of(leaves: DataFrame, how: Archive) -> int:
    most = leaves.agg(F.max("slot")).first()[0]
    n = 1
    while (most or 0) >= how.fan**n:
        n += 1
    return max(n, 2)


def tree(leaves: DataFrame, how: Archive, levels: int) -> list[DataFrame]:
    """The levels (file_no, part, node, hash) of ``leaves(file_no, part, slot, record_sha256)``, leaves first, roots last.

    Each level above the leaves is written once, so comparing two trees reads it and not the leaves.
    """
    out = [leaves.select("file_no", "part", F.col("slot").alias("node"), F.col("record_sha256").alias("hash"))]
    for _ in range(levels):
        grouped = out[-1].groupBy("file_no", "part", F.floor(F.col("node") / how.fan).cast("long").alias("node"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])  # at most ``fan`` of them
        out.append(cut(grouped.agg(F.sha2(F.array_join(ordered, ""), 256).alias("hash"))))
    return out


def differences(ours: list[DataFrame], theirs: list[DataFrame], how: Archive = Archive()) -> DataFrame:
    """The slots at which two trees of equally many levels differ: file_no, part, slot, damage (corrupt, missing or extra)."""
    differing: DataFrame | None = None
    for mine, other in zip(reversed(ours), reversed(theirs)):
        keys = ["file_no", "part", "node"]
        if differing is not None:
            above = differing.select("file_no", "part", F.col("node").alias("above"))
            on = lambda df: df.withColumn("above", F.floor(F.col("node") / how.fan).cast("long")).join(above, ["file_no", "part", "above"], "left_semi").drop("above")  # noqa: E731, B023
            mine, other = on(mine), on(other)
        both = mine.join(other.withColumnRenamed("hash", "there"), keys, "full")
        differing = cut(both.where(~F.col("hash").eqNullSafe(F.col("there"))))
    damage = F.when(F.col("there").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("corrupt")
    return differing.select("file_no", "part", F.col("node").alias("slot"), damage.alias("damage"))


def audit(leaves: DataFrame, replica: DataFrame, how: Archive = Archive()) -> DataFrame:
    """The slots at which ``replica`` differs from ``leaves``, as :func:`differences` gives them.

    Both have file_no, part, slot and record_sha256; a slot is taken once on each
    side.  Only children of differing nodes are compared.
    """
    levels = max(levels_of(leaves, how), levels_of(replica, how))
    return differences(tree(leaves, how, levels), tree(replica, how, levels), how)


def roots(leaves: DataFrame, how: Archive = Archive()) -> DataFrame:
    """(file_no, part, root_sha256)."""
    return roots_of(tree(leaves, how, levels_of(leaves, how)))


def roots_of(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].select("file_no", "part", F.col("hash").alias("root_sha256"))
