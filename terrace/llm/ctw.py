"""Language-model scores by context-tree weighting over bytes, and a word unigram base line.

A text's bytes (A-Z lowered, ``depth`` marks before, one after) are coded bit by
bit: every context of 0 .. depth preceding bytes holds, for each node of the
byte's binary tree, how often either bit followed.  A node's Krichevsky-Trofimov
probability of its training bits is weighted with the product of its children's,
one half each, from the deepest contexts up; the share that falls to the node
itself then mixes its estimate with those of deeper contexts.  Where a text
leaves what training has seen, the deepest context that saw the bit decides.

Distribution.  Rows are dealt into blocks of about ``block_bytes`` of text.  A
block reports its distinct (depth + 1)-byte grams and words with their training
counts; the sums over all blocks are the model's table, which therefore grows
with the corpus and is never collected.  Contexts deeper than two bytes are
worked out in groups of whole subtrees (by their last three bytes); the tree
above, which the alphabet bounds (65,536 contexts), is joined on the driver.
Each block gets back the values of just the grams and words it asked for.
A block's rows pass through a worker batch by batch, so that it holds the block's
distinct keys and a piece of its texts, however many texts that block has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import hashing
from terrace.llm.common import cut, prepare, stored

MARK = b"\xff"  # in no UTF-8 text; stands before the first byte and after the last
_WORD = np.uint64(1 << 63)  # set in the keys of words; grams have less than 2**48


@dataclass(frozen=True)
class Ctw:
    depth: int = 4
    block_bytes: int = 32 << 20
    group_rows: int = 200_000


# --- what a block holds ----------------------------------------------------------------------------------------------


def _encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(hashing.LOWER)


def _pieces(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) <= size):
            total += len(texts[to])
            to += 1
        yield at, to
        at = to


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte with its context, texts in order, end marks included; and where each text's begin."""
    buf = np.frombuffer(b"".join(MARK * depth + t + MARK for t in texts), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    keys = np.zeros(max(len(buf) - depth, 0), np.uint64)
    for i in range(depth + 1):
        keys = (keys << np.uint64(8)) | buf[i : len(buf) - depth + i]
    inside = np.ones(len(keys), bool)
    at = begins[1:-1] + depth * np.arange(len(texts) - 1)  # windows whose last byte is a mark before a text
    for i in range(depth):
        inside[at + i] = False
    return keys[inside], begins


class Tally:
    """Distinct keys, ascending, and their counts.  Takes one piece after another and grows only by the keys that are new."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """``keys`` ascending and distinct."""
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        self.n[at[hit]] += n[hit]
        if not hit.all():
            self.keys, self.n = np.insert(self.keys, at[~hit], keys[~hit]), np.insert(self.n, at[~hit], n[~hit])

    def read(self, texts: list[bytes], trained: np.ndarray, depth: int) -> None:
        """Adds the grams and words of ``texts``, those of texts that are not ``trained`` with counts of 0."""
        for learn in (True, False):
            own = [t for t, x in zip(texts, trained) if bool(x) == learn]
            for a, b in _pieces(own):
                for found in (grams_of(own[a:b], depth)[0], hashing.words_of(own[a:b])[0] | _WORD):
                    keys, n = np.unique(found, return_counts=True)
                    self.add(keys, n if learn else np.zeros(len(n), np.int64))


def block_keys(texts: list[bytes], trained: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys of the block's grams and words, and how often each is in training texts."""
    tally = Tally()
    tally.read(texts, trained, depth)
    return tally.keys, tally.n


def block_scores(texts: list[bytes], keys: np.ndarray, values: np.ndarray, depth: int, tokens: int, kinds: int, ends: int) -> dict[str, np.ndarray]:
    """Per text: n_tokens, n_known, base_score, score.  keys ascending; values: log10 probabilities of grams, counts of words."""
    out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
    whole = np.log10(tokens + (kinds + 1))
    for a, b in _pieces(texts):
        grams, begins = grams_of(texts[a:b], depth)
        asked, back = np.unique(grams, return_inverse=True)
        sums = np.concatenate(([0.0], np.cumsum(values[np.searchsorted(keys, asked)][back])))
        out["score"].append(sums[begins[1:]] - sums[begins[:-1]])
        words, first = hashing.words_of(texts[a:b])
        asked, back = np.unique(words | _WORD, return_inverse=True)
        counts = values[np.searchsorted(keys, asked)][back]
        logs = np.concatenate(([0.0], np.cumsum(np.log10(counts + 1) - whole)))
        known = np.concatenate(([0], np.cumsum(counts > 0)))
        out["n_tokens"].append(np.diff(first) + 1)
        out["n_known"].append(known[first[1:]] - known[first[:-1]] + int(ends > 0))
        out["base_score"].append(logs[first[1:]] - logs[first[:-1]] + np.log10(ends + 1) - whole)
    return {k: np.concatenate(v) for k, v in out.items()}


# --- the tree --------------------------------------------------------------------------------------------------------

_STIRLING = 8.0


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: the asymptotic series after moving x up by 8."""
    y = x + _STIRLING
    product = x.copy()
    for i in range(1, int(_STIRLING)):
        product = product * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """The nodes of all contexts of one depth: key = context << 8 | node, ascending; node 1 is the byte tree's root."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray  # log of the weighted probability
    own: np.ndarray  # the share of the node's own estimate against deeper contexts'
    so_far: np.ndarray | None = None  # the mixture of this and shallower contexts, without what deeper ones will add
    rest: np.ndarray | None = None  # what is left for deeper ones
    final: np.ndarray | None = None  # probability of a one if no deeper context has seen the node
    depth: int = 0

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return at, (self.key[at] == key) if len(self.key) else np.zeros(len(key), bool)

    def descend(self, above: Level | None) -> None:
        one = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        if above is None:
            so_far, rest = np.zeros(len(one)), np.ones(len(one))
        else:
            at, _ = above.find(_shallower(self.key, above_depth=self.depth - 1))
            so_far, rest = above.so_far[at], above.rest[at]
        self.final = so_far + rest * one
        self.so_far, self.rest = so_far + rest * self.own * one, rest * (1 - self.own)


def _shallower(key: np.ndarray, above_depth: int) -> np.ndarray:
    """Keys of the contexts one byte shorter: the byte furthest back is dropped."""
    return key & np.uint64((1 << (8 * above_depth + 8)) - 1)


def leaves(grams: np.ndarray, n: np.ndarray, depth: int) -> Level:
    """Nodes of the deepest contexts from gram counts."""
    seen = n > 0
    grams, n = grams[seen], n[seen].astype(np.float64)
    byte, context = grams & np.uint64(255), grams >> np.uint64(8)
    keys, ones = [], []
    for k in range(8):
        keys.append((context << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
        ones.append((byte >> np.uint64(7 - k)) & np.uint64(1))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    bit = np.concatenate(ones).astype(bool)
    every = np.tile(n, 8)
    b = np.bincount(back[bit], every[bit], len(key))
    a = np.bincount(back[~bit], every[~bit], len(key))
    return Level(key, a, b, log_kt(a, b), np.ones(len(key)), depth=depth)


def weigh(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray, depth: int) -> Level:
    """A level from its nodes' counts and the sums of their children's weighted logs."""
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, deeper) - np.log(2)
    return Level(key, zeros, ones, weighted, np.exp(own - np.log(2) - weighted), depth=depth)


def summed(child: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys one level up, with the sums of zeros, ones and weighted logs over their children."""
    key, back = np.unique(_shallower(child.key, child.depth - 1), return_inverse=True)
    return (key, *(np.bincount(back, x, len(key)) for x in (child.zeros, child.ones, child.weighted)))


def parents(child: Level) -> Level:
    return weigh(*summed(child), child.depth - 1)


def ladder(grams: np.ndarray, n: np.ndarray, depth: int, down_to: int) -> list[Level]:
    """Levels from the deepest to ``down_to``."""
    out = [leaves(grams, n, depth)]
    while out[-1].depth > down_to:
        out.append(parents(out[-1]))
    return out


def gram_logs(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each gram's last byte: each bit by the deepest of ``levels`` (deepest first) that saw its node."""
    byte = grams & np.uint64(255)
    total = np.zeros(len(grams))
    for k in range(8):
        key = ((grams >> np.uint64(8)) << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        one, open_ = np.full(len(grams), 0.5), np.ones(len(grams), bool)
        for level in levels:
            if not open_.any():
                break
            at, hit = level.find(_shallower(key, level.depth))
            new = open_ & hit
            one[new] = level.final[at[new]]
            open_ &= ~hit
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        total += np.log10(np.where(bit, one, 1 - one))
    return total


# --- a block, batch by batch -----------------------------------------------------------------------------------------

_SENT = 100_000  # rows of a batch that a worker sends back


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [_encoded(t) for t in batch.column("text").to_pylist()]


def asked_in(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Of a block's rows (block, text, held_out): its distinct keys (block, key, n), as :func:`block_keys` has them."""
    tally = Tally()
    for batch in batches:
        tally.read(_texts(batch), ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), depth)
        block = batch.column("block")[0].as_py()
    for a in range(0, len(tally.keys), _SENT):
        keys = tally.keys[a : a + _SENT].view(np.int64)
        yield pa.record_batch({"block": pa.array(np.full(len(keys), block, np.int32)), "key": pa.array(keys), "n": pa.array(tally.n[a : a + _SENT])})


_VALUE, _TRAINED, _HELD = 0, 1, 2  # kinds of rows that come back to a block, in this order


def scored_in(batches: Iterator[pa.RecordBatch], depth: int, tokens: int, kinds: int, ends: int) -> Iterator[pa.RecordBatch]:
    """Of a block's rows (kind, id, value, text), values of keys first: the scores of its texts, a batch for each with texts."""
    parts, keys, values = [], None, None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        first = int(np.searchsorted(kind, _TRAINED))
        if first:
            if keys is not None or (kind[first:] == _VALUE).any():
                raise RuntimeError("values of a block's keys must come before its texts")
            parts.append((batch.column("id")[:first].to_numpy().view(np.uint64).copy(), batch.column("value")[:first].to_numpy().copy()))
        if first == len(kind):
            continue
        if keys is None:
            keys, values = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys)
            keys, values, parts = keys[order], values[order], []
        batch = batch.slice(first)
        found = block_scores(_texts(batch), keys, values, depth, tokens, kinds, ends)
        held = pa.array(kind[first:] == _HELD)
        whole = pa.array(np.full(len(batch), tokens, np.int64))
        yield pa.record_batch({"doc_id": batch.column("id"), "held_out": held, "n_tokens": pa.array(found["n_tokens"]), "n_known": pa.array(found["n_known"]), "train_tokens": whole, "base_score": pa.array(found["base_score"]), "score": pa.array(found["score"])})


# --- the jobs --------------------------------------------------------------------------------------------------------


def lm_scores(docs: DataFrame, how: Ctw = Ctw(), *, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text, modulo ``modulus``, is ``held`` are held
    out of training; null ids are not.  Null and empty texts have one token, the
    end.  With nothing to train on all counts are 0 and each bit has probability
    one half.  Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    depth, split = how.depth, 3
    if not split <= depth <= 5:
        raise ValueError("depth must be 3, 4 or 5")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == held, F.lit(False)).alias("held_out")
    )
    size, ends = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held_out"), 1))).first()
    blocks = max(1, -(-(size or 0) // how.block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from asked_in(batches, depth)

    asked = stored(rows.select("block", "text", "held_out").repartitionById(blocks, F.col("block")).groupBy("block").applyInArrow(ask, "block int, key long, n long"))
    table = cut(asked.groupBy("key").agg(F.sum("n").alias("n")))
    words = table.where("key < 0")
    tokens, kinds = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)

    grams = table.where("key >= 0")
    groups = max(1, -(-grams.count() // how.group_rows))
    subtree = F.shiftright("key", 8).bitwiseAND((1 << 8 * split) - 1)
    grams = grams.withColumn("group", F.pmod(F.xxhash64(subtree), F.lit(groups)).cast("int"))

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        last = ladder(frame.key.to_numpy(np.int64).view(np.uint64), frame.n.to_numpy(np.int64), depth, split)[-1]
        key, zeros, ones, deeper = summed(last)
        return pd.DataFrame({"node": key.view(np.int64), "zeros": zeros, "ones": ones, "deeper": deeper})

    # The alphabet bounds this: at most 65,536 contexts of two bytes, and of those only what the texts have.
    upper = grams.groupBy("group").applyInPandas(up, "node long, zeros double, ones double, deeper double")
    upper = upper.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("deeper").alias("deeper")).toPandas().sort_values("node")
    two = weigh(upper.node.to_numpy(np.int64).view(np.uint64), upper.zeros.to_numpy(), upper.ones.to_numpy(), upper.deeper.to_numpy(), 2)
    one = parents(two)
    top = [two, one, parents(one)]
    for above, level in zip((None, top[2], top[1]), (top[2], top[1], top[0])):
        level.descend(above)
    shared = spark.sparkContext.broadcast(top)

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame.key.to_numpy(np.int64).view(np.uint64)
        levels = ladder(keys, frame.n.to_numpy(np.int64), depth, split)
        for above, level in zip((shared.value[0], *levels[:0:-1]), levels[::-1]):
            level.descend(above)
        return pd.DataFrame({"key": frame.key, "value": gram_logs(keys, [*levels, *shared.value])})

    known = grams.groupBy("group").applyInPandas(down, "key long, value double").unionByName(words.select("key", F.col("n").cast("double").alias("value")))
    answers = asked.select("block", "key").join(known, "key").select("block", F.lit(_VALUE).alias("kind"), F.col("key").alias("id"), "value", F.lit(None).cast("string").alias("text"))
    texts = rows.select("block", F.when(F.col("held_out"), _HELD).otherwise(_TRAINED).alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("double").alias("value"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored_in(batches, depth, tokens, kinds, ends)

    both = answers.unionByName(texts).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
    return both.groupBy("block").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
