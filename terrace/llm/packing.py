"""Best-fit packing of tokenised documents into sequences of bounded length, with swap-based local search.

Documents become token ids with an end mark; only those longer than a sequence
are cut.  Full pieces are sequences of their own.  The others are dealt into
groups of bounded size; each group is packed best-fit, largest first, and then
improved by local search: documents are moved, exchanged one for one or two for
one between underfull bins, always into the fuller bin, so the sum of squared
fills grows until the emptiest bins are empty.  What lies in underfull bins of
all groups is dealt into new groups and packed once more.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import cut, prepare

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}
#: What the fast encoder has to agree on with the tokenizers library before it is used.
_TRIAL = (
    "The  cats' don't\n\n 12,345 über naïve\t你好 \U0001f600x   ",
    "I'LL we've it's 'S ''re\r\n\r\n\x0b x\x00\x7f\x85\xa0\u2003end\u200b \ufeff",
    "٣٤٥ ¼ ⅷ x² 3.14e-10 0x1F _a__b- --- ... !!\n\t \n",
    "e\u0301 क्षि ไทย עברית 한국어 \U0001f468\u200d\U0001f469 \ud7ff\ue000\uffff\U0010ffff",
    "aaaa" * 60 + " " * 70 + "\n" * 30 + "=" * 90,
)


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    length: int = 1024
    end_id: int = 2
    group: int = 8192


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids as the tokenizers library gives them for the file at ``path`` without adding special tokens.

    A byte-level BPE file is read into an encoder that gives the same ids several
    times as fast, if it agrees on the trial texts.  Texts in which a special
    token is written out always go to the library.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        whole: list[Tokenizer] = []

        def slow(text: str) -> list[int]:
            if not whole:
                whole.append(Tokenizer.from_file(path))
            return whole[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = slow
        try:
            fast, special = _byte_bpe(path)
        except (KeyError, ValueError):  # another kind of file
            return slow
        if all(fast(t) == slow(t) for t in _TRIAL):

            def quick(text: str) -> list[int]:
                return slow(text) if any(x in text for x in special) else fast(text)

            _ENCODERS[path] = quick
            whole.clear()  # read again if a text needs it
    return _ENCODERS[path]


def _byte_bpe(path: str) -> tuple[Callable[[str], list[int]], list[str]]:
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, special_texts = found["model"], [t["content"] for t in found["added_tokens"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = len(model["merges"]) + 256
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, special_texts


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all of full length but for the first."""
    first = n % length or min(n, length)
    return [(0, first), *((at, length) for at in range(first, n, length))]


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of indices: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r tokens of room
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), length
            bins.append([])
        bins[b].append(i)
        if left := room - size:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, length: int) -> list[list[int]]:
    """Local search between underfull bins until no bin has an improving step; returns the bins that are left.

    Bins give from the emptiest on, each as long as it can.  A step adds to a bin
    at least as full, so the sum of squared fills grows with every step and the
    search ends.
    """
    fill = np.array([sizes[b].sum() for b in bins], np.int64)
    under = sorted(np.flatnonzero(fill < length).tolist(), key=lambda i: (-fill[i], i))
    # What can be taken: every document of an underfull bin, or nothing (a document -1 of no size for each bin).
    item = np.array([x for b in under for x in (-1, *bins[b])], np.int64)
    at = np.array([b for b in under for _ in range(len(bins[b]) + 1)], np.int64)
    size = np.where(item < 0, 0, sizes[item])
    moved = True
    while moved:
        moved = False
        for low in sorted(under, key=lambda i: (fill[i], -i)):
            while 0 < fill[low] < length and (step := _best_step(low, item, at, size, fill, length)):
                gain, high, give, take = step
                at[give], at[take] = high, low
                fill[low], fill[high] = fill[low] - gain, fill[high] + gain
                moved = True
        under = [b for b in under if 0 < fill[b] < length]
    left: dict[int, list[int]] = {b: [] for b in at.tolist()}
    for x, b in zip(item.tolist(), at.tolist()):
        left[b] += [x] if x >= 0 else []
    return [b for b in (left.get(i, own) for i, own in enumerate(bins)) if b]


def _best_step(low: int, item: np.ndarray, at: np.ndarray, size: np.ndarray, fill: np.ndarray, length: int) -> tuple[int, int, list[int], list[int]] | None:
    """The step that adds most to some fuller bin: (tokens gained, that bin, places given by low, places taken from it).

    A document is moved, or exchanged for a smaller one, or two are exchanged for
    one that is smaller than both together.
    """
    own = np.flatnonzero((at == low) & (item >= 0))
    others = np.flatnonzero((at != low) & (fill[at] >= fill[low]) & (fill[at] < length))
    if not len(others):
        return None
    room = length - fill[at[others]]
    one, two = np.triu_indices(len(own), 1)
    best: tuple[int, int, list[int], list[int]] | None = None
    for pairs, offered in ((False, size[own]), (True, size[own[one]] + size[own[two]])):
        given, first = np.unique(offered, return_index=True)
        takes = others[item[others] >= 0] if pairs else others
        rooms = room[item[others] >= 0] if pairs else room
        for k in range(0, len(given) if len(takes) else 0, 64):
            gain = given[k : k + 64, None] - size[takes][None, :]
            gain = np.where((gain > 0) & (gain <= rooms[None, :]), gain, 0)
            g, t = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[g, t] > (best[0] if best else 0):
                n = first[k + g]
                give = [int(own[one[n]]), int(own[two[n]])] if pairs else [int(own[n])]
                best = int(gain[g, t]), int(at[takes[t]]), give, [int(takes[t])] if item[takes[t]] >= 0 else []
    return best


def packed(sizes: np.ndarray, how: Packing) -> list[list[int]]:
    return improve(best_fit(sizes, how.length), sizes, how.length)


def tokenised(docs: DataFrame, how: Packing, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row (a number no other piece has).

    A null text is taken as empty: its only token is the end mark.
    """
    prepare(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, row = encoder(how.tokenizer), (TaskContext.get().partitionId() << 33) - 1
        for frame in frames:
            out = []
            for doc, t in zip(frame.doc_id, frame.text):
                ids = np.array([*encode("" if t is None else t), how.end_id], "<u4")
                for k, (start, n) in enumerate(pieces_of(len(ids), how.length)):
                    out.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), row := row + 1))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def _dealt(pieces: DataFrame, how: Packing, level: int) -> DataFrame:
    """Pack within groups of about ``how.group`` pieces; sequence_id is unique to the level, open marks underfull bins."""
    groups = max(1, -(-pieces.count() // how.group))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, open boolean"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        sizes = frame.length.to_numpy(np.int64)
        number, offset, is_open = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), np.zeros(len(frame), bool)
        for k, b in enumerate(packed(sizes, how)):
            number[b] = (int(frame.group[0]) << 22 | k) * 4 + level
            offset[b] = np.cumsum(sizes[b]) - sizes[b]
            is_open[b] = sizes[b].sum() < how.length
        return frame.drop(columns="group").assign(sequence_id=number, offset=offset, open=is_open)

    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("long"))
    return cut(grouped.groupBy("group").applyInPandas(run, kinds))


def pack(docs: DataFrame, how: Packing, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document, empty ones, repeated rows and null ids included, is in the
    result once.  An empty table gives an empty result.  Other columns are not read.
    """
    every = cut(tokenised(docs, how, doc_id=doc_id, text=text))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = every.where(F.col("length") == how.length).withColumns({"sequence_id": F.col("row") * 4, "offset": F.lit(0).cast("long")})
    first = _dealt(every.where(F.col("length") < how.length), how, 1)
    second = _dealt(first.where("open").drop("sequence_id", "offset", "open"), how, 2)
    return full.select(names).unionByName(first.where("not open").select(names)).unionByName(second.select(names))
