import itertools
import zlib

import numpy as np
import pytest

from terrace.llm import packing
from terrace.llm.queries import tokenizer_path
from tests.llm.helpers import ODD, documents


def test_fast_ids_are_the_tokenizers(sf_dir):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    texts = [t for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() if t][:60] + [*packing._TRIAL, "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "​  \r\n\t x", "😀👩‍👩‍👧 ñ̃", "a" * 3000]
    fast = packing.encoder(tokenizer_path())
    assert fast.__name__ == "quick"
    for t in texts:
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids


def test_pieces():
    assert packing.pieces_of(1, 1024) == [(0, 1)]
    assert packing.pieces_of(1024, 1024) == [(0, 1024)]
    assert packing.pieces_of(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


@pytest.mark.parametrize("low", [1, 300, 600])
def test_packing_keeps_everything_and_is_tight(low):
    rng = np.random.default_rng(low)
    how = packing.Packing("", group=2000)
    sizes = rng.integers(low, 1024, 2000)
    bins = packing.packed(sizes, how)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(sizes[b].sum() <= 1024 for b in bins)
    if low == 1:
        assert len(bins) <= 1.01 * -(-sizes.sum() // 1024)
    if low == 600:
        assert len(bins) == 2000


def test_local_search_grows_squared_fill_and_empties_bins():
    sizes = np.array([600, 500, 300, 300, 124, 224])
    start = [[0], [1, 2], [3, 4, 5]]  # fills 600, 800, 648: two bins hold all
    end = packing.improve([list(b) for b in start], sizes, 1024)
    square = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
    assert square(end) > square(start) and len(end) == 2
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = rng.integers(1, 700, 40)
        loose = [[i] for i in range(40)]
        end = packing.improve([list(b) for b in loose], sizes, 1024)
        assert square(end) >= square(loose) and sorted(i for b in end for i in b) == list(range(40))
        assert all(sizes[b].sum() <= 1024 for b in end)


def improving(bins, sizes):
    """Whether any move, one-for-one or two-for-one exchange still adds to a bin at least as full: by trying all."""
    fill = [int(sizes[b].sum()) for b in bins]
    for low in range(len(bins)):
        for high in range(len(bins)):
            if high != low and 1024 > fill[high] >= fill[low]:
                for give in [*itertools.combinations(bins[low], 1), *itertools.combinations(bins[low], 2)]:
                    for take in [0, *sizes[bins[high]].tolist()] if len(give) == 1 else sizes[bins[high]].tolist():
                        if 0 < int(sizes[list(give)].sum()) - take <= 1024 - fill[high]:
                            return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_no_bin_is_left_with_an_improving_step(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [700, 500, 120, 1023, 340, 60][seed], 70)
    assert not improving(packing.packed(sizes, packing.Packing("")), sizes)


def test_against_a_plain_reading(spark):
    how = packing.Packing(tokenizer_path(), group=32)
    rows = ODD + [(20 + k, f"document number {k} " * (k * 7 % 60)) for k in range(30)]
    found = packing.pack(documents(spark, rows), how).collect()
    encode = packing.encoder(tokenizer_path())
    expected = []
    for doc, text in rows:
        ids = np.array([*encode(text or ""), 2], "<u4")
        expected += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids), 1024))]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(expected, key=repr)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(bins) <= -(-total // 1024) + 2
    assert packing.pack(documents(spark, []), how).count() == 0
