"""What Python workers keep: pieces that are in use, and no more memory than the work needs."""

import tracemalloc

import numpy as np
import pyarrow as pa

from panelwright.llm import katz
from panelwright.llm.common import PieceCache, Pieces, trim


def _cache(limit):
    asked = []

    def encode(keys):
        asked.append(keys)
        return [k.encode("utf-16-le") for k in keys]

    return PieceCache(encode, np.uint16, limit), asked


def test_pieces_in_use_outlive_a_full_cache():
    cache, asked = _cache(4)
    cache.packed(["a", "b", "c"])
    cache.packed(["a", "d", "e"])
    assert cache.packed(["a", "e"]) == [b"a\0", b"e\0"]
    assert asked == [["a", "b", "c"], ["d", "e"]]
    assert len(cache.known) <= 4
    cache.packed([*"fghijk"])
    cache.packed([*"lmnopqa"])
    assert "f" not in cache.known


def test_pieces_of_a_slice_are_gathered():
    lists = pa.array([["x"], ["ab", "", "x"], [], ["abc", "ab"]], pa.list_(pa.string()))
    ids, bounds = _cache(10)[0].gather(Pieces(lists.slice(1)))
    assert ids.tolist() == [ord(c) for c in "abxabcab"] and bounds.tolist() == [0, 3, 3, 8]
    none, bounds = _cache(10)[0].gather(Pieces(pa.array([[], []], pa.list_(pa.string()))))
    assert len(none) == 0 and bounds.tolist() == [0, 0, 0]


def test_trim_empties_the_cache_in_use():
    cache, asked = _cache(10)
    cache.packed(["a"])
    trim()
    assert not cache.known and PieceCache.in_use is None
    assert cache.packed(["a"]) == [b"a\0"] and len(asked) == 2


def test_packed_numbers_of_any_width_come_back():
    columns = [np.array([0, 1, top - 1, top]) for top in (255, 256, (1 << 24) - 1, 1 << 24, 1 << 31, (1 << 62) + 1)]
    back = katz._opened(katz._squeeze(*columns))
    assert all(x.tolist() == y.tolist() for x, y in zip(columns, back, strict=True))
    assert [x.dtype.itemsize for x in back] == [4, 4, 4, 8, 8, 8]


def test_a_group_of_pairs_is_counted_in_bounded_memory():
    rng, asked = np.random.default_rng(3), []
    for _ in range(10):
        before, word = np.sort(rng.integers(0, 20_000, 30_000)), rng.integers(1, 20_000, 30_000)
        n = rng.integers(0, 3, 30_000)
        asked.append(katz._squeeze(katz._steps(before), word, n, np.where(n > 0, word + 7, 0)))
    group = pa.table({"group": [0] * 10, "chunk": list(range(10)), "packed": pa.array(asked, pa.binary())})
    tracemalloc.start()
    try:
        katz._count_pairs((pa.scalar(0),), group)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(most / 300_000)
    assert most < 100 * 300_000
