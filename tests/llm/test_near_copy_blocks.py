"""What leaves a block of near copies, and the sets behind it."""

import numpy as np
import pyarrow as pa

from vulnlake.llm import jaccard_join


def test_nearest_ones_grow_with_the_group_and_not_with_its_square():
    size = 300
    sketch = np.full(jaccard_join.BINS, 4, np.uint8).tobytes()
    same = lambda value: pa.array([value] * size, pa.int64())
    rows = pa.RecordBatch.from_arrays(
        [same(1), pa.array(range(size), pa.int64()), pa.array(range(size), pa.int64()), same(1024), same(0), pa.array([False] * size),
         pa.array([sketch] * size, pa.binary()), same(7)], ["part", "c", "g", "n", "block", "crossing", "sketch", "h"])
    made = lambda nearest: sum(b.num_rows for b in jaccard_join._may_link(85, nearest)(iter([rows])))
    assert 0 < made(True) <= size and made(False) == size * (size - 1) // 2


def test_sets_of_odd_texts():
    texts = pa.array(["a b c d e", "A  b\tC d\ne ", None, "", " \n", "a b", "x y x y x y x", "É b c d", "é b c d"])
    grams, sizes, c, d = jaccard_join._sets(texts, 4)
    assert sizes.tolist() == [2, 2, 0, 0, 0, 1, 2, 1, 1] and len(grams) == 9
    for key in (c, d):
        assert key[0] == key[1] and key[7] != key[8] and len(set(key.tolist())) == 6
