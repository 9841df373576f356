"""The order in which n-grams are numbered."""

from __future__ import annotations

import numpy as np

from codeloom.operators import matching as M


def test_keys_in_order_whatever_their_size():
    draw = np.random.default_rng(5)
    for top, n in ((3, 0), (3, 1), (5, 400), (1 << 40, 400), (1 << 62, 400)):
        keys = draw.integers(0, top, n)
        keys[n // 2 :] = keys[: n - n // 2]
        order, new = M._in_order(keys)
        assert order.tolist() == sorted(range(n), key=lambda i: (keys[i], i))
        assert new.sum() == len(set(keys.tolist())) and (n == 0 or new[0])
