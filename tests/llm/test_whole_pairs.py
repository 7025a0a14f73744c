"""Pairs of a shard are replaced until few repeat, first-level pairs leave room for longer ones."""

import numpy as np

from cuepoint.llm import token_output


def test_moderately_frequent_pairs_are_replaced():
    rng = np.random.default_rng(3)
    phrases = rng.integers(0, 49000, (200, 8))
    ids = phrases[np.repeat(np.arange(200), 20)[rng.permutation(4000)]].reshape(-1)
    shard = token_output.compress(ids.astype(np.int32), np.array([len(ids)]))
    assert np.array_equal(token_output.Shard(shard).ids(), ids)
    assert len(shard) < 0.6 * 2 * len(ids)
