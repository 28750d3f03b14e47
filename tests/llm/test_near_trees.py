"""Candidates of the near stage come from BK-trees over shards of SimHash fingerprints."""

import random

import numpy as np

from scanframe.llm import simhash


def _plain(fps, radius):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_trees_link_what_all_pairs_link(monkeypatch):
    searched = []

    class Tree(simhash.BKTree):
        def near(self, fp, radius):
            searched.append(fp)
            return super().near(fp, radius)

    monkeypatch.setattr(simhash, "BKTree", Tree)
    rng = random.Random(4)
    for radius in (0, 2, 10, 26):
        fps = [rng.getrandbits(64) for _ in range(12)]
        fps += [x ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) & (1 << 64) - 1 for x in fps for _ in range(3)] + fps[:3]
        rng.shuffle(fps)
        nodes = np.arange(len(fps)) + 100
        assert (simhash.wide_forest(nodes, np.array(fps, np.uint64), radius) - 100).tolist() == _plain(fps, radius)
    assert len(searched) == 4 * len(fps)


def test_fingerprints_within_the_radius_share_a_block_shard():
    rng = random.Random(6)
    for _ in range(200):
        fp = rng.getrandbits(64)
        other = fp ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert set(simhash.block_keys(fp)) & set(simhash.block_keys(other))
    assert not set(simhash.block_keys(fp)) & set(simhash.block_keys(fp ^ (1 | 1 << 16 | 1 << 32)))
