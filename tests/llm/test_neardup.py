"""The wide fingerprint of the pipeline's near_dedup: SimHash segments and their one-wildcard variants."""

import numpy as np

from factweave.llm.neardup import SAMPLES, SEGMENTS, segment_samples, segment_variants


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_variants_are_simhashes_with_one_sample_left_out():
    """Sets that differ in one sample of each segment share the variant that leaves it out, and no other."""
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, SEGMENTS * SAMPLES, dtype=np.uint64)
    for j in range(SAMPLES):
        b = a.copy()
        b[j::SAMPLES] = r.integers(0, 1 << 63, SEGMENTS, dtype=np.uint64)
        x, y = segment_variants(np.array([a, b])).reshape(2, SEGMENTS, SAMPLES)
        assert ((x == y) == (np.arange(SAMPLES) == j)).all()
    two = a.copy()
    two[0::SAMPLES], two[1::SAMPLES] = r.integers(0, 1 << 63, (2, SEGMENTS), dtype=np.uint64)
    x, y = segment_variants(np.array([a, two]))
    assert not (x == y).any() and len(np.unique(np.r_[x, y])) == 2 * len(x)


def test_variants_against_counted_bits(monkeypatch):
    from factweave.llm import neardup

    r = np.random.default_rng(4)
    a = r.integers(0, 1 << 63, (1, SEGMENTS * SAMPLES), dtype=np.uint64)
    same = np.ones(SEGMENTS * SAMPLES, np.uint64)
    monkeypatch.setattr(neardup, "_PLACES", same)
    got = segment_variants(a).reshape(SEGMENTS, SAMPLES)
    mask = (1 << 64) - 1
    for s in range(SEGMENTS):
        mixed = []
        for h in a[0, s * SAMPLES : (s + 1) * SAMPLES].tolist():
            h ^= h >> 31
            h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & mask
            mixed.append(h ^ h >> 32)
        for j in range(SAMPLES):
            assert int(got[s, j]) & mask == majority(mixed[:j] + mixed[j + 1 :]) ^ 1


def test_recall_at_the_limit():
    """Sets of a Jaccard similarity of 0.8 meet; those of 0.3 rarely do."""
    r = np.random.default_rng(5)
    met = {0.8: 0, 0.3: 0}
    for s in met:
        for _ in range(400):
            n = int(r.integers(40, 400))
            both = round(n * s)
            x = r.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            keys = segment_variants(np.array([segment_samples(x[:n - (n - both) // 2]), segment_samples(np.r_[x[:both], x[n - (n - both) // 2 : n]])]))
            met[s] += bool(np.isin(*keys).any())
    assert met[0.8] >= 399 and met[0.3] < 100
