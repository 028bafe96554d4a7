import numpy as np

from gristmill.llm import ngram_join as nj


def test_sets_survive_packing():
    for n in (1, 5, 257, 1000, 70000):
        own = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        assert (nj.unpacked(nj.packed(own)) == (own >> nj.U(24)) << nj.U(24)).all()


def test_bitmaps_lose_no_link():
    rng, links = np.random.default_rng(1), 0
    for _ in range(2000):
        n = int(rng.integers(2, 400))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.r_[pool[:1], pool[:n][rng.random(n) < rng.uniform(0.6, 1)], pool[n : n + int(rng.integers(0, n // 4 + 1))]])
        if nj.linked(nj.unpacked(nj.packed(a)), nj.unpacked(nj.packed(b))):
            links += 1
            assert nj.may_link(nj.parities(a), nj.parities(b), len(a), len(b))
    assert links > 100
