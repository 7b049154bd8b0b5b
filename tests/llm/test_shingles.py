import random

import numpy as np

from lodestar.llm import golay_simhash, shingles

SAME = ["A b", "a B ", "\ta\x0bb\n", "x" * 70_000 + " y z", "X" * 70_000 + "\ty  z"]
TEXTS = [None, "", " \n\t", *SAME, "ab", "a\x85b  c", "é è É \udfff".encode("utf-8", "ignore").decode(), "a b c d e", "y z q w e " * 30_000]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "form", "from", "on", "no", str(rng.random())]) for _ in range(n))


def test_equal_where_xxh64_is_equal():
    """The same texts' shingles are equal as by XXH64, whatever is hashed together."""
    texts = TEXTS + [prose(n, n) for n in range(0, 400, 7)]
    for size in (1, 3, 5):
        want = [golay_simhash.shingle_hashes(t, size) for t in texts]
        got = shingles.hashes_of_each(texts, size)
        assert [len(x) for x in got] == [len(x) for x in want]
        a, b = np.concatenate(want), np.concatenate(got)
        assert len(np.unique(a)) == len(np.unique(b)) == len(np.unique(np.stack([a, b]), axis=1).T)
        assert all((shingles.shingle_hashes(t, size) == x).all() for t, x in zip(texts, got))


def test_bits_are_even():
    h = np.unique(np.concatenate(shingles.hashes_of_each([prose(2000, s) for s in range(10)], 5)))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert len(h) > 10_000 and 0.47 < ones.min() and ones.max() < 0.53


def test_no_texts():
    assert shingles.hashes_of_each([], 5) == []
