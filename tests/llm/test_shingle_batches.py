"""Shingles of texts that are hashed together are those of each text by itself."""

import random

import numpy as np
import pytest

from tidemark.llm import jaccard


def by_itself(text, n):
    """A word's hash byte by byte, then the hashes of its runs, in plain integers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits at 9-13 and 32
    full = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    hashes = []
    for w in words:
        h = 0
        for i, b in enumerate(w):
            h = (h * 0x100000001B3 + (mixed(b + 1) if i < 24 else b + 1)) & full
        hashes.append(mixed((h + len(w)) & full))
    k, out = min(n, len(words)), set()
    for i in range(len(words) - k + 1 if words else 0):
        h = 0
        for w in hashes[i : i + k]:
            h = mixed((h * 0x9E3779B97F4A7C15 + w) & full)
        out.add(h)
    return sorted(out)


@pytest.mark.parametrize("size", [0, 40, 1 << 16])
@pytest.mark.parametrize("n", [1, 3, 5])
def test_texts_hashed_together(monkeypatch, size, n):
    monkeypatch.setattr(jaccard, "HASHED_BYTES", size)
    r = random.Random(n)
    parts = [" ", "\t", "\n", "\x0b", "\r", "a", "B", "é", " ", "\x1c", "\x85", "\ud800", "z" * 23, "y" * 24, "X" * 25, "w" * 60]
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(300)]
    got = list(jaccard.all_shingles(texts, n))
    assert len(got) == len(texts)
    for text, own in zip(texts, got, strict=True):
        assert own.dtype == np.uint64 and own.tolist() == by_itself(text, n)
        assert jaccard.shingles(text, n).tolist() == own.tolist()
