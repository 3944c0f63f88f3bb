"""Linked short sets share a cell at every setting, as all pairs say."""

import itertools

import numpy as np
import pytest

from tidemark.llm import jaccard


@pytest.mark.parametrize("j", [0.9, 0.8, 0.6, 0.5])
def test_linked_sets_share_a_cell(j):
    rng = np.random.default_rng(11)
    for n in range(1, 61):
        most = jaccard.most_apart(n, j)
        for _ in range(40 if n > 10 else 300):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            apart = rng.integers(0, most + 1)
            gone = rng.integers(0, apart + 1)
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, apart - gone, dtype=np.uint64)])
            both = n - gone
            if both and 100 * both >= round(100 * j) * (n + len(b) - both):
                assert set(jaccard.cells(np.sort(a), j)) & set(jaccard.cells(np.sort(b), j)), (n, gone, apart)


@pytest.mark.parametrize("n, j", [(5, 0.8), (3, 0.9)])
def test_short_texts_against_all_pairs(spark, n, j):
    rng = np.random.default_rng(12)
    texts = []
    for i in range(150):
        words = [f"v{i}x{k}" for k in range(rng.integers(1, 16))]
        texts += [" ".join(words), " ".join(words + ["more"])]
    sets = []
    for t in texts:
        w = t.split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= round(100 * j) * len(sets[a] | sets[b]):
            root[b] = root[a]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar_join(df, n=n, j=j).collect()} == dict(enumerate(root))


def test_rows_of_one_id_and_without_ids(spark):
    long, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, long), (5, other), (7, other), (None, long), (9007199254740993, long + " more"), (None, "alone here"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "0 as component")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.similar_join(df).collect())
    assert got == [(0, 1, 0), (0, 28, 5), (3, 0, 3), (5, 28, 5), (5, 28, 5), (7, 28, 5), (9007199254740993, 29, 5)]
