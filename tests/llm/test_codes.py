"""Product codes against plain loops in whole numbers, and the trie against all distances."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidemark.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code int"


def by_loops(rows):
    """The contract, entry by entry; rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    cut = [[tuple((v + [0] * 4 * width)[k * width : (k + 1) * width]) for k in range(4)] for _, v, _ in kept]
    books = [[p[k] for p in cut[:256]] for k in range(4)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(4):
        for k in range(4):
            own = {}
            for p in cut:
                own.setdefault(best(p[k], books[k])[1], []).append(p[k])
            books[k] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if e in own else c for e, c in enumerate(books[k])]
    out, by_label = [], {}
    for (i, _, lab), p in zip(kept, cut):
        found = [best(p[k], books[k]) for k in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    top = 2**63 - 1
    return sorted(((i, c, min(e, top), min(by_label[lab], top), digest) for i, c, e, lab in out), key=str)


def some(seed, n=60, dim=8):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.integers(-3, 4, dim) / 8).tolist() if i % 3 else rng.normal(size=dim).tolist(), [None, 1, 2][i % 3]) for i in range(n)]


@pytest.mark.parametrize("rows", [some(0, 300), some(1, 20), some(2, 30, 6), [*some(3), *some(3), (None, [0.5] * 8, 1)], [*some(4), (90, None, 1), (91, [None] * 8, 1), (92, [float("nan")] * 8, 2), (93, [float("inf")] * 8, 2), (94, [0.25, -0.25], 2), (95, [], 2)], [(1, [3e38] * 8, 1), (2, [-3e38, 1.0] * 4, 1), (3, [0.0] * 8, None)], []])
def test_against_loops(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in codes.report(df).collect()), key=str) == by_loops(rows)


@pytest.mark.parametrize("kind", ["float64", object])
def test_trie_gives_the_nearest_entries(kind):
    rng = np.random.default_rng(5)
    x = np.unique(np.concatenate([rng.integers(-2, 3, (300, 4)), rng.integers(-900, 900, (300, 4))]), axis=0).astype(kind)
    book = rng.integers(-3, 4, (40, 4)).astype(kind)
    which, far = codes.nearest(x, book)
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert which.tolist() == d.argmin(1).tolist() and far.tolist() == d.min(1).tolist()


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    got = con.execute(codes.ORACLE)
    names = [c[0] for c in got.description]
    assert sorted(tuple(r) for r in codes.query(spark, d).select(*names).collect()) == sorted(got.fetchall())
