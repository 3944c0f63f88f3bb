"""Packing against the tokenizer itself and against a search over all ways to cut."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

TEXTS = [None, "", "Hello there. <|endoftext|> It's 3 o'clock!\nA line\n\nÉté é ẖ H̱ ΟΔΟΣ x y\tz", "plain words " * 4000, "x" * 9000, "One two three. " * 1500, "a\n", "\n", " ", "Hello there.", "a \x01 b\x01c \x01\x01"]


def padding(length: int) -> int:
    return 0 if length.bit_count() == 1 else packing.SIZE - length


def check(rows, texts):
    """rows: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of texts by their doc_id; gives the padding."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
        total += padding(at)
    return total


def test_pieces_cover_every_text(spark):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(df, chain=9000).collect()
    assert check(got, {i: t for i, t, _ in rows}) <= 0.02 * sum(r.length for r in got)
    assert packing.pack(df.limit(0)).count() == 0
    assert [r.doc_id for r in packing.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()] == [None]
    twice = packing.pack(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.start, r.length) for r in twice) == [(0, 2), (0, 2)]


def test_ids_of_odd_texts():
    words, tokenizer = packing.Words(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    signs = [*"abcXYZ019 \n\t\r.,;:!?'\"()<>|-_=", "é", "É", "ß", "×", "÷", "e\u0301", "=\u0338", "\u0301", "…", "Σ", "İ", "中", "\u00a0", "\u2003", "'s", "'LL", "<|endoftext|>", "\x01", "\x1c", "😀", "ÿ", "H\u0331"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(3000)]
    ids, counts, _ = words.encode(pa.array(["skipped", *texts, None])[1:])
    want = [[*e.ids, 2] for e in tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = packing.query(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert check(got, texts) <= 0.005 * sum(r.length for r in got)


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_the_best(monkeypatch, seed):
    """The queue's cost against the least over all earlier cuts."""
    monkeypatch.setattr(packing, "SIZE", 32)
    monkeypatch.setattr(packing, "GRID", 4)
    rng = np.random.default_rng(seed)
    n = int(rng.integers(40, 400))
    stop = rng.random(n) < 0.15
    docs = np.unique(np.append(rng.integers(1, n, 5), n))
    at, cost = packing.places(docs, stop)
    assert np.diff(np.concatenate([[0], at])).max() <= 16
    pos, best, back = packing.ways(at, cost)
    want = [0]
    for i in range(1, len(pos)):
        want.append(min(want[j] + padding(pos[i] - pos[j]) for j in range(i) if pos[i] - pos[j] <= 32) + int(cost[i - 1]) + packing.OPEN)
    assert best == want
    way = packing.trail(pos, back, len(pos) - 1)
    assert sum(padding(b - a) for a, b in zip(way, way[1:])) + sum(int(cost[pos.index(p) - 1]) + packing.OPEN for p in way[1:]) == best[-1]
    final = packing.cuts(docs, stop, True)
    assert final[0] == 0 and final[-1] == n and all(0 < b - a <= 32 for a, b in zip(final, final[1:]))
    open_ = packing.cuts(docs, stop, False)
    assert 0 < open_[-1] <= n
