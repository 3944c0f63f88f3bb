"""Phrases against counting every stretch of words in plain Python and against SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidemark.llm import phrases

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def by_counting(rows, least, top):
    found, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        found[lang, tuple(words[i : i + k])] += 1
    cand = {p: a for p, a in found.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        if any(o == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in cand.items()):
            continue
        score, k = min((1000 * a * n[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, score, a, " ".join(p), found[lang, p[:k]], found[lang, p[k:]], n[lang]))
    want = set()
    for lang in n:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:top]
        want |= {(lang, i, p, a, x, y, m, s) for i, (_, s, a, p, x, y, m) in enumerate(own, 1)}
    return want


def some(seed, docs=60):
    r = random.Random(seed)
    rows = []
    for _ in range(docs):
        words = r.choices(["a", "B", "b", "cd", "É", "é", "x,", "y.", "z\n", "\t", "q\x0b", "kö"], k=r.randint(0, 60))
        text = "new York city hall " * r.randint(0, 3) + " ".join(words) + r.choice(["", ".", " old york"])
        rows.append((r.choice([None, "", text, text]), r.choice([None, "en", "de"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shard", [1 << 30, 60])
def test_against_counting(spark, seed, shard):
    rows = some(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:20]], "text string, lang string, a int, phrase string").repartition(4)
    for least, top in ((4, 1000), (12, 5)):
        assert {tuple(r) for r in phrases.collocations(df, least, top, shard_words=shard).collect()} == by_counting(rows + rows[:20], least, top)


def test_full_filter_and_empty_tables(spark):
    rows = some(9)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert {tuple(r) for r in phrases.collocations(df, 5, bits=64).collect()} == by_counting(rows, 5, 2000)  # 64 bits let everything through
    assert phrases.collocations(df.limit(0), 5).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), (" .\t", "en")], "text string, lang string"), 1).count() == 0


def test_huge_counts(spark, monkeypatch):
    """Scores whose products pass 64 bits."""
    found = [("en", "a", 1, 10**12), ("en", "b", 1, 9 * 10**11), ("en", "a b", 2, 8 * 10**11)]
    monkeypatch.setattr(phrases, "counts", lambda docs, least: (spark.createDataFrame(found, "lang string, phrase string, words int, a long"), spark.createDataFrame([("en", 7 * 10**13)], "lang string, n long")))
    (r,) = phrases.collocations(None).collect()
    assert r.score == 1000 * 8 * 10**11 * 7 * 10**13 // (10**12 * 9 * 10**11)


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    got = con.execute(phrases.ORACLE)
    names = [c[0] for c in got.description]
    assert sorted(tuple(r) for r in phrases.query(spark, d).select(*names).collect()) == sorted(got.fetchall())
